"""From messages to verdicts: analyzers, fusion, ordered evidence, category and explanation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import bound
from vigil.operators import anchors
from vigil.operators import urls as U
from vigil.operators.analyzers import analyzed, header_body, header_names
from vigil.operators.scoring import CATEGORY_WEIGHT, scored
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources import rules
from vigil.sources.rules import BUILT_IN, Pack

SENDER_SEVERITY = {"BRAND_CLAIM_WITHOUT_DLT_HEADER": 0, "UNREGISTERED_NUMERIC_SENDER": 2, "DLT_HEADER_MISMATCH": 2}


def f32(v) -> Column:
    return F.lit(float(v)).cast("float")


def severity_weight(severity: Column) -> Column:
    out = f32(0)
    for s, w in enumerate(rules.SEVERITY_WEIGHTS):
        out = F.when(severity == s, f32(w)).otherwise(out)
    return out


SLOTS = "struct<" + ", ".join(f"{s}: string" for s in U.SLOTS) + ">"
URL_ITEM = f"struct<ord: int, pos: int, type: string, severity: int, start: int, end: int, slots: {SLOTS}>"
ITEM = f"struct<s: int, w: float, sig: int, a: int, b: int, type: string, start: int, end: int, slots: {SLOTS}>"


def slots(given: dict[str, Column] | None = None) -> Column:
    """The struct of what an evidence names."""
    return F.struct(*[(given or {}).get(k, F.lit(None)).cast("string").alias(k) for k in U.SLOTS])


def url_evidence(messages: DataFrame, pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> DataFrame:
    """msg_id, url_evidence: the evidence of all links of a message in order; messages without any are left out. The links of
    a column html, where there is one, follow those of the text."""
    links = U.extract(messages, pack)
    if "html" in messages.columns:
        after = F.lit(1 << 24)
        shown = anchors.links(messages.select("msg_id", "html", F.lit(None).cast("string").alias("url"))).withColumn("ord", F.col("ord") + after)
        links = links.withColumn("display_text", F.lit(None).cast("string")).unionByName(shown)
    ensure_checkpoint_dir(messages.sparkSession)
    links = links.checkpoint()  # asked for their hosts and again for their evidence: texts are searched once
    found = U.evidence(links, U.host_facts(links, pack.suffix_rows(messages.sparkSession), pack, ages), pack)
    return found.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "type", "severity", "start", "end", "slots"))).alias("url_evidence"))


def signals(messages: DataFrame, pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> DataFrame:
    """Analyzed messages with url_evidence (array in order), sender and pattern evidence and the three weights."""
    base, per = analyzed(messages, pack), url_evidence(messages, pack, ages)
    out = base.join(per, "msg_id", "left").withColumn("url_evidence", F.coalesce("url_evidence", F.array().cast(f"array<{URL_ITEM}>")))
    mismatch = {"claimed_brand": F.get("claims.name", F.lit(0)), "header_brands": header_names(header_body(F.col("sender_hint")), pack)}
    out = out.withColumn("sender_slots", F.when(F.col("sender") == "DLT_HEADER_MISMATCH", slots(mismatch)).otherwise(slots()))
    sender_severity = F.coalesce(*[F.when(F.col("sender") == t, F.lit(s)) for t, s in SENDER_SEVERITY.items()])
    url_severity = F.array_max(F.col("url_evidence.severity"))
    return (
        out.withColumn("sender_severity", sender_severity)
        .withColumn("url_weight", severity_weight(url_severity))
        .withColumn("sender_weight", severity_weight(F.col("sender_severity")))
        .withColumn("forced", F.coalesce((url_severity == 2) & (F.size("claimed") > 0), F.lit(False)) | F.coalesce(F.col("sender_severity") == 2, F.lit(False)))
    )


def fuse(df: DataFrame) -> DataFrame:
    """Adds score (float), verdict, confidence.

    With a model signal (column ``model``) its share counts and a high score is SCAM. Without one the shares of the rest
    are scaled up and SCAM needs force.
    """
    rest = f32(rules.URL_SHARE) * F.col("url_weight") + f32(rules.SENDER_SHARE) * F.col("sender_weight") + f32(rules.PATTERN_SHARE) * F.col("pattern_weight")
    total = f32(rules.URL_SHARE) + f32(rules.SENDER_SHARE) + f32(rules.PATTERN_SHARE)
    alone = (rest / total).cast("float")
    has_model = "model" in df.columns
    if has_model:
        p = F.col("model.weight").cast("float")
        score = F.when(p.isNull(), alone).otherwise((f32(rules.MODEL_SHARE) * p + rest).cast("float"))
    else:
        p, score = F.lit(None).cast("float"), alone
    df = df.withColumn("score", score)
    s = F.col("score")
    scam = p.isNotNull() & (s >= f32(rules.SCAM_FROM))
    suspicious = s >= f32(rules.SUSPICIOUS_FROM)
    verdict = F.when(F.col("forced") | scam, "SCAM").when(suspicious, "SUSPICIOUS").otherwise("SAFE")
    sure = (
        F.when(F.col("forced"), "HIGH")
        .when(scam, F.when(s >= f32(rules.SCAM_HIGH_FROM), "HIGH").otherwise("MEDIUM"))
        .when(suspicious, F.when(s >= f32(rules.MEDIUM_FROM), "MEDIUM").otherwise("LOW"))
        .otherwise(F.when(s <= f32(rules.SAFE_HIGH_TO), "HIGH").otherwise("LOW"))
    )
    return df.withColumn("verdict", verdict).withColumn("confidence", sure)


def ordered_evidence(df: DataFrame) -> DataFrame:
    """Adds evidence: array<struct<rank keys, type, severity>>, gravest first, then heavier signals, then in order of finding."""
    no = F.lit(None).cast("int")

    def item(sev, w, sig, a, b, t, start=no, end=no, named=None):
        return F.struct((-sev).alias("s"), (-w).alias("w"), F.lit(sig).alias("sig"), a.alias("a"), b.alias("b"), t.alias("type"), start.alias("start"), end.alias("end"), (slots() if named is None else named).alias("slots"))

    url = F.transform("url_evidence", lambda e: item(e["severity"], F.col("url_weight"), 0, e["ord"], e["pos"], e["type"], e["start"], e["end"], e["slots"]))
    sender = F.when(F.col("sender").isNotNull(), F.array(item(F.col("sender_severity"), F.col("sender_weight"), 1, F.lit(0), F.lit(0), F.col("sender"), named=F.col("sender_slots")))).otherwise(F.array().cast(f"array<{ITEM}>"))
    pattern = F.transform("fired", lambda e: item(e["severity"], F.col("pattern_weight"), 2, e["ord"], F.lit(0), e["type"]))
    parts = [url, sender, pattern]
    if "model" in df.columns:
        m = F.col("model")
        parts.append(F.when(m["type"].isNotNull(), F.array(item(m["severity"], m["weight"].cast("float"), 3, F.lit(0), F.lit(0), m["type"]))).otherwise(F.array().cast(f"array<{ITEM}>")))
    return df.withColumn("evidence", F.array_sort(F.concat(*parts)))


def evidence_rows(df: DataFrame) -> DataFrame:
    """msg_id, rank (from 1), e: a row for each of the ordered evidence. An inner explode would push the size of the evidence, and with
    it the whole evidence and the model, below as a filter that is evaluated besides."""
    each = ordered_evidence(df).select("msg_id", F.posexplode_outer("evidence").alias("rank", "e"))
    return each.where("rank is not null").select("msg_id", (F.col("rank") + 1).alias("rank"), "e")


KYC_URL = ["TYPOSQUAT_OF_KNOWN_BRAND", "HOMOGRAPH_CHARACTERS", "NON_HTTPS_CREDENTIAL_PAGE", "IP_ADDRESS_HOST"]
KYC_SENDER = ["UNREGISTERED_NUMERIC_SENDER", "DLT_HEADER_MISMATCH"]


def all_hints(df: DataFrame, pack: Pack = BUILT_IN) -> Column:
    """array<struct<category, ord, hint>> of a message, in the order that decides ties."""
    rows = []
    kyc = F.when(F.arrays_overlap(F.col("url_evidence.type"), F.array(*map(F.lit, KYC_URL))), F.struct(F.lit("KYC_PHISHING").alias("category"), F.lit(0).alias("ord"), f32(rules.KYC_HINT).alias("hint")))
    rows.append(kyc)
    rows.append(F.when(F.col("sender").isin(KYC_SENDER), F.struct(F.lit("KYC_PHISHING").alias("category"), F.lit(1).alias("ord"), f32(rules.KYC_HINT).alias("hint"))))
    at = 2
    for i, rule in enumerate(pack.patterns):
        for cat, h in rule[7].items():
            rows.append(F.when(F.array_contains(F.col("fired.ord"), F.lit(i)), F.struct(F.lit(cat).alias("category"), F.lit(at).alias("ord"), f32(h).alias("hint"))))
            at += 1
    if "model" in df.columns:  # its hint counts for a part, and comes last
        weighted = (F.col("model.hint") * CATEGORY_WEIGHT).cast("float")
        rows.append(F.when(F.col("model").isNotNull(), F.struct(F.col("model.category").alias("category"), F.lit(at).alias("ord"), weighted.alias("hint"))))
    return F.array_compact(F.array(*rows))


def hints(df: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, category, ord, hint: one row for each hint, in the order that decides ties."""
    return df.select("msg_id", F.explode_outer(all_hints(df, pack)).alias("h")).where("h is not null").select("msg_id", "h.*")


def categorised(df: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """``df`` with category, category_confidence: the largest summed hint, first met on ties; SAFE is NOT_SCAM. The hints of a message
    are few and summed in its row, so messages are analysed once."""

    def best(hs: Column) -> Column:
        def total(c: Column) -> Column:
            return F.round(F.aggregate(F.filter(hs, lambda h: h["category"].eqNullSafe(c)), F.lit(0.0), lambda a, h: a + F.coalesce(h["hint"].cast("double"), F.lit(0.0))), 6)

        met = F.array_distinct(F.transform(hs, lambda h: h["category"]))
        return F.array_max(F.transform(met, lambda c, i: F.struct(total(c).alias("total"), (-i).alias("f"), c.alias("category"))))

    out = df.withColumn("_best", bound(all_hints(df, pack), best))
    safe, found = F.col("verdict") == "SAFE", F.col("_best")
    sure = F.when(safe, "HIGH").when(found.isNull(), "LOW").when(found["total"] >= 0.7, "HIGH").when(found["total"] >= 0.4, "MEDIUM").otherwise("LOW")
    return out.withColumns({"category": F.when(safe, "NOT_SCAM").otherwise(F.coalesce(found["category"], F.lit("OTHER_SCAM"))), "category_confidence": sure}).drop("_best")


def categories(df: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, verdict, category, category_confidence."""
    return categorised(df, pack).select("msg_id", "verdict", "category", "category_confidence")


def worded(template: str, named: Column) -> Column:
    """A template with what an evidence names in its places."""
    return reduce(lambda text, k: F.replace(text, F.lit(f"{{{k}}}"), F.coalesce(named[k], F.lit(""))), re.findall(r"\{(\w+)\}", template), F.lit(template))


def evidence_text(e: Column) -> Column:
    """The sentence of an evidence (type, slots); null for an unknown type."""
    aged = [F.when((e["type"] == t) & e["slots"]["age_days"].isNotNull(), worded(s, e["slots"])) for t, s in rules.AGED.items()]
    return F.coalesce(*aged, *[F.when(e["type"] == t, worded(s, e["slots"])) for t, s in rules.TEMPLATES.items()])


def explained(df: DataFrame) -> DataFrame:
    """msg_id, verdict, top1..top3 (texts), remaining, n_actions."""
    texts = F.transform("evidence", evidence_text)
    return df.select("msg_id", "verdict", *[F.get(texts, F.lit(i)).alias(f"top{i + 1}") for i in range(3)], F.greatest(F.size("evidence") - 3, F.lit(0)).alias("remaining"), F.when(F.col("verdict") == "SAFE", 0).otherwise(5).alias("n_actions"))


def actions(verdict: Column, category: Column) -> Column:
    """What to do, as texts: a lead-in of the category and what always holds; nothing for SAFE."""
    lead = F.coalesce(*[F.when(category == c, F.lit(t)) for c, t in rules.LEAD_INS.items()])
    steps = F.array_compact(F.concat(F.array(lead), F.array(*map(F.lit, rules.ACTIONS))))
    return F.when(verdict == "SAFE", F.array().cast("array<string>")).otherwise(steps)


def presented(df: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, headline, colour, confidence_text, actions of each verdict."""
    own = categorised(df, pack).select("msg_id", "verdict", "confidence", "category")
    words = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in table.items()])
    return own.select("msg_id", words("verdict", rules.HEADLINES).alias("headline"), words("verdict", rules.COLOURS).alias("colour"), words("confidence", rules.CONFIDENCE_TEXTS).alias("confidence_text"), actions(F.col("verdict"), F.col("category")).alias("actions"))


def results(df: DataFrame, pack_version: str, model_version: str | None = None) -> DataFrame:
    """msg_id, verdict, analyzers (those that ran, in order), versions and latency_ms (from received_at_ms to
    done_at_ms where the messages have them, else null)."""
    ran = ["PATTERN", "SENDER", "URL"] + (["CLASSIFIER"] if "model" in df.columns else [])
    times = {"received_at_ms", "done_at_ms"} <= set(df.columns)
    latency = F.col("done_at_ms") - F.col("received_at_ms") if times else F.lit(None).cast("long")
    return df.select("msg_id", "verdict", F.array(*map(F.lit, sorted(ran))).alias("analyzers"), F.lit(pack_version).alias("pack_version"), F.lit(model_version).cast("string").alias("model_version"), latency.alias("latency_ms"))


def verdicts(messages: DataFrame, temperature: float | None = None, pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> DataFrame:
    """Signals and verdict of each message; with ``temperature`` the model signal takes part."""
    found = signals(messages, pack, ages)
    return fuse(found if temperature is None else scored(found, temperature))
