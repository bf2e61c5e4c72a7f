"""Links in messages: extraction, host facts, and the checks that give evidence.

Facts of a host are computed once for each distinct host and joined back.
"""

from __future__ import annotations

import re
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import bound, spans
from vigil.operators.bloom import known_to
from vigil.plans.staging import BROADCAST_ROWS, bounded, ensure_checkpoint_dir
from vigil.sources import rules
from vigil.sources.rules import BUILT_IN, Pack

#: What an evidence may name.
SLOTS = ["host", "tld", "actual", "brand", "real_domain", "displayed", "path", "domain", "age_days", "claimed_brand", "header_brands"]
# The grammar of links, labels and dotted quads
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
PATH = r"(?:/[^\s<>\"'\x{A0}]*)?"
BEFORE_DOT = r"(?=[\p{L}\p{N}-]{1,63}+\.)"  # what a first label needs, seen without going back
CANDIDATE = rf"https?://[^\s<>\"'\x{{A0}}]+|www\.{LABEL}(?:\.{LABEL})+{PATH}|{BEFORE_DOT}{LABEL}(?:\.{LABEL})+{PATH}"
#: What every candidate holds; texts without it are not searched.
MAY_HOLD = r"://|[\p{L}\p{N}]\.[\p{L}\p{N}]"
QUAD = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def is_ip(host: Column) -> Column:
    return host.rlike(QUAD) | (host.rlike(r"^\[?[0-9A-Fa-f:.]+\]?$") & host.contains(":"))


def extract(messages: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, ord, raw, scheme, host, path, start, end (from 0, exclusive, in the text as it came), punycode (whether
    a label of the host is in that form) of each link of ``messages`` (msg_id, text)."""
    pattern = rf"(?iu)(?<![\w@.])({CANDIDATE})"
    dotted = F.contains("text", F.lit(".")) | F.contains("text", F.lit("://"))
    some = F.when(dotted & F.col("text").rlike(MAY_HOLD), F.col("text"))  # of a null there are no spans
    rows = messages.select("msg_id", F.posexplode(spans(some, pattern)).alias("ord", "at"))
    rows = rows.select("msg_id", "ord", F.col("at.found").alias("raw"), "at.start", "at.end")
    has_scheme = F.col("raw").contains("://")
    rest = F.when(has_scheme, F.expr("substr(raw, instr(raw, '://') + 3)")).otherwise(F.col("raw"))
    rest = F.when(rest.contains("@"), F.regexp_replace(rest, "^[^/?#@]*@", "")).otherwise(rest)
    rows = rows.select("msg_id", "ord", "raw", "start", "end", F.when(has_scheme, F.substring_index("raw", "://", 1)).alias("scheme"), F.regexp_extract(rest, "^([^/?#:]*)", 1).alias("host"), F.nullif(F.regexp_extract(rest, "(?s)^[^/?#:]*(.*)$", 1), F.lit("")).alias("path"))
    bare = F.col("scheme").isNull() & ~F.lower("raw").startswith("www.")
    plain = [s for s in pack.suffixes if "." not in s]
    # a bare host counts only if its last label is a known top level
    rows = rows.withColumn("punycode", F.exists(F.split(F.lower("host"), r"\."), lambda x: x.startswith("xn--")))
    return rows.where((F.col("host") != "") & (~bare | F.lower(F.substring_index("host", ".", -1)).isin(plain)))


def registrable(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host, registrable: the public suffix and one label more; null for addresses and bare suffixes; original: the
    same labels in the host's own script.

    Exceptions win, then the longest of plain and wildcard rules, then the last label.
    """
    ascii_host = F.rtrim(F.lower(F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.col("host"), F.lit(1)), "host")), F.lit("."))
    own = F.split(F.rtrim(F.lower("host"), F.lit(".")), r"\.")
    base = hosts.select("host", F.split(ascii_host, r"\.").alias("labels"), own.alias("own"), is_ip(F.col("host")).alias("ip"))
    tails = base.select("host", F.size("labels").alias("n"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"), "labels").select("host", "k", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("suffix"))
    hit = tails.join(F.broadcast(suffixes), "suffix")  # the rule list is a bounded file
    taken = F.when(F.col("kind") == "exception", F.col("k") - 1 + 1000).when(F.col("kind") == "wildcard", F.col("k") + 1).otherwise(F.col("k"))
    best = hit.groupBy("host").agg(F.max(taken).alias("t"))
    n = F.when(F.coalesce("t", F.lit(1)) >= 1000, F.col("t") - 1000).otherwise(F.coalesce("t", F.lit(1)))
    out = base.join(best, "host", "left").select("host", "labels", "own", "ip", n.alias("n"))
    named = ~F.col("ip") & (F.size("labels") > F.col("n"))
    tail = lambda c: F.array_join(F.slice(c, -F.least(F.col("n") + 1, F.size(c)), F.col("n") + 1), ".")
    return out.select("host", F.when(named, tail("labels")).alias("registrable"), F.when(named, tail("own")).alias("original"))


def fold(label: Column, pack: Pack = BUILT_IN) -> Column:
    """Look-alike characters, then look-alike sequences, folded to plain letters."""
    out = F.translate(label, "".join(pack.single_folds), "".join(pack.single_folds.values()))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pack.sequence_folds, out)


def squash(label: Column) -> Column:
    return F.regexp_replace(label, r"[-._\p{Nd}]", "")


def mixed_script(label: Column) -> Column:
    return label.rlike(r"\p{IsLatin}") & label.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]")


def distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours cost one, no part is edited twice. A dynamic
    programme over the characters of ``a``, which keeps the last two rows."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j)
    none = F.array().cast("array<int>")

    def step(s: Column, x: Column, other: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:  # j from 1
            c = F.get(other, j - 1)
            edit = F.least(F.get(s["last"], j) + 1, F.get(new, j - 1) + 1, F.get(s["last"], j - 1) + F.when(x == c, 0).otherwise(1))
            swap = (j > 1) & (F.size(s["before"]) > 0) & (x == F.get(other, j - 2)) & (s["char"] == c)
            return F.least(edit, F.when(swap, F.get(s["before"], j - 2) + 1))

        new = F.aggregate(F.filter(F.sequence(F.lit(0), F.size(other)), lambda j: j > 0), F.array(F.get(s["last"], F.lit(0)) + 1), lambda n, j: F.concat(n, F.array(cell(n, j))))
        return F.struct(s["last"].alias("before"), new.alias("last"), x.alias("char"))

    run = lambda other: F.aggregate(chars(a), F.struct(none.alias("before"), row.alias("last"), F.lit("").alias("char")), lambda s, x: step(s, x, other), lambda s: F.element_at(s["last"], -1))
    return bound(chars(b), run)


def within(a: Column, b: Column, budget: Column) -> Column:
    """Whether the distance is within ``budget``. The built-in one allows no swaps, so it is at most twice as large: it
    decides most pairs, and only those in between need the exact one."""
    plain = F.levenshtein(a, b)
    return F.when(plain <= budget, True).when(plain > 2 * budget, False).otherwise(distance(a, b) <= budget)


def deletions(label: Column, most: int) -> Column:
    """All strings that up to ``most`` deletions leave of ``label``, itself included. Two labels within a distance of
    ``most`` have one of them in common: an edit or a swap is undone by one deletion on either side."""

    def shorter(some: Column) -> Column:
        drop = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: i > 0), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.array_distinct(F.concat(some, F.flatten(F.transform(some, drop))))

    out = F.array(label)
    for _ in range(most):
        out = bound(out, shorter)
    return out


def typosquat(labels: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """label, brand_id, known, domain: the first brand domain that each label imitates; labels without one are left out.

    A known label is never a hit. Pairs meet by equal keys alone: what deletions leave of both, both without
    separators and digits, or the known label inside the other, which one regular expression finds.
    """
    known = pack.brand_domains()
    spark = labels.sparkSession
    k = spark.createDataFrame(known, "ord int, brand_id string, domain string, known string")
    own = sorted({x[3] for x in known})
    asked = labels.where(~F.col("label").isin(own) & (F.col("label") != "")).select("label").distinct()
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label")  # few bytes, much work: not to be coalesced
    if not own:
        return asked.limit(0).select("label", *[F.lit(None).cast("string").alias(c) for c in ("brand_id", "known", "domain")])
    most = max(pack.short_distance, pack.long_distance)
    budget = F.when(F.length("known") <= pack.short_label, pack.short_distance).otherwise(pack.long_distance)
    n_keys = sum(comb(len(x[3]), i) for x in known for i in range(most + 1))
    fit = F.length("label").between(min(map(len, own)) - most, max(map(len, own)) + most)  # others are too far from every known one
    left = k.select("*", budget.alias("budget"), F.explode(deletions(F.col("known"), most)).alias("key"))
    met = asked.where(fit).select("label", F.explode(deletions(F.col("label"), most)).alias("key")).join(bounded(left, n_keys), "key")
    near = met.select("label", "ord", "brand_id", "known", "domain", "budget").distinct().where(within(F.col("label"), F.col("known"), F.col("budget"))).drop("budget")
    bare = asked.withColumn("key", squash(F.col("label"))).join(bounded(k.withColumn("key", squash(F.col("known"))), len(known)), "key").select("label", "ord", "brand_id", "known", "domain")
    long = [x for x in own if len(x) >= rules.LEAST_CONTAINED]
    holds = asked.limit(0).select("label", F.lit("").alias("known"))
    if long:
        some = F.col("label").rlike("|".join(re.escape(x) for x in sorted(long, key=len)))
        holds = asked.where(some).select("label", F.explode(F.filter(F.array(*map(F.lit, long)), lambda x: F.contains("label", x))).alias("known"))
    inside = holds.join(bounded(k, len(known)), "known").select("label", "ord", "brand_id", "known", "domain")
    hits = near.unionByName(bare).unionByName(inside)
    return hits.groupBy("label").agg(F.min_by(F.struct("brand_id", "known", "domain"), "ord").alias("h")).select("label", "h.*")


def host_facts(hosts: DataFrame, suffixes: DataFrame, pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> DataFrame:
    """host, ip, registrable, original, label, tld, squat, squat_domain, mixed, shortener, bad_tld, age_days, unknown_age of
    each distinct host.

    Look-alikes are sought in the label as it was written, lists are asked for the registrable name in ASCII form.
    ``ages`` (domain, age_days) says how old some domains are. Of others the pack's reputation says whether they are
    established; if the pack has none, nothing is said of them.
    """
    spark = hosts.sparkSession
    ensure_checkpoint_dir(spark)  # distinct hosts, and what is known of their names, are asked several times
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = registrable(hosts.select("host").distinct().repartition(parts, "host").checkpoint(), suffixes)
    base = base.select("host", is_ip(F.col("host")).alias("ip"), "registrable", "original", F.substring_index("original", ".", 1).alias("label"), F.substring_index("registrable", ".", -1).alias("tld"))
    base = base.withColumn("folded", fold(F.col("label"), pack)).checkpoint()
    both = base.select("label").union(base.select(F.col("folded").alias("label"))).where("label is not null").distinct()
    hit = typosquat(both, pack).select("label", F.struct("brand_id", "domain").alias("squat")).checkpoint()
    known = pack.brand_domains()
    raw, folded = hit.withColumnRenamed("label", "l1").withColumnRenamed("squat", "squat_raw"), hit.withColumnRenamed("label", "l2").withColumnRenamed("squat", "squat_folded")
    out = base.join(raw, base["label"] == raw["l1"], "left").join(folded, base["folded"] == folded["l2"], "left")
    changed = F.col("folded") != F.col("label")
    first = {n: (b, d) for _, b, d, n in reversed(known)}
    exact = F.coalesce(*[F.when(changed & (F.col("folded") == n), F.struct(F.lit(b).alias("brand_id"), F.lit(d).alias("domain"))) for n, (b, d) in first.items()], F.lit(None).cast("struct<brand_id: string, domain: string>"))
    squat = F.coalesce("squat_raw", exact, F.when(changed, F.col("squat_folded")))
    if ages is None:
        out = out.withColumn("age_days", F.lit(None).cast("long"))
    else:
        own = ages.groupBy(F.col("domain").alias("_domain")).agg(F.min("age_days").cast("long").alias("age_days"))
        out = out.join(own, out["registrable"] == own["_domain"], "left")
    established = F.lit(True) if pack.reputation is None else known_to(pack.reputation, F.col("registrable"))
    operated = list(pack.brand_operated)
    out = F.broadcast(out) if base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else out  # a row for each host
    return out.select(
        *["host", "ip", "registrable", "original", "label", "tld", squat["brand_id"].alias("squat"), squat["domain"].alias("squat_domain"), mixed_script(F.col("label")).alias("mixed")],
        (F.col("registrable").isin(pack.shorteners) & ~F.col("registrable").isin(operated)).alias("shortener"),
        F.col("tld").isin(pack.suspicious_tlds).alias("bad_tld"),
        "age_days",
        (F.col("age_days").isNull() & F.col("registrable").isNotNull() & ~established).alias("unknown_age"),
    )


def evidence(urls: DataFrame, facts: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, ord, pos, type, severity, start, end, slots: evidence of each link in the order of the checks. slots: what the
    explanations name. A link's display_text (links of HTML have one) must hold the domain that it leads to."""
    on = urls.join(facts, "host")  # few hosts come marked for broadcast, of many a common one is split by AQE
    named = F.col("registrable").isNotNull() & ~F.col("ip")
    names = F.coalesce(*[F.when(F.col("squat") == b[0], F.lit(b[1])) for b in pack.brands], F.col("squat"))
    shown = F.col("display_text") if "display_text" in urls.columns else F.lit(None).cast("string")
    too_new = F.col("age_days") < rules.NEW_DAYS
    checks = [
        (F.col("ip"), "IP_ADDRESS_HOST", 2, {"host": F.col("host")}),
        (named & F.col("squat").isNotNull(), "TYPOSQUAT_OF_KNOWN_BRAND", 2, {"actual": F.col("original"), "brand": names, "real_domain": F.col("squat_domain")}),
        (named & F.col("mixed"), "HOMOGRAPH_CHARACTERS", 2, {"host": F.col("host")}),
        (named & F.col("shortener"), "URL_SHORTENER", 1, {"host": F.col("host")}),
        (named & F.col("bad_tld"), "SUSPICIOUS_TLD", 1, {"tld": F.col("tld")}),
        (named & shown.isNotNull() & ~F.contains(F.lower(shown), F.lower("registrable")), "LINK_TEXT_MISMATCH", 2, {"displayed": shown, "actual": F.col("registrable")}),
        (named & (F.lower("scheme") == "http") & F.col("path").rlike(f"(?i){rules.CREDENTIAL_WORDS}"), "NON_HTTPS_CREDENTIAL_PAGE", 1, {"path": F.col("path")}),
        (named & (too_new | F.col("unknown_age")), "DOMAIN_VERY_NEW", F.when(too_new, 2).otherwise(0), {"domain": F.col("registrable"), "age_days": F.col("age_days").cast("string")}),
    ]
    slots = lambda given: F.struct(*[given.get(k, F.lit(None)).cast("string").alias(k) for k in SLOTS])
    items = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("pos"), F.lit(t).alias("type"), (s if isinstance(s, Column) else F.lit(s)).cast("int").alias("severity"), slots(g).alias("slots"))) for i, (c, t, s, g) in enumerate(checks)]))
    return on.select("msg_id", "ord", "start", "end", F.explode(items).alias("e")).select("msg_id", "ord", "e.pos", "e.type", "e.severity", "start", "end", "e.slots")
