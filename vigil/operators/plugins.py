"""Analyzers as plug-ins: each takes messages and adds one signal, and none can spoil the others' verdict.

A plug-in is a function from a DataFrame to the same rows with one column more, a signal: its weight, whether it forces the
verdict, its evidence, and a reason if it is unavailable for the row. A plug-in that cannot even be planned (a missing model, a
file that does not read) is unavailable for every row; one that fails on a row is unavailable for that row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import normalize
from vigil.operators.analyzers import analyzed, claimed_brands, sender_evidence
from vigil.operators.scoring import scored
from vigil.plans import verdict as V
from vigil.sources import rules
from vigil.sources.rules import BUILT_IN, Pack

SIGNAL = "struct<weight: float, forced: boolean, evidence: array<struct<type: string, severity: int>>, reason: string>"
Plugin = Callable[[DataFrame, str], DataFrame]
#: The analyzers that fusion weighs.
URL, SENDER, PATTERN, CLASSIFIER = "URL", "SENDER", "PATTERN", "CLASSIFIER"
SHARES = {CLASSIFIER: rules.MODEL_SHARE, URL: rules.URL_SHARE, SENDER: rules.SENDER_SHARE, PATTERN: rules.PATTERN_SHARE}


def signal(weight: Column, forced: Column, evidence: Column, reason: Column | None = None) -> Column:
    return F.struct(weight.cast("float").alias("weight"), F.coalesce(forced, F.lit(False)).alias("forced"), evidence.cast("array<struct<type: string, severity: int>>").alias("evidence"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"))


def unavailable(reason: Column) -> Column:
    return F.struct(F.lit(None).cast("float").alias("weight"), F.lit(False).alias("forced"), F.array().cast("array<struct<type: string, severity: int>>").alias("evidence"), reason.cast("string").alias("reason"))


def guarded(analyze: Callable[[str | None, str | None], dict]) -> Plugin:
    """A plug-in from a Python function of (text, sender_hint) that gives weight, and if it likes forced and evidence (type,
    severity). What it raises for a row is that row's reason; Arrow brings the rows in batches."""

    def one(text, hint) -> dict:
        try:
            got = analyze(text, hint)
            return {"weight": float(got["weight"]), "forced": bool(got.get("forced", False)), "evidence": [{"type": str(t), "severity": int(s)} for t, s in got.get("evidence", [])], "reason": None}
        except Exception as e:  # whatever a plug-in does, the row keeps its other signals
            return {"weight": None, "forced": False, "evidence": [], "reason": str(e) or type(e).__name__}

    @F.pandas_udf(SIGNAL)
    def run(texts: pd.Series, hints: pd.Series) -> pd.DataFrame:
        rows = [one(None if t is None or t is pd.NA else t, None if h is None or h is pd.NA else h) for t, h in zip(texts, hints, strict=True)]
        return pd.DataFrame(rows, columns=["weight", "forced", "evidence", "reason"])

    return lambda messages, name: messages.withColumn(name, run(F.col("text"), F.col("sender_hint")))


def url_plugin(pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> Plugin:
    def run(messages: DataFrame, name: str) -> DataFrame:
        per = V.url_evidence(messages, pack, ages)
        on = messages.join(per, "msg_id", "left").withColumn("_claimed", F.size(claimed_brands(F.col("text"), pack)) > 0)
        worst = F.array_max(F.col("url_evidence.severity"))
        items = F.transform("url_evidence", lambda e: F.struct(e["type"].alias("type"), e["severity"].alias("severity")))
        return on.withColumn(name, signal(V.severity_weight(worst), (worst == 2) & F.col("_claimed"), F.coalesce(items, F.array().cast("array<struct<type: string, severity: int>>")))).drop("url_evidence", "_claimed")

    return run


def sender_plugin(pack: Pack = BUILT_IN) -> Plugin:
    def run(messages: DataFrame, name: str) -> DataFrame:
        kind = sender_evidence(F.col("sender_hint"), claimed_brands(F.col("text"), pack), pack)
        on = messages.withColumn("_kind", kind)
        severity = F.coalesce(*[F.when(F.col("_kind") == t, F.lit(s)) for t, s in V.SENDER_SEVERITY.items()])
        items = F.when(F.col("_kind").isNotNull(), F.array(F.struct(F.col("_kind").alias("type"), severity.alias("severity")))).otherwise(F.array().cast("array<struct<type: string, severity: int>>"))
        return on.withColumn(name, signal(V.severity_weight(severity), severity == 2, items)).drop("_kind")

    return run


def pattern_plugin(pack: Pack = BUILT_IN) -> Plugin:
    def run(messages: DataFrame, name: str) -> DataFrame:
        found = analyzed(messages, pack)
        items = F.transform("fired", lambda e: F.struct(e["type"].alias("type"), e["severity"].alias("severity")))
        return found.withColumn(name, signal(F.col("pattern_weight"), F.lit(False), items)).select(*messages.columns, name)

    return run


def model_plugin(temperature: float, score=scored) -> Plugin:
    """The model signal; ``score`` adds a column model to messages with a column normalized."""

    def run(messages: DataFrame, name: str) -> DataFrame:
        on = score(messages.withColumn("normalized", normalize(F.col("text"))), temperature)
        m = F.col("model")
        items = F.when(m["type"].isNotNull(), F.array(F.struct(m["type"].alias("type"), m["severity"].alias("severity")))).otherwise(F.array().cast("array<struct<type: string, severity: int>>"))
        return on.withColumn(name, signal(m["weight"], F.lit(False), items)).select(*messages.columns, name)

    return run


def built_in(pack: Pack = BUILT_IN, ages: DataFrame | None = None) -> dict[str, Plugin]:
    return {URL: url_plugin(pack, ages), SENDER: sender_plugin(pack), PATTERN: pattern_plugin(pack)}


def orchestrated(messages: DataFrame, plugins: dict[str, Plugin]) -> DataFrame:
    """``messages`` (msg_id, text, sender_hint, ...) with signals: map of each plug-in's id to its signal."""
    df, names = messages, {k: f"_signal_{i}" for i, k in enumerate(plugins)}
    for k, plugin in plugins.items():
        try:
            df = plugin(df, names[k])
            df.schema  # noqa: B018  a plan that does not resolve fails here
        except Exception as e:
            df = df.withColumn(names[k], unavailable(F.lit(str(e).split("\n")[0] or type(e).__name__)))
    pairs = [x for k in plugins for x in (F.lit(k), F.col(names[k]).cast(SIGNAL))]
    return df.withColumn("signals", F.create_map(*pairs)).drop(*names.values())


def fused(df: DataFrame) -> DataFrame:
    """msg_id, verdict, confidence, score, analyzers (all that were asked), scored (those that gave a signal), unavailable
    (id, reason) of messages with signals.

    What is unavailable weighs nothing; without the classifier the shares of the rest are scaled up and SCAM needs force.
    """
    entries = F.map_entries("signals")
    order = lambda a: F.array_sort(F.transform(a, lambda e: e["key"]))
    gave = F.filter(entries, lambda e: e["value"]["reason"].isNull() & e["value"]["weight"].isNotNull())
    failed = F.filter(entries, lambda e: e["value"]["reason"].isNotNull() | e["value"]["weight"].isNull())
    weight = lambda k: F.coalesce(F.try_element_at("signals", F.lit(k))["weight"], V.f32(0))
    on = df.withColumns({"url_weight": weight(URL), "sender_weight": weight(SENDER), "pattern_weight": weight(PATTERN)})
    on = on.withColumn("model", F.struct(F.try_element_at("signals", F.lit(CLASSIFIER))["weight"].alias("weight")))
    on = on.withColumn("forced", F.exists(entries, lambda e: F.coalesce(e["value"]["forced"], F.lit(False)) & e["value"]["reason"].isNull()))
    return V.fuse(on).select("msg_id", "verdict", "confidence", "score", order(entries).alias("analyzers"), order(gave).alias("scored"), F.transform(failed, lambda e: F.struct(e["key"].alias("id"), F.coalesce(e["value"]["reason"], F.lit("no weight")).alias("reason"))).alias("unavailable"))
