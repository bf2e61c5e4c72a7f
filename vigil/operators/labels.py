"""Labelling, calibration fits, domain ages and run logs."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_answers(rows: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """``rows`` (id, label, category, labeled_by, labeled_at, ...) with the labels of ``answers`` (id, answer, new_category, at).

    Rows that have a label keep it, so a session resumes where it stopped; a null answer skips a row.
    """
    a = answers.where("answer in (0, 1)").select(F.col("id").alias("_id"), "answer", "new_category", "at")
    open_row = F.col("label").isNull() & F.col("answer").isNotNull()
    on = rows.join(a, F.col("id") == F.col("_id"), "left")
    put = {"label": F.col("answer"), "category": F.col("new_category"), "labeled_by": F.lit(by), "labeled_at": F.col("at")}
    return on.select(*[F.when(open_row, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in rows.columns])


def agreement(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """sampled, agreed, rate; skipped rows stay in the denominator, nothing sampled is full agreement."""
    on = rows.join(answers.select(F.col("id").alias("_id"), "answer"), F.col("id") == F.col("_id"), "left")
    agreed = F.count_if(F.col("answer") == F.col("label"))
    return on.agg(F.count("*").alias("sampled"), agreed.alias("agreed"), F.coalesce(F.try_divide(agreed.cast("double"), F.count("*").cast("double")), F.lit(1.0)).alias("rate"))


#: Trial points of a pass, passes, and the range of temperatures.
TRIALS, PASSES, COLDEST, HOTTEST = 32, 5, 0.05, 20.0


def fit_temperature(df: DataFrame, passes: int = PASSES) -> float:
    """The temperature with the least mean cross-entropy of two logits (z0, z1) against y.

    In the inverse of the temperature the loss is convex, so its slope changes sign once. A pass sums, for each of some trial
    points, the slope and how it changes; the next pass looks between the two points where the sign changes, and a
    Newton step ends the search. Five passes leave far less than 1e-4; rows that are null anywhere, or none at all, say nothing.
    """
    margin = F.when(F.col("y") == 1, F.col("z1") - F.col("z0")).otherwise(F.col("z0") - F.col("z1")).cast("double")
    base = df.where("y IS NOT NULL").select(margin.alias("m")).where("m IS NOT NULL AND NOT isnan(m)")
    low, high = math.log(1 / HOTTEST), math.log(1 / COLDEST)
    best = 0.0
    for _ in range(passes):
        at = [low + (high - low) * k / (TRIALS - 1) for k in range(TRIALS)]
        wrong = lambda b: 1 / (1 + F.exp(F.lit(b) * F.col("m")))
        sums = [x for k, u in enumerate(at) for x in (F.sum(F.col("m") * wrong(math.exp(u))).alias(f"g{k}"), F.sum(F.col("m") * F.col("m") * wrong(math.exp(u)) * (1 - wrong(math.exp(u)))).alias(f"h{k}"))]
        r = base.agg(*sums).first()
        if r["g0"] is None:
            return 1.0
        falls = [r[f"g{k}"] > 0 for k in range(TRIALS)]  # the loss still falls beyond the point
        if not falls[0] or falls[-1]:
            return HOTTEST if not falls[0] else COLDEST
        k = falls.index(False) - 1
        b, g, h = math.exp(at[k]), r[f"g{k}"], r[f"h{k}"]
        best = math.log(min(math.exp(at[k + 1]), b + g / h if h > 0 else b))
        low, high = at[k], at[k + 1]
    return math.exp(-best)


def domain_age_evidence(domains: DataFrame, ages: DataFrame, known: DataFrame) -> DataFrame:
    """domain, type, severity: under 30 days is critical, unknown age of a domain that is not ``known`` is a note, else nothing."""
    on = domains.select("domain").distinct().join(ages, "domain", "left").join(known.select("domain", F.lit(True).alias("known")), "domain", "left")
    severity = F.when(F.coalesce("known", F.lit(False)), None).when(F.col("age_days") < 30, 2).when(F.col("age_days").isNull(), 0)
    return on.select("domain", F.lit("DOMAIN_VERY_NEW").alias("type"), severity.alias("severity")).where("severity is not null")


def config_hash(config: dict) -> str:
    """Twelve hexadecimal digits that do not depend on the order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def append_run(spark, path: str, config: dict, metrics: dict) -> None:
    """One row more in the run log."""
    row = [(config_hash(config), json.dumps(config, sort_keys=True), json.dumps(metrics, sort_keys=True))]
    spark.createDataFrame(row, "config_hash string, config string, metrics string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)
