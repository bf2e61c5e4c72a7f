"""Evaluation: class metrics, confusion, calibration, parity, latency and audit figures, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.selection import MOST, bottom, places

#: Fixed value: what the 95th percentile of a verdict without a model may take, in milliseconds.
LATENCY_BUDGET_MS = 50.0
# Least recall of the positive class, most false positives among genuine hard negatives
LEAST_RECALL, MOST_FPR = 0.93, 0.03


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary(df: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1 of both classes and macro_f1 over ``y`` and ``pred``; empty denominators give 0."""
    n = lambda c: F.count_if(c)
    y, p = F.col("y"), F.col("pred")
    agg = df.groupBy(*by).agg(n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 1) & (p == 0)).alias("fn"), n((y == 0) & (p == 0)).alias("tn"))
    for c, (t, f, m) in {1: ("tp", "fp", "fn"), 0: ("tn", "fn", "fp")}.items():
        agg = agg.withColumn(f"precision_{c}", ratio(F.col(t), F.col(t) + F.col(f))).withColumn(f"recall_{c}", ratio(F.col(t), F.col(t) + F.col(m))).withColumn(f"f1_{c}", ratio(2 * F.col(t), 2 * F.col(t) + F.col(f) + F.col(m)))
    cols = [f"{m}_{c}" for c in (0, 1) for m in ("precision", "recall", "f1")]
    return agg.select(*by, *[F.round(c, 6).alias(c) for c in cols], F.round((F.col("f1_0") + F.col("f1_1")) / 2, 6).alias("macro_f1"))


def confusion(df: DataFrame, labels: DataFrame) -> DataFrame:
    """actual, predicted, n for every pair of ``labels`` (label; a bounded list such as the categories), zero where none."""
    grid = labels.select(F.col("label").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    got = df.groupBy(F.col("y").alias("actual"), F.col("pred").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(got, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_language(df: DataFrame, languages: list[str]) -> DataFrame:
    """lang, macro_f1 for each of ``languages`` (without UNKNOWN); null for a language without rows."""
    asked = df.sparkSession.createDataFrame([(x,) for x in languages if x != "UNKNOWN"], "lang string")
    return asked.join(binary(df, "lang").select("lang", "macro_f1"), "lang", "left")


def targets(df: DataFrame) -> DataFrame:
    """recall of label 1, fpr on genuine rows marked is_hard_negative, and whether each meets its target; null where there are no such rows."""
    y, p, hard = F.col("y"), F.col("pred"), F.col("is_hard_negative") & (F.col("y") == 0)
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double"))
    got = df.agg(F.round(share((y == 1) & (p == 1), y == 1), 6).alias("recall"), F.round(share(hard & (p == 1), hard), 6).alias("fpr"))
    return got.select("recall", "fpr", (F.col("recall") >= LEAST_RECALL).alias("recall_met"), (F.col("fpr") <= MOST_FPR).alias("fpr_met"))


def nearest_rank(df: DataFrame, value: str, *by: str, most: int = MOST) -> DataFrame:
    """p50 at index n // 2 and p95 at index min(int(0.95 n), n - 1) of the sorted values, without interpolation."""
    n = F.col("n")
    return places(df, value, list(by), {"p50": F.floor(n / 2), "p95": F.least(F.floor(n * 95 / 100), n - 1)}, most)


def within_budget(df: DataFrame, value: str, *by: str, budget: float = LATENCY_BUDGET_MS) -> DataFrame:
    """``by``, n, p95 (nearest rank), and whether it stays under ``budget``; groups without values have none."""
    return nearest_rank(df, value, *by).select(*by, "n", "p95", (F.col("p95") < budget).alias("passed"))


def nll(df: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, nll: mean cross-entropy of two logits (z0, z1) against y for each temperature."""
    t = F.explode(F.array(*map(F.lit, temperatures)))
    a = df.select("z0", "z1", "y", t.alias("temperature"))
    s0, s1 = F.col("z0") / F.col("temperature"), F.col("z1") / F.col("temperature")
    top = F.greatest(s0, s1)
    loss = F.log(F.exp(s0 - top) + F.exp(s1 - top)) + top - F.when(F.col("y") == 1, s1).otherwise(s0)
    return a.groupBy("temperature").agg(F.round(F.avg(loss), 6).alias("nll"))


def parity(df: DataFrame, limit: float = 0.02) -> DataFrame:
    """max_delta between columns a and b, and whether it stays under ``limit``; no rows pass."""
    d = F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0))
    return df.agg(F.round(d, 6).alias("max_delta"), (d < limit).alias("passed"))


def audit_sample(rows: DataFrame, fraction: float, seed: int = 0, most: int = MOST) -> DataFrame:
    """max(1, round half even(n x fraction)) rows by hash order; none of none."""
    n = rows.count()
    k = max(1, round(n * fraction)) if n else 0
    return bottom(rows, f"{seed}:", {None: k}, most=most)
