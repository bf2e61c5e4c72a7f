"""Constraints of rule tables and dataset rows, each as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sources import rules


def duplicate_aliases(brands: DataFrame) -> DataFrame:
    """alias, owners: aliases (whatever their case) of more than one brand."""
    a = brands.select("brand_id", F.explode("aliases").alias("alias"))
    return a.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("brand_id").alias("owners")).where("owners > 1")


def unknown_brands(operated: DataFrame, brands: DataFrame) -> DataFrame:
    """domain, brand_id of links that a brand outside the table operates."""
    return operated.join(brands.select("brand_id"), "brand_id", "left_anti").select("domain", "brand_id")


def row_violations(rows: DataFrame) -> DataFrame:
    """id, message: labels and categories of dataset rows that contradict each other."""
    langs = ["EN", "HI", "HI_LATN", "BN", "TA", "TE", "MR", "UNKNOWN"]
    found = F.array_compact(
        F.array(
            F.when(~F.col("lang").isin(langs) | F.col("lang").isNull(), "lang"),
            F.when(F.col("label").isNotNull() & ~F.col("label").isin(0, 1), "label"),
            F.when(F.col("label").isNotNull() & F.col("category").isNull(), "category missing"),
            F.when(~F.col("category").isin(rules.CATEGORIES), "category"),
            F.when((F.col("label") == 0) & (F.col("category") != "NOT_SCAM") | (F.col("label") == 1) & (F.col("category") == "NOT_SCAM"), "label and category"),
        )
    )
    return rows.select("id", F.explode(found).alias("message"))


def assert_valid(rows: DataFrame) -> None:
    bad = row_violations(rows).limit(1).collect()
    if bad:
        raise ValueError(f"row {bad[0]['id']}: {bad[0]['message']}")
