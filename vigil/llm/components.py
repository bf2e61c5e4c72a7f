"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``links`` (a, b).

    Each round replaces links by links to smaller nodes: stars grow until every node hangs on the smallest of
    its component. A round groups and joins by node, keeps nothing but links, and ends in staged files.
    Empty links give no rows; self-links and repeated links are harmless.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        lower = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        root = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(root, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = staged(small.union(root.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "stars")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
