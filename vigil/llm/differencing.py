"""Operator 9: shards of near equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together. Groups are dealt into buckets by a hash; in a
bucket, each group starts as a partial partition (its size in one of the shards, zero in the others), and
the two partial partitions of largest spread are combined again and again, the largest shards of one with
the smallest of the other, until one is left. The buckets' partitions are combined in the same way, in
rounds of at most ``FAN`` partitions a task, until the last few meet. No task or driver holds more than one bucket.

Defined results: null text has no bytes (crc32 0) and is a group of its own; repeated rows count each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import running, spread, staged, table

SHARDS = 24
#: Groups in a bucket, and partial partitions that meet in one task.
BUCKET = 4_000
FAN = 256


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows) to one. Returns the sums, and each row's shard for each of its places."""
    n, k = parts.shape
    parts = parts.astype(np.int64)
    order = np.argsort(parts, axis=1, kind="stable")
    parts = np.take_along_axis(parts, order, axis=1)  # ascending
    # node: a row or a combination; up[node] = (parent, place in parent of each place)
    up: list = [None] * (2 * n - 1)
    sums = list(parts)
    heap = [(-(int(p[-1]) - int(p[0])), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        rank = np.argsort(both, kind="stable")
        place = np.empty(k, dtype=np.int16)
        place[rank] = np.arange(k)
        node = len(sums)
        sums.append(both[rank])
        sums[a] = sums[b] = None
        up[a], up[b] = (node, place), (node, place[::-1])
        heapq.heappush(heap, (-(int(sums[node][-1]) - int(sums[node][0])), node))
    root = len(sums) - 1
    final = [None] * len(sums)
    final[root] = np.arange(k, dtype=np.int16)
    for i in range(root - 1, -1, -1):
        parent, place = up[i]
        final[i] = final[parent][place]
    where = np.empty((n, k), dtype=np.int16)
    for i in range(n):
        where[i, order[i]] = final[i]
    return sums[root], where


def _bucket(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], kind="stable")
        parts = np.zeros((len(pdf), k), dtype=np.int64)
        parts[:, 0] = pdf["size"]
        sums, where = difference(parts)
        return pd.DataFrame({"key": [*pdf["key"], None], "bucket": int(pdf["bucket"].iloc[0]), "place": [*where[:, 0], -1], "sums": [*([None] * len(pdf)), sums]})

    return run


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    sums, where = difference(np.stack(pdf["sums"].to_numpy()))
    return pd.DataFrame({"node": [*pdf["node"], -1], "up": int(pdf["up"].iloc[0]), "places": [*where, None], "sums": [*([None] * len(pdf)), sums]})


def assign_groups(groups: DataFrame, shards: int, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """key, shard for ``groups`` (key binary, size long)."""
    n = max(1, -(-groups.count() // bucket))
    hashed = groups.select("key", "size", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(n)).alias("bucket"))
    first = staged(hashed.groupBy("bucket").applyInPandas(_bucket(shards), "key binary, bucket long, place int, sums array<long>"), "buckets")
    assigned = first.where("place >= 0").select("key", F.col("bucket").alias("node"), "place")
    tops = first.where("place < 0").select(F.col("bucket").alias("node"), "sums")
    while n > 1:
        n = -(-n // fan)
        up = tops.withColumn("up", F.pmod(F.xxhash64("node", F.lit(n)), F.lit(n)) if n > 1 else F.lit(0).cast("long"))
        met = staged(up.groupBy("up").applyInPandas(_round, "node long, up long, places array<int>, sums array<long>"), "rounds")
        links = met.where("node >= 0").select("node", "up", "places")
        assigned = assigned.join(links, "node").select("key", F.col("up").alias("node"), F.get("places", F.col("place")).alias("place"))
        tops = met.where("node < 0").select(F.col("up").alias("node"), "sums")
    return assigned.select("key", F.col("place").cast("int").alias("shard"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, the print of the text by which rows are grouped."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_key", F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), F.lit("0")).otherwise(F.lit("1")), text))))


def _groups(keyed: DataFrame) -> DataFrame:
    size = (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 8).cast("long")
    return staged(keyed.groupBy(F.col("_key").alias("key")).agg(F.sum(size).alias("size")), "groups")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = staged(_keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("_key").alias("key")), "facts")
    groups = staged(facts.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    placed = facts.join(assign_groups(groups, shards), "key").select("doc_id", "row", "size", "text_crc32", "shard", F.lit(1).cast("long").alias("one"))
    ranked = running(placed, ["doc_id", "row"], {"slot": "one"}, by="shard")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, to: str, shards: int = SHARDS) -> None:
    """Every row of ``docs`` with all its columns, a folder for each shard. A row's shard follows from its text,
    so null and repeated doc_ids need no care."""
    keyed = _keyed(docs)
    placed = keyed.join(assign_groups(_groups(keyed), shards).withColumnsRenamed({"key": "_key", "shard": "_shard"}), "_key").drop("_key")
    spread(placed.drop("shard").withColumnRenamed("_shard", "shard")).write.partitionBy("shard").parquet(to)


def op9_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
