"""Sinks of evaluation data: parity fixtures, and texts and labels in files that correspond line by line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.rows import flat_line
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources.pack import put

# Width of an input and what two runtimes may differ by
MAX_LENGTH, MAX_DELTA = 128, 0.02


def write_fixture(spark: SparkSession, samples: DataFrame, path: str, model: str) -> None:
    """One JSON document of ``samples`` (text, p_scam) in the order of their id: a few hundred texts that another runtime must score alike."""
    rows = [{"text": r["text"], "p_scam": r["p_scam"]} for r in samples.orderBy("id").select("text", "p_scam").toLocalIterator()]
    put(spark, path, json.dumps({"model": model, "max_seq_len": MAX_LENGTH, "max_delta": MAX_DELTA, "samples": rows}, ensure_ascii=False, indent=1).encode())


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """ord, text, p_scam, max_delta of a fixture."""
    shape = "model string, max_seq_len int, max_delta double, samples array<struct<text: string, p_scam: double>>"
    doc = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("max_delta", F.posexplode("samples").alias("ord", "s")).select("ord", "s.text", "s.p_scam", "max_delta")


def write_aligned(rows: DataFrame, folder: str, order: str) -> None:
    """texts and labels of ``rows`` (text, label) in ``order``: a folder each, whose files hold the same lines in the same order.

    Both come from one checkpoint, so they agree though a task is run again. The manifest, with the lines of each file, is
    written last: a folder without one is unfinished.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(order, flat_line(F.col("text")).alias("text"), F.col("label").cast("string").alias("label")).repartitionByRange(parts, order).sortWithinPartitions(order).checkpoint()
    for name, column in (("texts", "text"), ("labels", "label")):
        dealt.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    sizes = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    put(spark, f"{folder}/manifest.json", json.dumps({"parts": {str(r["part"]): r["n"] for r in sizes}, "lines": sum(r["n"] for r in sizes)}).encode())


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """part, line, value: lines numbered within their file."""
    meta = F.col("_metadata")
    each = spark.read.option("wholetext", False).text(path).select("value", F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).cast("int").alias("part"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"))
    return each.select("part", F.row_number().over(Window.partitionBy("part").orderBy("start", "id")).alias("line"), "value")


def read_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """part, line, text, label; raises without a manifest or if the files do not hold its lines."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()["value"])
    ensure_checkpoint_dir(spark)
    texts, labels = (_numbered(spark, f"{folder}/{n}") for n in ("texts", "labels"))
    on = texts.withColumnRenamed("value", "text").join(labels.withColumnRenamed("value", "label"), ["part", "line"], "full").checkpoint()
    got = {str(r["part"]): r["n"] for r in on.where("text IS NOT NULL AND label IS NOT NULL").groupBy("part").agg(F.count("*").alias("n")).collect()}
    if got != manifest["parts"] or on.count() != manifest["lines"]:
        raise ValueError(f"{folder}: files and manifest differ")
    return on
