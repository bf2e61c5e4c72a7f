"""Shared helpers of the training-data operators: staging, ranking, worker-side caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or with a local master and none set (tests) a private one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="vigil-shared-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{where}")
        where = f"file://{where}"
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/vigil-{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends in files that survive a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vigil_path = path
    return out


def where(df: DataFrame) -> str:
    """The folder of a staged table."""
    return df._vigil_path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few longs that may be broadcast; larger sides are joined with a shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of texts that a filter holds as Python objects at a time.
HELD = 16 << 20


def by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = HELD):
    """Slices of ``batch`` whose texts take about ``most`` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: What this worker remembers between tasks, and the operator that it last worked for.
_remembered: list = []
_owner: str | None = None


def remembered(cache):
    """Register a worker's memory (anything with ``clear``) that only one operator's tasks use."""
    _remembered.append(cache)
    return cache


def begin(owner: str) -> None:
    """Workers outlive an operator: what the last one remembered goes when another one's task comes."""
    global _owner
    if _owner not in (None, owner):
        for cache in _remembered:
            cache.clear()
        gc.collect()
        give_back()
    _owner = owner


def trimmed(run, owner: str | None = None):
    """``run`` for mapInArrow whose worker gives memory back to the system at the end of a task, and what other operators
    (modules) than ``owner`` remembered at its start."""
    owner = owner or run.__module__

    def task(batches):
        begin(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Free memory that Arrow and the C library keep for later: workers live on, and later stages have other needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` for which ``keep(list of UTF-8 texts)`` gives true; all columns stay as they are.

    ``keep`` is made once for each task by calling the given factory. Texts become Python objects ``HELD`` bytes
    at a time.
    """

    def run(batches):
        test = keep()
        for whole in batches:
            for b in by_bytes(whole):
                yield b.filter(pa.array(test(b.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()), pa.bool_()))

    return docs.mapInArrow(trimmed(run, keep.__module__), docs.schema)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal rows evenly over the shuffle partitions."""
    return df.repartition(partitions(df.sparkSession), *key)


def running(df: DataFrame, order: list[str], amounts: dict[str, str], by: str | None = None) -> DataFrame:
    """Exclusive running sums of ``amounts`` (new column -> summed column) in ``order``, within ``by``.

    No task holds more than one range partition: rows are dealt by range, each range is summed where it
    lies, and only one row for each range and ``by`` value meets in a second, small window.
    """
    spark = df.sparkSession
    keys = ([by] if by else []) + order
    dealt = df.repartitionByRange(partitions(spark), *keys).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    groups = ["_range"] + ([by] if by else [])
    sums = dealt.groupBy(*groups).agg(*[F.sum(a).alias(f"_sum_{c}") for c, a in amounts.items()])
    before = Window.partitionBy(*([by] if by else [])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_at_{c}") for c in amounts])
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_in_{c}") for c, a in amounts.items()])
    on = local["_range"] == offsets["_range"]
    if by:
        on = on & local[by].eqNullSafe(offsets[by])
    out = local.join(offsets, on)
    return out.select(*[local[c] for c in df.columns], *[(F.col(f"_in_{c}") + F.col(f"_at_{c}")).cast("long").alias(c) for c in amounts])
