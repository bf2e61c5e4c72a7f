"""Where lineage is cut: the folder in ``spark.checkpoint.dir``, or with a local master and none set a private one."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short rows that may be broadcast.
BROADCAST_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="vigil-checkpoint-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{where}")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows are known to be at most ``rows``, marked for broadcast if those are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
