"""Messages as a stream: row-wise analyzers, counts by window, verdicts that are written once, and senders that repeat themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vigil.operators.analyzers import analyzed
from vigil.plans import verdict as V
from vigil.sources.rules import BUILT_IN, Pack


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("msg_id long, sender_hint string, text string, received_at timestamp").json(path)


def analyzed_stream(stream: DataFrame) -> DataFrame:
    """msg_id, lang, sender, pattern_weight of each message as it comes."""
    return analyzed(stream).select("msg_id", "received_at", "lang", "sender", "pattern_weight")


def counts_by_window(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Messages and pattern hits for each window of arrival; rows later than ``late`` are dropped with their window."""
    w = analyzed_stream(stream).withWatermark("received_at", late)
    return w.groupBy(F.window("received_at", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("pattern_weight") > 0).alias("hits"))


def start(frame: DataFrame, path: str, checkpoint: str):
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts_stream(stream: DataFrame, path: str, checkpoint: str, pack: Pack = BUILT_IN, ages: DataFrame | None = None, late: str | None = None):
    """A started query that writes the verdict of each message of ``stream`` (msg_id, sender_hint, text, received_at) once.

    A batch is analysed as a table is, so a stream's verdicts are the batch's. Its rows go to a folder of its own number,
    which a batch that is run again overwrites: whatever fails, each message counts once. With ``late``, messages repeated
    within that time are dropped by msg_id; the state of what was seen goes when the watermark has passed it.
    """
    if late is not None:
        stream = stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["msg_id"])

    def write(batch: DataFrame, number: int) -> None:
        found = V.verdicts(batch, pack=pack, ages=ages).select("msg_id", "received_at", "verdict", "confidence", "score")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def alerts(stream: DataFrame, path: str, checkpoint: str, most: int = 3, within: str = "1 hour"):
    """A started query over ``stream`` (msg_id, sender_hint, text, received_at): sender_hint, at, n for each sender whose messages with
    sender evidence reach ``most`` within ``within``.

    State is kept for each sender by event time: the times of its hits, which leave when they are older than ``within``.
    """
    hits = analyzed(stream).where("sender IS NOT NULL AND sender_hint IS NOT NULL").select("sender_hint", "received_at").withWatermark("received_at", within)
    span = pd.Timedelta(within)

    def step(key, frames, state):
        seen = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for at in sorted(frame["received_at"]):
                now = pd.Timestamp(at).timestamp()
                seen = sorted([x for x in seen if x > now - span.total_seconds()] + [now])
                if len(seen) >= most:
                    out.append((key[0], at, len(seen)))
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((seen,))
            if seen:
                state.setTimeoutTimestamp(max(int((max(seen) + span.total_seconds()) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sender_hint", "at", "n"])

    found = hits.groupBy("sender_hint").applyInPandasWithState(step, "sender_hint string, at timestamp, n int", "seen array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
