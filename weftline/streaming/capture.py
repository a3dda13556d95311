"""Streaming capture: JSONL spool events to a table of boundaries and an event sink that a replay does not double."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.session import path_exists
from weftline.sources.jsonl import EVENT, boundary

STORED = "transcript_path string, boundary long, session_id string, tool_name string, batch int, bucket int"


def event_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).json(folder)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and tool, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "tool_name").agg(F.count("*").alias("n"))


def sessions_by_gap(events: DataFrame, time: str = "ts", late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Sessions closed by inactivity: first and last event and their number."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "session_id").agg(F.count("*").alias("n"))


def checkpoint_ranges(events: DataFrame) -> DataFrame:
    """Ranges to capture as a stateful stream: (path, start, end, baseline), in update mode.

    The state of a transcript is its checkpoint. The first sight of one only sets its baseline; after that a boundary
    behind the checkpoint gives the range up to it and moves the checkpoint, and one before it gives nothing. Events
    without a path or a boundary are left out.
    """

    def step(key, parts, state):
        ends = [int(p.boundary.max()) for p in parts if len(p)]
        if not ends:
            return
        end = max(ends)
        (start,) = state.get if state.exists else (None,)
        if start is not None and end <= start:
            return
        state.update((end,))
        yield pd.DataFrame({"path": [key[0]], "start": [end if start is None else start], "end": [end], "baseline": [start is None]})

    b = events.select("transcript_path", boundary(F.col("transcript_offset"), F.col("hwm_offset")).alias("boundary"))
    b = b.where("transcript_path is not null and boundary is not null")
    return b.groupBy("transcript_path").applyInPandasWithState(
        step, "path string, start long, end long, baseline boolean", "checkpoint long", "update", GroupStateTimeout.NoTimeout
    )


#: Partitions of the table of boundaries by a hash of the path: a batch reads only those of its own paths.
BUCKETS = 64


def _write_once(target: str):
    """Each batch adds the events whose (path, offset) the table lacks, and reads only the partitions that its paths can be
    in. The batch id is a partition that is overwritten, so a batch that is run again after a failure replaces what it
    had written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("boundary", boundary(F.col("transcript_offset"), F.col("hwm_offset"))).where("boundary is not null and transcript_path is not null")
        new = new.groupBy("transcript_path", "boundary").agg(F.min("session_id").alias("session_id"), F.min("tool_name").alias("tool_name"))
        new = new.withColumn("bucket", (F.crc32("transcript_path") % BUCKETS).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            out = new
            if path_exists(spark, target):
                old = spark.read.schema(STORED).parquet(target).where((F.col("batch") != batch_id) & F.col("bucket").isin(touched))
                out = new.join(old.select("transcript_path", "boundary"), ["transcript_path", "boundary"], "left_anti")
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")
        finally:
            new.unpersist()

    return write


def capture_available(spark: SparkSession, folder: str, target: str, checkpoint: str, max_files: int = 1000) -> None:
    """One pass over all files that have come in since the last; safe to repeat."""
    q = event_stream(spark, folder, max_files).writeStream.foreachBatch(_write_once(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
