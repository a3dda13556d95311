"""JSONL spools and transcripts: parsing with byte offsets, malformed lines counted, sinks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.blocks import running

EVENT = "session_id string, project_id string, tool_name string, timestamp string, transcript_path string, transcript_offset long, hwm_offset long"
# Tools whose events are not captured.
SKIPPED_TOOLS = ("ListMcpResourcesTool", "SlashCommand", "Skill", "TodoWrite", "AskUserQuestion")


#: Lines of a block: how many of a file one task adds up.
BLOCK_LINES = 1 << 16


def with_offsets(lines: DataFrame, keys: list[str], line_no: str, text: str) -> DataFrame:
    """Byte range [start, end) of each line of a file, its newline included in the next start. Files of any length are added
    up in blocks of lines."""
    size = F.octet_length(text)
    d = running(lines, keys, F.floor(F.col(line_no) / BLOCK_LINES), [line_no], (size + 1).cast("long"), "_upto")
    return d.withColumn("start", F.col("_upto") - size - 1).withColumn("end", F.col("_upto") - 1).drop("_upto")


def parse_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Columns of an event and ``malformed``; blank lines are dropped, lines that are no JSON object are malformed."""
    d = lines.where(F.trim(F.col(text)) != "")
    v = F.try_parse_json(F.col(text))
    e = F.from_json(F.col(text), EVENT)
    bad = v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")
    return d.select("*", F.coalesce(bad, F.lit(True)).alias("malformed"), e.alias("_e")).select(*d.columns, "malformed", "_e.*")


def boundary(transcript_offset, hwm_offset):
    """The offset up to which a record asks for capture; null if it has none that is not negative."""
    ok = lambda c: F.when(c >= 0, c)
    return F.coalesce(ok(transcript_offset), ok(hwm_offset))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """All events under a folder ``project/session.jsonl`` (plain or compressed), with their file."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_events(lines)


def skipped_tools(setting: str | None) -> tuple[str, ...]:
    """The tools of a comma-separated setting; the usual ones without it, none for a blank one."""
    return SKIPPED_TOOLS if setting is None else tuple(x.strip() for x in setting.split(",") if x.strip())


def append_events(events: DataFrame, path: str, skip: str | None = None, partition: list[str] | None = None) -> bool:
    """Appends the events whose tool is not skipped. Capture must not stop what it watches: a failed write is reported by
    the result and raises nothing."""
    names = skipped_tools(skip)
    kept = events.where(~F.coalesce(F.col("tool_name").isin(*names), F.lit(False))) if names else events
    return _append(kept, path, partition)


def append_sentinels(sentinels: DataFrame, path: str, partition: list[str] | None = None) -> bool:
    """Appends stop sentinels: only the transcript and its length belong to one; those without a transcript are left out."""
    keep = [*(partition or []), "session_id", "transcript_path", "hwm_offset"]
    return _append(sentinels.where("transcript_path is not null").select(*dict.fromkeys(keep)), path, partition)


def _append(df: DataFrame, path: str, partition: list[str] | None) -> bool:
    try:
        w = df.write.mode("append")
        (w.partitionBy(*partition) if partition else w).json(path)
        return True
    except Exception as e:  # noqa: BLE001
        logging.getLogger(__name__).warning("append to %s failed: %s", path, type(e).__name__)
        return False
