"""Problem 1: runs of the same event in ordered sequences, by associative run summaries.

The events of all sequences are range-sorted by (sequence, position) into chunks of about equal size, so a
sequence that holds a third of all rows is spread over many chunks. Each chunk encodes its runs locally.
Only the first and the last run of a chunk can continue in a neighbour; these summaries (at most two a chunk)
are joined by a parallel prefix merge over the chunk order: (tool, first, last, count, first time, last time)
summaries combine associatively, and runs that fill whole chunks chain across any number of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.blocks import lagged, running
from weftline.session import cut

#: Chunks whose summaries one task scans.
SCAN = 256

# Names that wrap a tool without making it another one.
WRAPPERS = ("functions", "function", "default_api", "tools", "tool", "api", "multi_tool_use")

#: Pieces of :func:`canonical_tool`, used by the SQL as well.
WRAP_RE = r"^(?:(?:" + "|".join(WRAPPERS) + r")(?:[./:]|::))+"
NUMBER_RE = r"\s*(?:#\s*\d+|\(\s*\d+\s*\)|\[\s*\d+\s*\])$"


def canonical_tool(c: Column) -> Column:
    """One name for all spellings of a tool: case, blanks, separators, wrappers and trailing numbers go;
    the double underscores between server and action stay. Blank names give null."""
    x = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    x = F.regexp_replace(F.regexp_replace(x, WRAP_RE, ""), NUMBER_RE, "")
    x = F.regexp_replace(F.replace(x, F.lit("__"), F.lit("|")), r"[\s_\-]+", "")
    return F.nullif(x, F.lit(""))


_RUN = "chunk int, pos long, first_run boolean, last_run boolean, seq string, tool string, first_offset long, last_offset long, n_events long, t_first long, t_last long, first_id long, first_name string"


def _encode(batches):
    """Runs of one chunk, in order; the first and last are marked. Rows come sorted by (seq, offset, id);
    of rows with one (seq, offset) the first counts."""
    chunk, pos, seen, held = TaskContext.get().partitionId(), 0, None, None
    cols = ["seq", "tool", "first_offset", "last_offset", "n_events", "t_first", "t_last", "first_id", "first_name"]

    def out(df: pd.DataFrame, last: bool) -> pd.DataFrame:
        nonlocal pos
        n = len(df)
        df = df.assign(chunk=chunk, pos=np.arange(pos, pos + n), first_run=False, last_run=False)
        if n and not pos:
            df.loc[df.index[0], "first_run"] = True
        if n and last:
            df.loc[df.index[-1], "last_run"] = True
        pos += n
        return df[["chunk", "pos", "first_run", "last_run", *cols]]

    for pdf in batches:
        if not len(pdf):
            continue
        seq, off = pdf.seq.to_numpy(object), pdf.offset.to_numpy(np.int64)
        new = np.ones(len(pdf), bool)
        new[1:] = (seq[1:] != seq[:-1]) | (off[1:] != off[:-1])
        new[0] = seen != (seq[0], off[0])
        seen = (seq[-1], off[-1])
        pdf = pdf[new]
        if not len(pdf):
            continue
        seq, tool = pdf.seq.to_numpy(object), pdf.tool.to_numpy(object)
        start = np.ones(len(pdf), bool)
        start[1:] = (seq[1:] != seq[:-1]) | (tool[1:] != tool[:-1])
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(pdf)) - 1
        off = pdf.offset.to_numpy(np.int64)
        t = pdf.t.astype("Int64")
        run = np.cumsum(start) - 1
        times = t.groupby(run)
        runs = pd.DataFrame(
            {
                "seq": seq[at],
                "tool": tool[at],
                "first_offset": off[at],
                "last_offset": off[end],
                "n_events": end - at + 1,
                "t_first": times.min(),
                "t_last": times.max(),
                "first_id": pdf.id.to_numpy(np.int64)[at],
                "first_name": pdf.name.to_numpy(object)[at],
            }
        )
        if held is not None:
            a, b = held.iloc[0], runs.iloc[0]
            if a.seq == b.seq and a.tool == b.tool:
                ts = [x for x in (a.t_first, a.t_last, b.t_first, b.t_last) if not pd.isna(x)]
                for c in ("first_offset", "first_id", "first_name"):
                    runs.loc[0, c] = a[c]
                runs.loc[0, "n_events"] = a.n_events + b.n_events
                if ts:
                    runs.loc[0, "t_first"], runs.loc[0, "t_last"] = min(ts), max(ts)
            else:
                runs = pd.concat([held, runs], ignore_index=True)
        held = runs.iloc[-1:].reset_index(drop=True)
        if len(runs) > 1:
            yield out(runs.iloc[:-1], False)
    if held is not None:
        yield out(held, True)


def collapse_runs(
    df: DataFrame,
    seq: str = "session_id",
    offset: str = "transcript_offset",
    tool: str = "tool_name",
    row_id: str = "event_id",
    time_millis: Column | None = None,
    firsts: bool = False,
) -> DataFrame:
    """One row per longest stretch of consecutive events of a sequence with the same tool.

    Columns: the sequence column, tool (canonical), first_offset, last_offset, n_events, duration_ms
    (last minus first known time of the stretch; null if none of its events has a time), a single event
    being a stretch of one. Rows with a null sequence, offset or tool are ignored; rows with the same
    sequence and offset are one event, that of the smallest id (nulls last) if their tools differ. An
    empty table gives an empty result; further columns are ignored. Long and hot sequences are whole. With
    ``firsts``, the id and the name of the first event of each stretch follow, as the writer gave them, so that single
    events stand as they are; and rows that are ignored above follow as stretches of one, without a tool.
    """
    t = (time_millis if time_millis is not None else F.lit(None)).cast("long")
    events = (
        df.select(
            F.col(seq).alias("seq"),
            F.col(offset).cast("long").alias("offset"),
            canonical_tool(F.col(tool)).alias("tool"),
            F.coalesce(F.col(row_id).cast("long"), F.lit(2**63 - 1)).alias("id"),
            t.alias("t"),
            (F.col(tool) if firsts else F.lit(None)).cast("string").alias("name"),
        )
        .where("seq is not null and offset is not null and tool is not null")
        .groupBy("seq", "offset", "tool")  # copies collapse before the shuffle
        .agg(F.min(F.struct("id", "name")).alias("f"), F.min("t").alias("t"))
        .select("seq", "offset", "tool", "f.id", "t", "f.name")
    )
    sorted_chunks = events.repartitionByRange("seq", "offset").sortWithinPartitions("seq", "offset", "id", "tool")
    runs = cut(sorted_chunks.mapInPandas(_encode, _RUN))
    keep = ["seq", "tool", "first_offset", "last_offset", "n_events", "t_first", "t_last", "first_id", "first_name"]
    inner = runs.where("not first_run and not last_run").select(*keep)
    # At most two summaries a chunk. The prefix merge over them is parallel: blocks of chunks are scanned each for itself, and
    # what passes from block to block is one row a block.
    block, order = F.floor(F.col("chunk") / SCAN), ["chunk", "pos"]
    edges = lagged(runs.where("first_run or last_run"), [], block, order, F.struct("seq", "tool", "last_run"), "prev")
    before = lambda c: F.col(f"prev.v.{c}")
    joins = (before("seq") == F.col("seq")) & (before("tool") == F.col("tool")) & before("last_run") & F.col("first_run")
    edges = running(edges, [], block, order, F.when(joins, 0).otherwise(1), "island")
    merged = edges.groupBy("island", "seq", "tool").agg(
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
        F.sum("n_events").alias("n_events"),
        F.min("t_first").alias("t_first"),
        F.max("t_last").alias("t_last"),
        F.min_by("first_id", "first_offset").alias("first_id"),
        F.min_by("first_name", "first_offset").alias("first_name"),
    )
    out = inner.unionByName(merged.select(*keep)).select(
        F.col("seq").alias(seq),
        "tool",
        "first_offset",
        "last_offset",
        "n_events",
        (F.col("t_last") - F.col("t_first")).alias("duration_ms"),
        F.nullif("first_id", F.lit(2**63 - 1)).alias(row_id),
        F.col("first_name").alias(tool),
    )
    if not firsts:
        return out.drop(row_id, tool)
    one = df.where(F.col(seq).isNull() | F.col(offset).isNull() | canonical_tool(F.col(tool)).isNull())
    at = F.col(offset).cast("long")
    none = F.lit(None).cast("string").alias("tool")
    rest = one.select(seq, none, at.alias("first_offset"), at.alias("last_offset"), F.lit(1).cast("long").alias("n_events"), F.lit(None).cast("long").alias("duration_ms"), F.col(row_id).cast("long").alias(row_id), tool)
    return out.unionByName(rest)
