"""Byte ranges: merging, coverage, overlap and the verdict on late windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import running


#: Bytes of a block of a transcript.
BLOCK = 1 << 20


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int | None = None) -> DataFrame:
    """Disjoint ranges per key: ranges that overlap or touch are one; empty ones (end <= start) and nulls are dropped.

    Ranges of a key are first merged within blocks of ``block`` bytes by start, so a key with most of the rows is
    merged by many tasks; what is left of it, at most a few ranges a block, is merged in a second pass.
    """
    d = df.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    d = d.groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))  # copies collapse before the shuffle

    def islands(x: DataFrame, by: list[Column | str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_s", "_e")
        prev = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        x = x.withColumn("_new", F.when(prev >= F.col("_s"), 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w))
        return x.groupBy(*by, "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_i")

    if block:
        d = islands(d.withColumn("_b", F.floor(F.col("_s") / block)), [*keys, "_b"]).drop("_b")
    out = islands(d, list(keys))
    return out.select(*keys, F.col("_s").alias(start), F.col("_e").alias(end))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """All pairs of ranges of one key that overlap: (keys, a_start, a_end, b_start, b_end). Ranges meet in the blocks of
    ``width`` they cover, and a pair is kept in the first block both are in, so a hot key is split by position."""
    cover = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))).alias("blk")
    x = a.where("end > start").select(*keys, F.col("start").alias("a_start"), F.col("end").alias("a_end"), cover(F.col("start"), F.col("end")))
    y = b.where("end > start").select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), cover(F.col("start"), F.col("end")))
    j = x.join(y, [*keys, "blk"]).where("a_end > b_start and a_start < b_end")
    return j.where(F.col("blk") == F.floor(F.greatest("a_start", "b_start") / width)).drop("blk")


def covered(candidates: DataFrame, merged: DataFrame, key: str, block: int) -> DataFrame:
    """Candidates that lie within one range of their key: those whose end is not behind the furthest end of the ranges that
    start at or before them. A key is worked on in blocks of ``block`` starts."""
    both = candidates.select(F.col(key), "start", "end", F.lit(1).alias("_q")).unionByName(merged.select(F.col(key), "start", "end", F.lit(0).alias("_q")))
    at = F.floor(F.col("start") / block)
    upto = running(both, [key], at, ["start", "_q"], F.when(F.col("_q") == 0, F.col("end")), "_m", F.max)
    return upto.where((F.col("_q") == 1) & (F.col("end") <= F.col("_m"))).select(key, "start", "end")


def late_verdict(windows: DataFrame, seen: DataFrame, session: str = "session") -> DataFrame:
    """Whether a window may still be taken in: ok, later-rollup-exists or rollup-order-unknown.

    ``windows``: session, path, start, end; ``seen`` the ranges already taken in. A window that a seen range of its path
    covers is ok; a session without ranges, or with ranges of another path, has no known order; otherwise a range that
    ends after the window's start is later.
    """
    per = seen.groupBy(session).agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.min("path").alias("one"), F.max("end").alias("last"))
    # a seen range covers a window if the furthest end of those that start before it does: no pairs are made
    own = lambda df: df.select(F.struct(session, "path").alias("k"), "start", "end").distinct()
    hit = covered(own(windows), own(seen), "k", BLOCK).select(F.col(f"k.{session}").alias(session), "k.path", "start", "end", F.lit(True).alias("hit"))
    j = windows.join(per, session, "left").join(hit, [session, "path", "start", "end"], "left")
    v = (
        F.when(F.col("hit"), "ok")
        .when(F.col("n").isNull() | (F.col("paths") != 1) | (F.col("one") != F.col("path")), "rollup-order-unknown")
        .when(F.col("last") > F.col("start"), "later-rollup-exists")
        .otherwise("ok")
    )
    return j.select(session, "path", "start", "end", v.alias("verdict"))
