"""Ordered work on keys of any size: rows of a key are cut into blocks of their order, worked on block by block, and what
passes from block to block is one row a block.

A window over (key, block) never holds more than a block of a key, however hot the key is; the window over a key holds its
blocks only. ``block`` is any expression that does not fall along the order (days of a time, ranges of an offset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_block").orderBy(*order)


def lagged(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: a struct of the value of the row before within its key (``v``), null for the first row."""
    d = df.withColumn("_block", block).withColumn("_v", F.struct(value.alias("v")))
    w = _by(keys, order)
    d = d.withColumn("_p", F.lag("_v").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = d.groupBy(*keys, "_block").agg(F.max_by("_v", F.struct(*order)).alias("_e"))
    ends = ends.withColumn("_e", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_block")))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_block")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    j = d.alias("d").join(ends.alias("e"), on, "left")
    return j.select("d.*", F.col("e._e").alias("_e")).withColumn(out, F.when(F.col("_first"), F.col("_e")).otherwise(F.col("_p"))).drop("_block", "_v", "_p", "_first", "_e")


def running(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str, how=F.sum) -> DataFrame:
    """``df`` with ``out``: the running sum (or maximum, ``how=F.max``) of a value over the rows of its key up to this one."""
    d = df.withColumn("_block", block).withColumn("_v", value)
    d = d.withColumn("_in", how("_v").over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = d.groupBy(*keys, "_block").agg(how("_v").alias("_e"))
    ends = ends.withColumn("_e", how("_e").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    on = F.lit(True)
    for k in (*keys, "_block"):
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}"))
    j = d.alias("d").join(ends.alias("e"), on, "left").select("d.*", F.col("e._e").alias("_e"))
    total = F.coalesce("_in", F.lit(0)) + F.coalesce("_e", F.lit(0)) if how is F.sum else F.greatest("_in", "_e")
    return j.withColumn(out, total).drop("_block", "_v", "_in", "_e")


def days(time: Column) -> Column:
    """Blocks of a time: its days."""
    return F.unix_date(F.to_date(time))
