"""Data quality: checksums, duplicate and orphan keys, set stability, coverage, streaks, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import lagged, running


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct elements of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def table_checksum(df: DataFrame, key: str, row: Column, group_rows: int = 10_000) -> DataFrame:
    """(rows, checksum) of a table: MD5s of its rows, joined in order of the key, group by group; 'empty' for none.

    Rows are hashed where they lie. Groups, by the first 8 hexadecimal digits of the MD5 of the key, follow the number of
    rows, so each holds about ``group_rows``; their digests are joined in the same way, ``group_rows`` at a time, until one
    is left. So no task gathers the table, whatever its size. Nulls in the key are one group of their own.
    """
    groups = max(1, -(-df.count() // group_rows))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    d = df.select((number % groups).alias("g"), F.col(key).alias("k"), F.md5(row).alias("h"), F.lit(1).cast("long").alias("n"))
    join = lambda by: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), "|")).alias("h")
    d = d.groupBy("g").agg(F.sum("n").alias("n"), join("k"))
    while groups > 1:
        groups = -(-groups // group_rows)
        d = d.select(F.floor(F.col("g") / group_rows).alias("up"), "g", "h", "n").groupBy("up").agg(F.sum("n").alias("n"), join("g")).withColumnRenamed("up", "g")
    total = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("h").alias("h"))
    return total.select("rows", F.coalesce("h", F.lit("empty")).alias("checksum"))


def ordered_checksum(df: DataFrame, key: str, row: Column) -> DataFrame:
    """(rows, checksum) as one ordered string, for small tables (dimensions, plans) whose form others must match."""
    s = df.agg(F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r")))), lambda x: x["r"]), "|").alias("s"))
    return s.select("rows", F.when(F.col("rows") == 0, "empty").otherwise(F.md5("s")).alias("checksum"))


def duplicate_keys(df: DataFrame, keys: list[str], active: Column | None = None) -> DataFrame:
    """Keys that more than one active row has; rows with a null in the key never clash."""
    d = df if active is None else df.where(active)
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.where(F.col(on).isNotNull()).join(p, F.col(on) == F.col("_p"), "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): distinct rows that only one of the tables has."""
    only = lambda x, y, s: x.subtract(y).agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def percentile_nearest_rank(df: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """The value at place ceil(q * n) of each group. No group is sorted: values are counted in buckets that keep their
    order (steps of the logarithm, some ten thousand a group), the bucket with the place is found on these counts, and
    only its different values are ordered. Nulls do not count, NaN counts as the greatest value."""
    v = F.col(value)
    step = F.when(F.isnan(v.cast("double")), 2**62).otherwise(F.signum(v) * F.floor(F.log1p(F.abs(v.cast("double"))) * 4096)).cast("long")
    d = df.where(v.isNotNull()).select(*keys, v, step.alias("_b"))
    c = d.groupBy(*keys, "_b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("_b"))).withColumn("n", F.sum("c").over(w)).withColumn("place", F.ceil(F.col("n") * q))
    c = c.where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
    found = c.select(*keys, "_b", "n", (F.col("place") - F.col("upto") + F.col("c")).alias("place"))
    on = F.lit(True)
    for k in (*keys, "_b"):
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}"))
    near = d.alias("d").join(found.alias("f"), on).select("d.*", "f.n", "f.place").groupBy(*keys, value, "n", "place").agg(F.count("*").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(w.orderBy(value)))
    return near.where("upto >= place").groupBy(*keys).agg(F.min(value).alias("p"), F.max("n").alias("n"))


def streaks(df: DataFrame, keys: list[str], order: list[str], cls: str, block: Column) -> DataFrame:
    """Stretches of rows of one class per key: (keys, cls, first, length), first being the order column's value. A key is
    worked on in blocks of its order (see :mod:`weftline.operators.blocks`)."""
    d = lagged(df.select(*keys, *order, cls), keys, block, order, F.col(cls), "_before")
    new = F.when(F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(cls)), 0).otherwise(1)
    d = running(d, keys, block, order, new, "_i")
    return d.groupBy(*keys, "_i", cls).agg(F.min(order[0]).alias("first"), F.count("*").alias("length")).drop("_i")


def conflicting(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Keys with more than one value, the first value seen and the first that differs: grouped aggregates only."""
    first = df.groupBy(*keys).agg(F.min(F.struct(order, value)).alias("f"), F.count_distinct(value).alias("n")).where("n > 1")
    j = df.join(first.select(*keys, "f", "n"), keys).where(F.col(value) != F.col(f"f.{value}"))
    return j.groupBy(*keys, F.col(f"f.{value}").alias("first_value"), F.col("n").alias("n_values")).agg(F.min(order).alias("first_conflict"))
