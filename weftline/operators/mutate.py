"""Changes as snapshots: classification of incoming rows, upserts and do-nothing inserts on parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import merge_metadata
from weftline.session import path_exists


def classify_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], key: str, digest: str, order: str) -> DataFrame:
    """``incoming`` with ``verdict``: insert (no key, or a new key), idempotent (known key, same digest) or conflict.

    Within the batch the first row by ``order`` decides for its key, later ones are compared with it. A blank or null
    ``key`` never meets another. ``current`` holds active rows; of several rows of a key the least digest counts.
    """
    k = F.nullif(F.trim(F.col(key)), F.lit(""))
    by = [c for c in keys if c != key]
    x = incoming.withColumn("_k", k)
    first = x.where("_k is not null").groupBy(*by, "_k").agg(F.min(F.struct(order, digest)).alias("f")).select(*by, "_k", F.col(f"f.{order}").alias("_fo"), F.col(f"f.{digest}").alias("_fd"))
    known = current.withColumn("_k", k).where("_k is not null").groupBy(*by, "_k").agg(F.min(digest).alias("_kd"))
    j = x.join(first, [*by, "_k"], "left").join(known, [*by, "_k"], "left")
    against = F.coalesce("_kd", F.when(F.col("_fo") != F.col(order), F.col("_fd")))
    v = F.when(F.col("_k").isNull() | against.isNull(), "insert").when(against == F.col(digest), "idempotent").otherwise("conflict")
    return j.withColumn("verdict", v).select(*incoming.columns, "verdict")


def apply_upsert(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The next snapshot: incoming rows replace those of their key, null incoming values keep the old ones. ``incoming``
    has one row per key. Adds ``change``: kept, inserted or updated."""
    c = current.select(key, *[F.col(v).alias(f"_c_{v}") for v in values], F.lit(1).alias("_c"))
    i = incoming.select(key, *[F.col(v).alias(f"_i_{v}") for v in values], F.lit(1).alias("_i"))
    change = F.when(F.col("_i").isNull(), "kept").when(F.col("_c").isNull(), "inserted").otherwise("updated")
    return c.join(i, key, "full_outer").select(key, *[F.coalesce(f"_i_{v}", f"_c_{v}").alias(v) for v in values], change.alias("change"))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch whose key the table lacks, one per key (the first by ``order``): insert, on conflict nothing."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("f"))
    one = one.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])
    return one.join(current.select(*keys), keys, "left_anti")


def insert_rows(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key the table at ``path`` lacks, one row a key (the least by its other columns); rows with a
    null in the key are refused. Run again after a failure, it adds only what is missing."""
    spark = df.sparkSession
    if not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise ValueError("a key is null")
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else df.distinct()
    if path_exists(spark, path):
        one = one.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    one.write.mode("append").parquet(path)


def compare_and_set(metadata: Column, expected: Column, key: str, value: Column) -> tuple[Column, Column]:
    """(metadata, applied): one key set where the whole metadata still equal the expected ones as JSON, blanks aside."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    same = F.coalesce(plain(metadata) == plain(expected), F.lit(False))
    return F.when(same, merge_metadata(metadata, key, value)).otherwise(metadata), same


def soft_delete(df: DataFrame, condition: Column, status: str = "status", archived: str = "archived") -> DataFrame:
    """The next snapshot with matching active rows archived, and ``changed``."""
    hit = condition & (F.col(status) == "active")
    return df.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn(status, F.when(F.col("changed"), archived).otherwise(F.col(status)))


def undo_recent(df: DataFrame, project: str, key: str, now: Column, max_age_seconds: int, time: str = "created_at") -> DataFrame:
    """The next snapshot with the newest active row of a project and key archived, if it is younger than the age; ``changed`` tells.
    ``df``: project, key, status, id and the time."""
    if not project.strip() or not key.strip() or max_age_seconds <= 0:
        raise ValueError("a project, a key and an age above 0 are needed")
    young = F.unix_micros(now) - F.unix_micros(F.col(time)) < max_age_seconds * 1_000_000
    hit = df.where((F.col("project") == project) & (F.col("key") == key) & (F.col("status") == "active") & young).agg(F.max(F.struct(time, "id")).alias("_m")).select("_m.id").where("id is not null")
    d = df.join(F.broadcast(hit.withColumn("changed", F.lit(True))), "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))  # one row
    return d.withColumn("status", F.when(F.col("changed"), "archived").otherwise(F.col("status"))).select(*df.columns, "changed")


def refine_delete(df: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """The next snapshot with requested active rows archived and the time noted in their metadata, null metadata counting as
    empty; ``changed`` tells. ``df``: id, project, status, metadata; ``requests``: id, project: a row is found only in its
    own project. Requests that find nothing change nothing."""
    r = requests.select("id", "project").distinct().withColumn("_r", F.lit(True))
    d = df.join(r, ["id", "project"], "left").withColumn("changed", F.coalesce(F.col("_r") & (F.col("status") == "active"), F.lit(False)))
    note = F.concat(F.lit('{"deleted":{"at":"'), at, F.lit('"}}'))
    d = d.withColumn("metadata", F.when(F.col("changed"), merge_metadata(F.col("metadata"), "refine", note)).otherwise(F.col("metadata")))
    return d.withColumn("status", F.when(F.col("changed"), "archived").otherwise(F.col("status"))).select(*df.columns, "changed")


def not_found(requests: DataFrame, df: DataFrame) -> DataFrame:
    """Requests of :func:`refine_delete` that no active row answers."""
    return requests.join(df.where("status = 'active'").select("id", "project"), ["id", "project"], "left_anti")


def guarded_rewrite(df: DataFrame, plan: DataFrame, key: str, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """The next snapshot: a row of the plan is rewritten only if all its before-columns still hold (nulls equal nulls);
    ``applied`` is true, or false for a plan row that was refused, null for rows outside the plan."""
    j = df.alias("d").join(plan.alias("p"), key, "left")
    same = F.lit(True)
    for c, was in before.items():
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{was}"))
    planned = F.col(f"p.{next(iter(after.values()))}").isNotNull()
    done = F.when(planned, same)
    cols = [F.when(done, F.col(f"p.{after[c]}")).otherwise(F.col(f"d.{c}")).alias(c) if c in after else F.col(c) if c == key else F.col(f"d.{c}") for c in df.columns]
    return j.select(*cols, done.alias("applied"))
