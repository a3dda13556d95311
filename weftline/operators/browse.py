"""Browsing: pages, timelines, lookups in request order, recent activity, statistics by local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_page(limit: int, offset: int = 0) -> None:
    if not isinstance(limit, int) or not isinstance(offset, int) or limit < 0 or offset < 0:
        raise ValueError("limit and offset are integers of at least 0")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page of a scan in order of the key: rows behind the last key seen, from the start for None."""
    check_page(limit)
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def scope_policy(asked: str | None, reserved: list[str], forced: str | None = None, config: str | None = None) -> str | None:
    """The scope that holds: a forced one admits no other id, two settings of one may not disagree, a reserved id cannot be
    asked for, a blank one is none."""
    clean = lambda x: x.strip() or None if isinstance(x, str) else None
    asked, forced, config = clean(asked), clean(forced), clean(config)
    if forced and config and forced != config:
        raise ValueError("the settings name two scopes")
    own = forced or config
    if own and asked and asked != own:
        raise ValueError("another scope is forced")
    if asked in reserved and own != asked:
        raise ValueError("reserved scope")
    return own or asked


def of_type(df: DataFrame, column: str, kind: str | None) -> DataFrame:
    """Observations under a filter made for memories: all without one, decisions for decisions, none for other types."""
    return df if kind is None else df.where(F.col(column) == "decision") if kind == "decision" else df.limit(0)


def scoped(df: DataFrame, column: str, scope: str | None, reserved: list[str], include_reserved: bool = False) -> DataFrame:
    """Rows of one scope, or of all but the reserved ones; a reserved scope is refused. Null scopes are in no scope."""
    if scope is not None:
        if scope.strip() in reserved:
            raise ValueError("reserved scope")
        if scope.strip():
            return df.where(F.col(column) == scope.strip())
    return df if include_reserved else df.where(~F.col(column).isin(reserved))


def resolve_short_id(df: DataFrame, key: str, prefix: str, recency: Column, most: int = 5) -> DataFrame:
    """Rows whose hexadecimal id starts with a prefix of at least six signs, newest first, with a verdict column;
    one row without values and NOT_FOUND if there is none."""
    p = "".join(c for c in prefix.lower() if c in "0123456789abcdef")
    if len(p) < 6:
        raise ValueError("at least six hexadecimal signs")
    hit = df.where(F.lower(F.regexp_replace(F.col(key), "[^0-9A-Fa-f]", "")).startswith(p)).orderBy(F.desc_nulls_last(recency), key).limit(most)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # at most ``most`` rows
    told = hit.withColumn("verdict", F.when(n == 1, "FOUND").otherwise("AMBIGUOUS"))
    one = df.sparkSession.createDataFrame([("NOT_FOUND",)], "_none string")
    j = one.join(told, F.lit(True), "left")  # one row beside at most ``most``
    return j.withColumn("verdict", F.coalesce("verdict", "_none")).drop("_none")


def timeline(df: DataFrame, session: str, time: Column, key: str, anchor: int, n_before: int, n_after: int) -> DataFrame:
    """The anchor and its neighbours by time within its session, in order of time: (key, part). Rows at the very time
    of the anchor are left out; neighbours are two top-n selections, so no session is sorted as a whole."""
    rows = df.select(key, F.col(session).alias("_s"), time.alias("_t"))
    a = rows.where(F.col(key) == anchor).select(F.col(key).alias("_k"), F.col("_s").alias("_as"), F.col("_t").alias("_at")).limit(1)
    near = rows.join(F.broadcast(a), F.col("_s") == F.col("_as"))  # one row
    before = near.where("_t < _at").orderBy(F.desc("_t"), F.desc(key)).limit(n_before).select(key, "_t", F.lit("before").alias("part"))
    after = near.where("_t > _at").orderBy(F.asc("_t"), F.asc(key)).limit(n_after).select(key, "_t", F.lit("after").alias("part"))
    self = near.where(F.col(key) == F.col("_k")).select(key, "_t", F.lit("anchor").alias("part"))
    return before.unionByName(self).unionByName(after)


def timeline_range(df: DataFrame, linked: Column, session: str, time: Column, key: str, n_before: int, n_after: int, cap: int = 100) -> DataFrame:
    """The rows linked to something, the whole stretch of time they span (at most ``cap`` rows, flagged if cut), and the
    neighbours before and after: (key, part, truncated). ``linked`` marks the rows of one session."""
    rows = df.select(key, F.col(session).alias("_s"), time.alias("_t"), linked.alias("_l"))
    span = rows.where("_l").groupBy("_s").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    near = rows.join(F.broadcast(span.limit(1)), "_s")  # one row
    before = near.where("_t < _a").orderBy(F.desc("_t"), F.desc(key)).limit(n_before).select(key, F.lit("before").alias("part"))
    after = near.where("_t > _z").orderBy("_t", key).limit(n_after).select(key, F.lit("after").alias("part"))
    w = Window.partitionBy(F.lit(1)).orderBy("_t", key)  # at most cap + 1 rows
    inner = near.where("_t between _a and _z").orderBy("_t", key).limit(cap + 1).withColumn("_n", F.row_number().over(w))
    more = F.max("_n").over(Window.partitionBy(F.lit(1))) > cap
    inside = inner.withColumn("truncated", more).where(F.col("_n") <= cap).select(key, F.lit("within").alias("part"), "truncated")
    no = F.lit(False).alias("truncated")
    return before.select("*", no).unionByName(inside).unionByName(after.select("*", no))


def batch_get(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of the requested ids in the order of the request; ids asked for twice come twice, unknown ones not at all."""
    want = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)] or [(-1, None)], f"pos int, {key} long")
    return df.join(F.broadcast(want), key)  # the request, not data


def recent_activity(rollups: DataFrame, obs: DataFrame, key: str, order: list[Column], limit: int, link: list[str], obs_key: str, obs_time: Column) -> DataFrame:
    """The newest rollups with the ids of their observations in order of time. Only the observations of the few rollups
    of the page are gathered."""
    top = rollups.orderBy(*order).limit(limit)
    keys = top.select(key, *link)
    ids = obs.join(F.broadcast(keys), link).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(obs_time.alias("t"), F.col(obs_key).alias("id")))).alias("o"))
    none = F.expr("cast(array() as array<bigint>)")
    return top.join(ids, key, "left").withColumn("observation_ids", F.coalesce(F.transform("o", lambda x: x["id"].cast("long")), none)).drop("o")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The newest row per key as a grouped maximum: combined before the shuffle, no key is sorted."""
    best = F.max(F.struct(*order, *[v for v in value if v not in order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{v}").alias(v) for v in value])


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))
