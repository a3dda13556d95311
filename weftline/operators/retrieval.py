"""Hybrid retrieval: keyword and vector channels, rank fusion, weighting, recency, floor and reserve.

Top-k lists are taken on (id, score) alone, so wide columns never take part in a sort; every order ends in the id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import keyword_hits, keyword_terms
from weftline.functions.vectors import cosine, literal

RRF_K = 60
# Weights and orders of the kinds of rows, the reserved share of observations.
WEIGHTS = {"manual": 1.0, "rollup": 0.85, "decision": 0.8, "other": 0.65}
ORDER = {"manual": 0, "rollup": 1, "decision": 2, "other": 3}
RESERVE = 0.4


def keyword_topk(df: DataFrame, haystack: Column, query: str, k: int, recency: Column, key: str) -> DataFrame:
    """(key, hits, score, rank) of the k best rows by number of terms, then recency, then id. Rows that hold no term,
    or a null haystack, are left out; a blank query finds nothing."""
    terms = keyword_terms(query)
    if not terms:
        return df.select(key, F.lit(0).alias("hits"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    found = df.select(key, keyword_hits(haystack, terms).alias("hits"), recency.alias("_t")).where("hits > 0")
    top = found.orderBy(F.desc("hits"), F.desc_nulls_last("_t"), key).limit(k)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("hits"), F.desc_nulls_last("_t"), key)  # k rows
    return top.select(key, "hits", F.round(F.col("hits") / len(terms), 6).alias("score"), F.row_number().over(w).alias("rank"))


def semantic_topk(df: DataFrame, vector: str, query: list[float], k: int, key: str) -> DataFrame:
    """(key, score, rank) of the k nearest rows by exact cosine similarity; rows without a vector are left out."""
    s = df.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), literal(query)).alias("_s")).where("_s is not null")
    top = s.select(key, F.round("_s", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)  # k rows
    return top.withColumn("rank", F.row_number().over(w))


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score, first_list, first_rank): reciprocal rank fusion of ranked lists (rank from 1). Rows of equal score
    order by the list and the rank at which they first occur."""
    both = None
    for n, df in enumerate(lists):
        part = df.select(key, F.lit(n).alias("list"), "rank", (1.0 / (F.lit(k) + F.col("rank"))).alias("s"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"), F.min(F.struct("list", "rank")).alias("f"))
    return fused.select(key, "score", F.col("f.list").alias("first_list"), F.col("f.rank").alias("first_rank"))


def overfetch(limit: int, recency_min: float, floor: float) -> int:
    """How many candidates to read before a re-ranking that may move rows up."""
    return limit + min(2 * limit, 100) if recency_min < 1 or floor > 0 else limit


def by_class(cls: Column, table: dict) -> Column:
    c = None
    for k, v in table.items():
        c = F.when(cls == k, v) if c is None else c.when(cls == k, v)
    return c


def weights_of(given: dict | None) -> dict:
    """The weights of the classes, those that are given in place of the usual ones; what is no number keeps the usual one."""
    own = {}
    for k, usual in WEIGHTS.items():
        try:
            w = float((given or {}).get(k, usual))
        except (TypeError, ValueError):
            w = usual
        own[k] = w if math.isfinite(w) else usual
    return own


def rerank(candidates: DataFrame, recency_min: float = 0.95, floor: bool = True, weights: dict | None = None) -> DataFrame:
    """Weighted candidates: columns plus weighted, source_order.

    ``candidates``: id, cls (manual, rollup, decision, other), project, session, time, base. A row's score is its base
    times the weight of its class; observations of a session fade linearly from the newest (1) to the oldest
    (recency_min) by dense rank of their times; with ``floor`` a rollup is worth at least its session's best
    observation. Rows without a session neither fade nor lift.
    """
    obs = F.col("cls").isin("decision", "other") & F.col("session").isNotNull()
    # ranks over the different times of a session, not over its rows
    times = candidates.where(obs).select("project", "session", "time").distinct()
    w = Window.partitionBy("project", "session")
    r = times.select("project", "session", "time", (F.row_number().over(w.orderBy(F.asc_nulls_first("time"))) - 1).alias("r"), (F.count(F.lit(1)).over(w) - 1).alias("n"))
    c = candidates.alias("c").join(
        r.alias("r"), (F.col("c.project").eqNullSafe(F.col("r.project"))) & (F.col("c.session") == F.col("r.session")) & F.col("c.time").eqNullSafe(F.col("r.time")), "left"
    ).select("c.*", "r.r", "r.n")
    fade = F.when(obs & (F.col("n") > 0), recency_min + (1 - recency_min) * F.col("r") / F.col("n")).otherwise(1.0)
    c = c.withColumn("weighted", F.col("base") * by_class(F.col("cls"), weights_of(weights)) * fade).drop("r", "n")
    if floor:
        best = c.where(obs).groupBy("project", "session").agg(F.max("weighted").alias("best"))
        c = c.alias("c").join(best.alias("b"), F.col("c.project").eqNullSafe(F.col("b.project")) & (F.col("c.session") == F.col("b.session")), "left").select("c.*", "b.best")
        c = c.withColumn("weighted", F.when(F.col("cls") == "rollup", F.greatest("weighted", "best")).otherwise(F.col("weighted"))).drop("best")
    return c.withColumn("weighted", F.round("weighted", 6)).withColumn("source_order", by_class(F.col("cls"), ORDER))


def final_order() -> list[Column]:
    return [F.desc("weighted"), F.asc("source_order"), F.desc("base"), F.desc_nulls_last("time"), F.asc("id")]


def reserve(ranked: DataFrame, limit: int, share: float = RESERVE) -> DataFrame:
    """The first ``limit`` rows with at least ceil(limit * share) observations, if there are as many.

    Missing observations are promoted from behind the head, in order, and take the places of the head's last other
    rows; promoted rows go to the tail. Adds ``pos`` from 1. ``ranked`` is the re-ranked candidate list of one search,
    bounded by the over-fetched limit.
    """
    need_all = -(-int(limit * share * 1000) // 1000)
    one = Window.partitionBy(F.lit(1))
    d = ranked.withColumn("r", F.row_number().over(one.orderBy(*final_order())))
    d = d.withColumn("obs", F.col("cls").isin("decision", "other")).withColumn("head", F.col("r") <= limit)
    have = F.sum(F.when(F.col("head") & F.col("obs"), 1).otherwise(0)).over(one)
    d = d.withColumn("need", F.greatest(F.lit(0), F.lit(need_all) - have))
    d = d.withColumn("kth", F.sum(F.when(F.col("obs") & ~F.col("head"), 1).otherwise(0)).over(one.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("up", F.col("obs") & ~F.col("head") & (F.col("kth") <= F.col("need")))
    d = d.withColumn("ups", F.sum(F.col("up").cast("int")).over(one))
    d = d.withColumn("from_end", F.sum(F.when(F.col("head") & ~F.col("obs"), 1).otherwise(0)).over(one.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)))
    kept = d.where((F.col("head") & (F.col("obs") | (F.col("from_end") > F.col("ups")))) | F.col("up"))
    pos = F.row_number().over(one.orderBy(F.col("up"), F.col("r")))
    return kept.withColumn("pos", pos).drop("r", "obs", "head", "need", "kth", "ups", "from_end", "up")
