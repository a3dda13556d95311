"""Queries of the end-to-end search, with their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import retrieval, search
from weftline.operators.search import Search
from weftline.plans.core_queries import HITS, OBS_HAY, SUM_HAY, TERMS, WORDS, _query_vector, big, obs_haystack, query, sum_haystack
from weftline.plans.core_queries import ORACLE_SQL, QUERIES  # noqa: F401
from weftline.session import table

RESERVED = ("ulenx-holder", "yordaarwick-martosalm")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of sessions, those with a session being rollups, and pending ones, which are manual."""
    s = table(spark, d, "session_summaries")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("summary_id"), F.col("embedding").alias("vector"))
    metadata = F.when(F.col("session_id").isNotNull(), F.to_json(F.struct(F.struct("session_id").alias("capture"))))
    cls = search.memory_class(metadata)
    a = s.join(e, "summary_id", "left").select(
        F.concat(F.lit("m"), "summary_id").alias("id"), cls.alias("cls"), F.col("project_id").alias("project"), F.when(cls == "rollup", F.col("session_id")).alias("session"),
        F.col("updated_at").alias("time"), F.lit("session").alias("type"), sum_haystack().alias("hay"), "vector",
    )
    p = table(spark, d, "pending_summaries").select(
        F.concat(F.lit("p"), "pending_id").alias("id"), F.lit("manual").alias("cls"), F.col("project_id").alias("project"), F.lit(None).cast("string").alias("session"),
        F.col("blocked_at").alias("time"), F.lit("decision").alias("type"), F.lower(F.coalesce("summary", F.lit(""))).alias("hay"), F.lit(None).cast("array<float>").alias("vector"),
    )
    return a.unionByName(p)


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("embedding").alias("vector"))
    o = table(spark, d, "observations").where("status = 'active'").join(e, "obs_id", "left")
    return o.select(
        F.concat(F.lit("o"), "obs_id").alias("id"), F.when(F.col("obs_type") == "decision", "decision").otherwise("other").alias("cls"), F.col("project_id").alias("project"),
        F.col("session_id").alias("session"), F.col("observed_at").alias("time"), F.col("obs_type").alias("type"), obs_haystack().alias("hay"), "vector",
    )


_MEM = f"""q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
mem AS (SELECT 'm' || summary_id AS id, CASE WHEN session_id IS NULL THEN 'manual' ELSE 'rollup' END AS cls, project_id AS project, session_id AS session, updated_at AS time, 'session' AS type,
round({HITS(SUM_HAY)} / {len(TERMS)}.0, 6)::DOUBLE AS kw, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) AS sem FROM session_summaries LEFT JOIN embeddings ON vec_id = summary_id
UNION ALL SELECT 'p' || pending_id, 'manual', project_id, NULL, blocked_at, 'decision', round({HITS("lower(coalesce(summary, ''))")} / {len(TERMS)}.0, 6)::DOUBLE, NULL FROM pending_summaries),
obs AS (SELECT 'o' || obs_id AS id, CASE WHEN obs_type = 'decision' THEN 'decision' ELSE 'other' END AS cls, project_id AS project, session_id AS session, observed_at AS time, obs_type AS type,
round({HITS(OBS_HAY)} / {len(TERMS)}.0, 6)::DOUBLE AS kw, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) AS sem FROM observations LEFT JOIN embeddings ON vec_id = obs_id WHERE status = 'active')"""


@cache
def _top(source: str, score: str, k: int, where: str = "true") -> str:
    keep = f"{score} > 0" if score == "kw" else f"{score} IS NOT NULL"
    return f"(SELECT id, cls, project, session, time, {score} AS base, row_number() OVER (ORDER BY {score} DESC, time DESC NULLS LAST, id) AS r FROM {source} WHERE {keep} AND {where} QUALIFY r <= {k})"


def _cand(mode: str, k: int, where: str = "true", apart: bool = True) -> str:
    if mode != "hybrid":
        score = "kw" if mode == "keyword" else "sem"
        return f"cand AS (SELECT * EXCLUDE (r) FROM {_top('mem', score, k, where)} UNION ALL SELECT * EXCLUDE (r) FROM {_top('obs', score, k, where)})"
    part = " UNION ALL ".join(f"SELECT *, {c} AS c, {n} AS n FROM {_top(s, x, k, where)}" for c, x in enumerate(("kw", "sem")) for n, s in enumerate(("mem", "obs")))
    rank = "r" if apart else "row_number() OVER (PARTITION BY c ORDER BY n, r)"
    return f"lists AS (SELECT *, {rank} AS rr FROM ({part})), cand AS (SELECT id, cls, project, session, time, round(sum(1.0::DOUBLE / (60 + rr)), 6) AS base FROM lists GROUP BY ALL)"


_RANKED = """c AS (SELECT *, (cls IN ('decision', 'other') AND session IS NOT NULL) AS o FROM cand),
f AS (SELECT *, dense_rank() OVER (PARTITION BY o, project, session ORDER BY time NULLS FIRST) - 1 AS r FROM c), g AS (SELECT *, max(r) OVER (PARTITION BY o, project, session) AS m FROM f),
w AS (SELECT *, base * (CASE cls WHEN 'manual' THEN 1.0::DOUBLE WHEN 'rollup' THEN 0.85::DOUBLE WHEN 'decision' THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END)
* (CASE WHEN o AND m > 0 THEN 0.95::DOUBLE + (1 - 0.95::DOUBLE) * r / m ELSE 1.0::DOUBLE END) AS w0 FROM g),
b AS (SELECT *, max(CASE WHEN o THEN w0 END) OVER (PARTITION BY project, session) AS best FROM w),
ranked AS (SELECT id, cls, base, time, round(CASE WHEN cls = 'rollup' AND session IS NOT NULL THEN greatest(w0, coalesce(best, w0)) ELSE w0 END, 6) AS weighted,
(CASE cls WHEN 'manual' THEN 0 WHEN 'rollup' THEN 1 WHEN 'decision' THEN 2 ELSE 3 END) AS source_order FROM b)"""


def _reserved(limit: int) -> str:
    need = -(-limit * 4 // 10)
    return f"""t AS (SELECT *, row_number() OVER (ORDER BY weighted DESC, source_order, base DESC, time DESC NULLS LAST, id) AS r FROM ranked),
x AS (SELECT *, cls IN ('decision', 'other') AS obs, r <= {limit} AS head FROM t),
y AS (SELECT *, greatest(0, {need} - sum((head AND obs)::INT) OVER ()) AS need, sum((obs AND NOT head)::INT) OVER (ORDER BY r) AS kth, sum((head AND NOT obs)::INT) OVER (ORDER BY r DESC) AS from_end FROM x),
z AS (SELECT *, obs AND NOT head AND kth <= need AS up FROM y),
k AS (SELECT * FROM (SELECT *, sum(up::INT) OVER () AS ups FROM z) WHERE (head AND (obs OR from_end > ups)) OR up)"""


def _full(mode: str, limit: int, where: str = "true") -> str:
    score = "base" if mode == "semantic" else "NULL::DOUBLE"
    return f"WITH {_MEM}, {_cand(mode, limit * 3, where)}, {_RANKED}, {_reserved(limit)} SELECT row_number() OVER (ORDER BY up, r)::BIGINT AS rank, id, cls, {score} AS score FROM k"


@query(f"WITH {_MEM}, {_cand('keyword', 60)}, {_RANKED} SELECT id, cls, base, weighted, source_order::BIGINT AS source_order FROM ranked")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    c = search.candidates(memories(spark, d), observations(spark, d), Search(WORDS, "keyword", limit=20))
    return retrieval.rerank(c).select("id", "cls", "base", "weighted", *big("source_order"))


@query(f"WITH {_MEM}, {_cand('keyword', 60)}, {_RANKED}, {_reserved(20)} SELECT id, weighted, row_number() OVER (ORDER BY up, r)::BIGINT AS pos FROM k")
def reserve(spark: SparkSession, d: str) -> DataFrame:
    c = search.candidates(memories(spark, d), observations(spark, d), Search(WORDS, "keyword", limit=20))
    return retrieval.reserve(retrieval.rerank(c), 20).select("id", "weighted", *big("pos"))


@query(_full("keyword", 12))
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "keyword", limit=12))


@query(_full("semantic", 12))
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "semantic", tuple(_query_vector(spark, d)), 12))


@query(_full("hybrid", 12))
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "hybrid", tuple(_query_vector(spark, d)), 12))


@query(_full("keyword", 10))
def search_downgraded(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid search without a vector is a keyword search."""
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "hybrid"))


@query(_full("hybrid", 10, "type = 'decision' AND project NOT IN ('ulenx-holder', 'yordaarwick-martosalm')"))
def search_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Scope and type reach both sources: decisions outside the reserved projects."""
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "hybrid", tuple(_query_vector(spark, d)), type="decision", reserved=RESERVED))


@query(f"WITH {_MEM}, {_cand('keyword', 10).replace('FROM obs WHERE', 'FROM obs WHERE false AND')}, {_RANKED}, {_reserved(10)} SELECT row_number() OVER (ORDER BY up, r)::BIGINT AS rank, id, cls, NULL::DOUBLE AS score FROM k")
def search_without_observations(spark: SparkSession, d: str) -> DataFrame:
    return search.search_indexes(memories(spark, d), observations(spark, d), Search(WORDS, "keyword", include_observations=False))


@query(f"""WITH {_MEM}, l AS (SELECT *, 0 AS c FROM {_top('mem', 'kw', 15)} UNION ALL SELECT *, 1 FROM {_top('mem', 'sem', 15)}),
g AS (SELECT id, cls, round(sum(1.0::DOUBLE / (60 + r)), 6) AS base, min(c * 1000 + r) AS place FROM l GROUP BY ALL)
SELECT row_number() OVER (ORDER BY base DESC, place)::BIGINT AS rank, id, cls, NULL::DOUBLE AS score FROM g QUALIFY rank <= 15""")
def search_memories(spark: SparkSession, d: str) -> DataFrame:
    return search.search_memories(memories(spark, d), Search(WORDS, "hybrid", tuple(_query_vector(spark, d)), 15))


@query(f"""WITH {_MEM}, l AS (SELECT *, 0 AS c FROM {_top('obs', 'kw', 15)} UNION ALL SELECT *, 1 FROM {_top('obs', 'sem', 15)}),
g AS (SELECT id, cls, time, round(sum(1.0::DOUBLE / (60 + r)), 6) AS base FROM l GROUP BY ALL)
SELECT row_number() OVER (ORDER BY base DESC, cls <> 'decision', time DESC NULLS LAST, id)::BIGINT AS rank, id, cls, NULL::DOUBLE AS score FROM g QUALIFY rank <= 15""")
def search_observations(spark: SparkSession, d: str) -> DataFrame:
    return search.search_observations(observations(spark, d), Search(WORDS, "hybrid", tuple(_query_vector(spark, d)), 15))


@query(f"""WITH {_MEM}, p AS (SELECT id, row_number() OVER (ORDER BY kw DESC, time DESC NULLS LAST, id)::BIGINT AS rank FROM mem WHERE kw > 0 QUALIFY rank <= 8)
SELECT rank, id, CASE WHEN length(summary) > 180 THEN substr(summary, 1, 177) || '...' ELSE summary END AS title, CASE WHEN len(keywords) > 0 THEN array_to_string(keywords[1:6], ', ') END AS subtitle
FROM p JOIN (SELECT 'm' || summary_id AS id, summary, keywords FROM session_summaries UNION ALL SELECT 'p' || pending_id, summary, decisions FROM pending_summaries) USING (id)""")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    """The page joined back to its wide rows: only their titles are read."""
    s = table(spark, d, "session_summaries").select(F.concat(F.lit("m"), "summary_id").alias("id"), "summary", "keywords")
    p = table(spark, d, "pending_summaries").select(F.concat(F.lit("p"), "pending_id").alias("id"), "summary", F.col("decisions").alias("keywords"))
    page = search.search_memories(memories(spark, d), Search(WORDS, "keyword", limit=8))
    return search.with_rows(page, s.unionByName(p), ["summary", "keywords"]).select("rank", "id", *search.index_row(F.col("summary"), F.col("keywords")))
