"""Queries over the driver's tables for the core operators, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.vectors import norm, normalise
from weftline.operators.blocks import days, lagged, running
from weftline.operators import browse, capture, mutate, quality, ranges, retrieval, state
from weftline.session import table
from weftline.sources import jsonl

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def big(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- retrieval ---------------------------------------------------------------------------------------------

WORDS = "retry  lock quota lock"
TERMS = T.keyword_terms(WORDS)


def obs_haystack():
    j = lambda c: F.array_join(F.col(c), " ")
    return T.joined(F.col("title"), F.col("subtitle"), j("facts"), j("concepts"), j("files"), F.col("narrative"))


_j = lambda c: f"coalesce(array_to_string({c},' '),'')"
OBS_HAY = f"lower(coalesce(title,'')||' '||coalesce(subtitle,'')||' '||{_j('facts')}||' '||{_j('concepts')}||' '||{_j('files')}||' '||coalesce(narrative,''))"
SUM_HAY = f"lower(coalesce(summary,'')||' '||{_j('keywords')})"
HITS = lambda hay: "(" + " + ".join(f"contains({hay}, '{t}')::INT" for t in TERMS) + ")"


def sum_haystack():
    return T.joined(F.col("summary"), F.array_join("keywords", " "))


@query(f"""WITH h AS (SELECT obs_id, observed_at, {HITS(OBS_HAY)} AS hits FROM observations)
SELECT obs_id, hits::BIGINT AS hits, round(hits / {len(TERMS)}.0, 6)::DOUBLE AS score,
row_number() OVER (ORDER BY hits DESC, observed_at DESC NULLS LAST, obs_id)::BIGINT AS rank
FROM h WHERE hits > 0 ORDER BY hits DESC, observed_at DESC NULLS LAST, obs_id LIMIT 20""")
def kw_topk(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.keyword_topk(table(spark, d, "observations"), obs_haystack(), WORDS, 20, F.col("observed_at"), "obs_id")
    return top.select("obs_id", *big("hits", "rank"), "score")


@query("""WITH h AS (SELECT doc_id, n_chars, contains(lower(text),'harbour')::INT + contains(lower(text),'bridge')::INT AS hits
FROM documents WHERE lang = 'en' AND source NOT IN ('coast-microfilm','valley-archive') AND text IS NOT NULL)
SELECT doc_id, hits::BIGINT AS hits FROM h WHERE hits > 0 ORDER BY hits DESC, n_chars DESC NULLS LAST, doc_id LIMIT 25""")
def kw_scoped(spark: SparkSession, d: str) -> DataFrame:
    docs = browse.scoped(table(spark, d, "documents").where("lang = 'en'"), "source", None, ["coast-microfilm", "valley-archive"])
    top = retrieval.keyword_topk(docs, F.lower("text"), "harbour bridge", 25, F.col("n_chars"), "doc_id")
    return top.select("doc_id", *big("hits"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("embedding is not null").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else [0.0]


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS score FROM embeddings)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s WHERE score IS NOT NULL ORDER BY score DESC, vec_id LIMIT 15""")
def sem_topk(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.semantic_topk(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 15, "vec_id")
    return top.select("vec_id", "score", *big("rank"))


@query(f"""WITH k AS (SELECT obs_id AS id, row_number() OVER (ORDER BY hits DESC, observed_at DESC NULLS LAST, obs_id) AS r
FROM (SELECT obs_id, observed_at, {HITS(OBS_HAY)} AS hits FROM observations) WHERE hits > 0 QUALIFY r <= 50),
q AS (SELECT embedding AS e FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM
(SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS score FROM embeddings) WHERE score IS NOT NULL QUALIFY r <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score, min(l)::BIGINT AS first_list FROM
(SELECT id, r, 0 AS l FROM k UNION ALL SELECT id, r, 1 FROM s) GROUP BY id ORDER BY score DESC, first_list, min(CASE WHEN l = 0 THEN r END), min(r) LIMIT 50""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    k = retrieval.keyword_topk(table(spark, d, "observations"), obs_haystack(), WORDS, 50, F.col("observed_at"), "obs_id").withColumnRenamed("obs_id", "id")
    s = retrieval.semantic_topk(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 50, "vec_id").withColumnRenamed("vec_id", "id")
    fused = retrieval.rrf([k, s], "id").orderBy(F.desc("score"), "first_list", "first_rank").limit(50)
    return fused.select("id", "score", *big("first_list"))


@query("""SELECT summary_id, CASE WHEN length(summary) > 180 THEN substr(summary,1,177)||'...' ELSE summary END AS title,
array_to_string(keywords[1:6], ', ') AS subtitle FROM session_summaries""")
def index_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_summaries").select("summary_id", T.index_title(F.col("summary")).alias("title"), F.array_join(F.slice("keywords", 1, 6), ", ").alias("subtitle"))


@query("""WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(n, 4) AS norm, CASE WHEN n IS NULL THEN NULL WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit FROM n""")
def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 4).alias("norm"), F.round(norm(normalise(F.col("embedding"))), 4).alias("unit"))


# ---- browse ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O','F') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 20")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return browse.page(o, [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "o_totalprice")


@query("""SELECT project_id, count(*) AS n, count(*) FILTER (WHERE obs_type='decision') AS decisions, count(DISTINCT session_id) AS sessions,
epoch_us(min(observed_at)) // 1000 AS first_ms, epoch_us(max(observed_at)) // 1000 AS last_ms FROM observations WHERE status='active' GROUP BY project_id""")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").where("status = 'active'")
    return o.groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("obs_type") == "decision").alias("decisions"), F.count_distinct("session_id").alias("sessions"),
        F.unix_millis(F.min("observed_at")).alias("first_ms"), F.unix_millis(F.max("observed_at")).alias("last_ms"),
    )


@query("""SELECT count(*) FILTER (WHERE day = DATE '2025-06-15') AS today, count(*) FILTER (WHERE day < DATE '2025-06-15' AND status='active') AS overdue,
count(*) FILTER (WHERE status='active') AS open, count(*) FILTER (WHERE obs_type='change') AS changes,
count(*) FILTER (WHERE day > DATE '2025-06-08' AND day <= DATE '2025-06-15') AS recent
FROM (SELECT status, obs_type, CAST((observed_at AT TIME ZONE 'UTC') + INTERVAL 8 HOUR AS DATE) AS day FROM observations)""")
def day_stats(spark: SparkSession, d: str) -> DataFrame:
    day = browse.local_day(F.col("observed_at"), "Asia/Taipei")
    o = table(spark, d, "observations").select("status", "obs_type", day.alias("day"))
    at, lo = F.lit("2025-06-15").cast("date"), F.lit("2025-06-08").cast("date")
    return o.agg(
        F.count_if(F.col("day") == at).alias("today"), F.count_if((F.col("day") < at) & (F.col("status") == "active")).alias("overdue"),
        F.count_if(F.col("status") == "active").alias("open"), F.count_if(F.col("obs_type") == "change").alias("changes"),
        F.count_if((F.col("day") > lo) & (F.col("day") <= at)).alias("recent"),
    )


@query("""WITH a AS (SELECT session_id AS s, transcript_offset AS t0 FROM thin_events WHERE event_id = 50),
e AS (SELECT event_id, transcript_offset AS t, t0 FROM thin_events JOIN a ON session_id = a.s)
(SELECT event_id, 'before' AS part FROM e WHERE t < t0 ORDER BY t DESC, event_id DESC LIMIT 5) UNION ALL
SELECT event_id, 'anchor' FROM e WHERE event_id = 50 UNION ALL (SELECT event_id, 'after' FROM e WHERE t > t0 ORDER BY t, event_id LIMIT 5)""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return browse.timeline(table(spark, d, "thin_events"), "session_id", F.col("transcript_offset"), "event_id", 50, 5, 5).select("event_id", "part")


@query("""WITH s AS (SELECT session_id AS s FROM thin_events WHERE event_id = 60), e AS (SELECT event_id, transcript_offset AS t, tool_name FROM thin_events JOIN s ON session_id = s.s),
b AS (SELECT min(t) AS a, max(t) AS z FROM e WHERE tool_name = 'Bash')
(SELECT event_id, 'before' AS part, false AS truncated FROM e, b WHERE t < a ORDER BY t DESC, event_id DESC LIMIT 3) UNION ALL
(SELECT event_id, 'within', (SELECT count(*) FROM e, b WHERE t BETWEEN a AND z) > 100 FROM e, b WHERE t BETWEEN a AND z ORDER BY t, event_id LIMIT 100) UNION ALL
(SELECT event_id, 'after', false FROM e, b WHERE t > z ORDER BY t, event_id LIMIT 3)""")
def timeline_range(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events")
    one = e.where("event_id = 60").select("session_id")
    e = e.join(F.broadcast(one), "session_id")  # one row
    return browse.timeline_range(e, F.col("tool_name") == "Bash", "session_id", F.col("transcript_offset"), "event_id", 3, 3)


@query("""SELECT obs_id, title, pos::BIGINT AS pos FROM (VALUES (0, 7), (1, 3), (2, 7), (3, -1), (4, 12)) v(pos, id) JOIN observations ON obs_id = id""")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    return browse.batch_get(table(spark, d, "observations"), "obs_id", [7, 3, 7, -1, 12]).select("obs_id", "title", *big("pos"))


@query("""WITH top AS (SELECT summary_id, project_id, session_id, summary FROM session_summaries WHERE summary IS NOT NULL ORDER BY updated_at DESC NULLS LAST, summary_id DESC LIMIT 12)
SELECT summary_id, CASE WHEN length(summary) > 60 THEN substr(summary,1,60)||'…' ELSE summary END AS excerpt,
coalesce((SELECT string_agg(obs_id, ',' ORDER BY observed_at NULLS FIRST, obs_id) FROM observations o WHERE o.project_id = top.project_id AND o.session_id = top.session_id), '') AS ids FROM top""")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    r = browse.recent_activity(
        table(spark, d, "session_summaries").where("summary is not null").select("summary_id", "project_id", "session_id", "summary", "updated_at"), table(spark, d, "observations"),
        "summary_id", [F.desc_nulls_last("updated_at"), F.desc("summary_id")], 12, ["project_id", "session_id"], "obs_id", F.col("observed_at"),
    )
    return r.select("summary_id", T.excerpt(F.col("summary"), 60).alias("excerpt"), F.array_join(F.col("observation_ids").cast("array<string>"), ",").alias("ids"))


# ---- aggregates --------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type='error') AS errors FROM events GROUP BY 1")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT tool_name, count(*) AS n, floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5)::BIGINT AS pct FROM thin_events GROUP BY tool_name")
def mode_mix(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "thin_events").groupBy("tool_name").agg(F.count("*").alias("n"))
    return g.select("tool_name", "n", F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))) + 0.5).alias("pct"))  # a row a tool


@query("""SELECT source, sum(n_chars)::BIGINT AS size, sum(least(n_chars, 2000))::BIGINT AS done, round(sum(least(n_chars, 2000)) / sum(n_chars)::DOUBLE, 6) AS share,
count(*) FILTER (WHERE least(n_chars,2000) >= 0.95 * n_chars) AS full_docs FROM documents WHERE n_chars > 0 GROUP BY source""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("n_chars > 0").withColumn("cp", F.least("n_chars", F.lit(2000)))
    return c.groupBy("source").agg(
        F.sum("n_chars").alias("size"), F.sum("cp").alias("done"), F.round(F.sum("cp") / F.sum("n_chars"), 6).alias("share"),
        F.count_if(F.col("cp") >= 0.95 * F.col("n_chars")).alias("full_docs"),
    )


@query("""SELECT project_id, count(*) AS n, count(embedding) AS embedded FROM (SELECT project_id, obs_id AS id FROM observations UNION ALL SELECT project_id, summary_id FROM session_summaries) u
LEFT JOIN embeddings ON vec_id = id GROUP BY project_id""")
def embed_coverage(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "observations").select("project_id", F.col("obs_id").alias("vec_id")).unionByName(table(spark, d, "session_summaries").select("project_id", F.col("summary_id").alias("vec_id")))
    return u.join(table(spark, d, "embeddings"), "vec_id", "left").groupBy("project_id").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p, count(value) AS n FROM events GROUP BY event_type""")
def p95(spark: SparkSession, d: str) -> DataFrame:
    return quality.percentile_nearest_rank(table(spark, d, "events"), "value", 0.95, ["event_type"])


@query("SELECT count(*) AS rows, md5(string_agg(n_nationkey || ':' || n_name || ':' || n_regionkey, '|' ORDER BY n_nationkey)) AS checksum FROM nation")
def dimension_checksum(spark: SparkSession, d: str) -> DataFrame:
    return quality.ordered_checksum(table(spark, d, "nation"), "n_nationkey", F.concat_ws(":", "n_nationkey", "n_name", "n_regionkey"))


@query("""WITH g AS (SELECT greatest(1, ceil(count(*) / 100.0))::BIGINT AS n0, ceil(greatest(1, ceil(count(*) / 100.0)) / 100.0)::BIGINT AS n1 FROM observations),
r AS (SELECT ('0x' || substr(md5(obs_id::VARCHAR), 1, 8))::BIGINT % n0 AS g, obs_id, md5(concat_ws(chr(31), obs_id, coalesce(project_id, chr(0)), coalesce(title, chr(0)), coalesce(narrative, chr(0)), coalesce(array_to_string(facts, chr(30)), chr(0)))) AS h FROM observations, g),
a AS (SELECT g, md5(string_agg(h, '|' ORDER BY obs_id)) AS h, count(*) AS n FROM r GROUP BY g),
b AS (SELECT g // 100 AS g, md5(string_agg(h, '|' ORDER BY g)) AS h, sum(n) AS n FROM a GROUP BY 1), c AS (SELECT 0 AS g, md5(string_agg(h, '|' ORDER BY g)) AS h, sum(n) AS n FROM b)
SELECT coalesce(sum(n), 0)::BIGINT AS rows, coalesce(CASE WHEN (SELECT n0 FROM g) = 1 THEN (SELECT any_value(h) FROM a) WHEN (SELECT n1 FROM g) = 1 THEN (SELECT any_value(h) FROM b) ELSE any_value(h) END, 'empty') AS checksum FROM c""")
def table_checksum(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit("\0"))
    row = F.concat_ws("\x1f", F.col("obs_id").cast("string"), z("project_id"), z("title"), z("narrative"), z(F.array_join("facts", "\x1e")))
    return quality.table_checksum(table(spark, d, "observations"), "obs_id", row, group_rows=100)


@query("SELECT project_id, session_id, count(*) AS n FROM observations WHERE status='active' AND session_id IS NOT NULL AND project_id IS NOT NULL GROUP BY 1,2 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "observations"), ["project_id", "session_id"], F.col("status") == "active")


@query("SELECT project_id, max_by(title, obs_id) AS title, max(obs_id) AS last_id, sum(discovery_tokens)::BIGINT AS tokens FROM observations GROUP BY project_id")
def counter_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").groupBy("project_id").agg(F.max_by("title", "obs_id").alias("title"), F.max("obs_id").alias("last_id"), F.sum("discovery_tokens").alias("tokens"))


# ---- windows -----------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return browse.latest_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("""WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY day) AS q FROM g)
SELECT user_id, round(avg(len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q)))::DOUBLE), 6) AS stability, count(*) AS pairs FROM p WHERE q IS NOT NULL GROUP BY user_id""")
def jaccard_runs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("s"))
    g = g.withColumn("q", F.lag("s").over(Window.partitionBy("user_id").orderBy("day"))).where("q is not null")  # one row a day
    return g.groupBy("user_id").agg(F.round(F.avg(quality.jaccard(F.col("s"), F.col("q"))), 6).alias("stability"), F.count("*").alias("pairs"))


RANGES = "SELECT l_orderkey AS k, (l_partkey % 500)::BIGINT AS start, ((l_partkey % 500) + l_quantity)::BIGINT AS \"end\" FROM lineitem"
MERGED = """SELECT k, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY start, "end") AS i FROM
(SELECT *, CASE WHEN max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS nw FROM r WHERE "end" > start)) GROUP BY k, i"""


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") % 500
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"))


@query(f"WITH r AS ({RANGES}) {MERGED}")
def range_merge(spark: SparkSession, d: str) -> DataFrame:
    return ranges.merge_ranges(_ranges(spark, d), ["k"], block=128)


@query(f"""WITH r AS ({RANGES}), m AS ({MERGED}), c AS (SELECT DISTINCT l_orderkey AS k, (l_suppkey % 500)::BIGINT AS start, (l_suppkey % 500 + 5)::BIGINT AS "end" FROM lineitem)
SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.k = c.k AND m.start <= c.start AND m."end" >= c."end")""")
def range_covered(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey") % 500
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), s.alias("start"), (s + 5).alias("end")).distinct()
    return ranges.covered(c, ranges.merge_ranges(_ranges(spark, d), ["k"], block=128), "k", 128)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_type, ts, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM e)
SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, count(*) AS length FROM f GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    s = quality.streaks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", days(F.col("ts"))).where("length >= 3")
    return s.select("user_id", "event_type", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), "length")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw, event_id FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g) SELECT user_id, i::BIGINT AS i, count(*) AS n, epoch_us(min(ts)) AS first_us FROM s GROUP BY user_id, i""")
def session_gap(spark: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    e = lagged(table(spark, d, "events").select("user_id", *order), ["user_id"], days(F.col("ts")), order, F.col("ts"), "was")
    new = F.when(F.col("ts") - F.col("was.v") <= F.expr("interval 6 hours"), 0).otherwise(1)
    e = running(e, ["user_id"], days(F.col("ts")), order, new, "i")
    return e.groupBy("user_id", "i").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"))


@query("""WITH t AS (SELECT session_id, writer_host, event_id FROM thin_events WHERE session_id IS NOT NULL AND writer_host IS NOT NULL),
f AS (SELECT session_id, min_by(writer_host, event_id) AS first_value, count(DISTINCT writer_host) AS n_values FROM t GROUP BY 1 HAVING count(DISTINCT writer_host) > 1)
SELECT session_id, first_value, n_values, min(event_id) AS first_conflict FROM t JOIN f USING (session_id) WHERE writer_host <> first_value GROUP BY 1, 2, 3""")
def host_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return quality.conflicting(table(spark, d, "thin_events").where("session_id is not null and writer_host is not null"), ["session_id"], "writer_host", "event_id")


# ---- joins and sets ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)")
def anti_due(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days")), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def semi_fk(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return quality.orphans(table(spark, d, "orders"), c, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, (l_partkey % 500)::BIGINT AS s, ((l_partkey % 500) + l_quantity)::BIGINT AS e FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_orderkey AS k, (l_suppkey % 500)::BIGINT AS s, ((l_suppkey % 500) + l_quantity)::BIGINT AS e FROM lineitem WHERE l_returnflag = 'N')
SELECT a.k, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end FROM a JOIN b ON a.k = b.k AND a.e > b.s AND a.s < b.e WHERE a.e > a.s AND b.e > b.s""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    def side(flag: str, c: str) -> DataFrame:
        s = F.col(c) % 500
        return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), s.alias("start"), (s + F.col("l_quantity")).cast("long").alias("end")).distinct()

    return ranges.overlaps(side("R", "l_partkey"), side("N", "l_suppkey"), ["k"], 64)


@query("""SELECT count(*) FILTER (WHERE o.obs_id IS NULL) AS missing, count(*) FILTER (WHERE o.status IS DISTINCT FROM v.status AND o.obs_id IS NOT NULL) AS different
FROM (VALUES (1,'active'),(2,'archived'),(-5,'active'),(3,NULL)) v(id, status) LEFT JOIN observations o ON o.obs_id = v.id""")
def state_mismatch(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([(1, "active"), (2, "archived"), (-5, "active"), (3, None)], "obs_id long, want string")
    o = table(spark, d, "observations").select("obs_id", "status", F.lit(True).alias("there"))
    j = want.join(o, "obs_id", "left")
    return j.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & ~F.col("status").eqNullSafe(F.col("want"))).alias("different"))


@query("SELECT session_id FROM thin_events WHERE session_id IS NOT NULL UNION SELECT session_id FROM stop_sentinels WHERE session_id IS NOT NULL")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    s = lambda n: table(spark, d, n).select("session_id").where("session_id is not null")
    return s("thin_events").union(s("stop_sentinels")).distinct()


@query("""SELECT 'left' AS side, count(*) AS n FROM (SELECT session_id FROM thin_events EXCEPT SELECT session_id FROM observations)
UNION ALL SELECT 'right', count(*) FROM (SELECT session_id FROM observations EXCEPT SELECT session_id FROM thin_events)""")
def sym_diff(spark: SparkSession, d: str) -> DataFrame:
    return quality.symmetric_difference(table(spark, d, "thin_events").select("session_id"), table(spark, d, "observations").select("session_id"))


@query("""SELECT source, kind FROM (SELECT source, 'missing' AS kind FROM mix_targets WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)
UNION ALL SELECT DISTINCT source, 'unexpected' FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mix_targets))""")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "mix_targets").select("source")
    have = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return want.subtract(have).withColumn("kind", F.lit("missing")).union(have.subtract(want).withColumn("kind", F.lit("unexpected")))


# ---- scalar functions --------------------------------------------------------------------------------------

_PUNCT = r"!-/:-@\[-`{-~"
_CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}"


@query(rf"""WITH t AS (SELECT summary_id, summary AS x, regexp_replace(summary, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS s FROM session_summaries)
SELECT summary_id, ceil((len(regexp_extract_all(x, '[{_CJK}]')) * 10 + len(regexp_extract_all(s, '[A-Za-z0-9]+')) * 13 + len(regexp_extract_all(x, '[{_PUNCT}\r\n]')) * 3
+ len(regexp_extract_all(x, '[^\s\x{{a0}}\x{{3000}}\x{{feff}}A-Za-z0-9{_CJK}{_PUNCT}]')) * 10 + 120) / 10.0)::BIGINT AS tokens FROM t""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_summaries").select("summary_id", T.token_estimate(F.col("summary")).cast("long").alias("tokens"))


@query(r"""SELECT summary_id, length(summary) + len(regexp_extract_all(summary, '[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3100}-\x{312f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]')) AS weighted,
(floor((len(regexp_extract_all(summary, '[\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]')) * 9 + length(summary) * 4) / 10.0) + 1)::BIGINT AS exam FROM session_summaries""")
def weighted_length(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("summary")
    return table(spark, d, "session_summaries").select("summary_id", T.content_length(s).cast("long").alias("weighted"), T.exam_token_estimate(s).cast("long").alias("exam"))


_SECRET = "narrative || ' AKIA' || lpad(obs_id::VARCHAR, 16, '0') || ' api_key = sk-' || repeat('a1', 12) || ' password: hunter2hunter2'"


@query(f"""SELECT obs_id, regexp_replace(regexp_replace(regexp_replace({_SECRET}, 'sk-[0-9A-Za-z_-]{{20,}}', '[REDACTED:openai_api_key]', 'g'), 'AKIA[0-9A-Z]{{16}}', '[REDACTED:aws_access_key]', 'g'),
'(password)(: )hunter2hunter2', '\\1\\2[REDACTED:labeled_secret]', 'g') AS safe FROM observations WHERE narrative IS NOT NULL""")
def redact(spark: SparkSession, d: str) -> DataFrame:
    secret = F.concat("narrative", F.lit(" AKIA"), F.lpad(F.col("obs_id").cast("string"), 16, "0"), F.lit(" api_key = sk-" + "a1" * 12 + " password: hunter2hunter2"))
    return table(spark, d, "observations").where("narrative is not null").select("obs_id", T.redact(secret).alias("safe"))


@query("""SELECT obs_id, sha256(coalesce(project_id,'') || chr(10) || coalesce(obs_type,'') || chr(10) || coalesce(narrative,'') || chr(10) || array_to_string(coalesce(facts, []), chr(31))) AS digest FROM observations""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(""))
    o = table(spark, d, "observations")
    return o.select("obs_id", T.content_hash(z("project_id"), z("obs_type"), z("narrative"), z(F.array_join("facts", "\x1f"))).alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_exists(props, '$.missing') AS has FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").isNotNull().alias("has"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'the')), chr(10)) AS kept FROM documents WHERE text IS NOT NULL""")
def strip_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.strip_lines_with(F.col("text"), "the").alias("kept"))


@query("""SELECT event_id, string_split(transcript_path, '/')[-1] AS name, regexp_replace('<Transcript >' || tool_name || '</observations>', '(?i)<(/?)(prior_summary|transcript|observations)\\s*>', '＜\\1\\2>', 'g') AS safe FROM thin_events""")
def path_and_prompt(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat(F.lit("<Transcript >"), "tool_name", F.lit("</observations>"))
    return table(spark, d, "thin_events").select("event_id", T.path_basename(F.col("transcript_path")).alias("name"), T.neutralise_prompt(tagged).alias("safe"))


@query("""SELECT o_orderkey, (a + greatest(1, (1706000000 - a) // (o_custkey % 9 + 1) // 86400 + 1) * (o_custkey % 9 + 1) * 86400)::BIGINT AS next_s
FROM (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT AS a FROM orders WHERE epoch(o_orderdate) <= 1706000000)""")
def recurrence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("a"), ((F.col("o_custkey") % 9 + 1) * 86400).alias("step")).where("a <= 1706000000")
    return o.select("o_orderkey", T.recurrence_next(F.col("a"), F.lit(1706000000).cast("long"), F.col("step")).cast("long").alias("next_s"))


@query("""WITH p AS (SELECT p.pending_id, substr(p.summary, 1, 300) AS n, s.summary AS o, list_distinct(list_concat(coalesce(s.next_steps, []), coalesce(p.next_steps, []))) AS x
FROM pending_summaries p JOIN session_summaries s ON s.summary_id = p.pending_id WHERE p.summary IS NOT NULL)
SELECT pending_id, CASE WHEN coalesce(o <> '' AND o <> n AND 298 - length(n) > 0, false) THEN right(o, 298 - length(n)) || chr(10) || chr(10) || n ELSE n END AS merged FROM p""")
def pending_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pending_summaries").where("summary is not null").select("pending_id", F.col("summary").alias("newer"))
    s = table(spark, d, "session_summaries").select(F.col("summary_id").alias("pending_id"), F.col("summary").alias("older"))
    return p.join(s, "pending_id").select("pending_id", T.merge_pending_text(F.col("older"), F.col("newer"), 300).alias("merged"))


# ---- mutation ----------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT doc_id, source, paper_id || '/' || coalesce(strftime(issue_date, '%Y-%m-%d'), '?') || '/' || page_no AS key, md5(text) AS dig, scanned_at >= TIMESTAMPTZ '2025-07-07 00:00:00+00' AS late FROM documents WHERE text IS NOT NULL),
cur AS (SELECT source, key, min(dig) AS dig FROM x WHERE NOT late GROUP BY 1, 2), inc AS (SELECT doc_id, source, key, dig FROM x WHERE late),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY source, key) AS fo, min_by(dig, doc_id) OVER (PARTITION BY source, key) AS fd FROM inc),
j AS (SELECT f.*, coalesce(cur.dig, CASE WHEN f.fo <> f.doc_id THEN f.fd END) AS against FROM f LEFT JOIN cur ON cur.source = f.source AND cur.key = f.key)
SELECT doc_id, CASE WHEN source IS NULL OR against IS NULL THEN 'insert' WHEN against = dig THEN 'idempotent' ELSE 'conflict' END AS verdict FROM j WHERE source IS NOT NULL""")
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    page = F.concat("paper_id", F.lit("/"), F.coalesce(F.date_format("issue_date", "yyyy-MM-dd"), F.lit("?")), F.lit("/"), F.col("page_no").cast("string"))
    x = docs.select("doc_id", "source", page.alias("key"), F.md5("text").alias("digest"), (F.col("scanned_at") >= F.lit("2025-07-07 00:00:00").cast("timestamp")).alias("late"))
    # pages scanned since a day arrive, those scanned before are there
    return mutate.classify_upsert(x.where(~F.col("late")), x.where("late"), ["source", "key"], "key", "digest", "doc_id").select("doc_id", "verdict")


@query("""SELECT coalesce(i.k, c.k) AS k, coalesce(i.status, c.status) AS status, coalesce(i.price, c.price) AS price, CASE WHEN i.k IS NULL THEN 'kept' WHEN c.k IS NULL THEN 'inserted' ELSE 'updated' END AS change
FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders) c
FULL JOIN (SELECT o_orderkey + 7 AS k, CASE WHEN o_orderstatus = 'O' THEN 'X' END AS status, o_totalprice * 2 AS price FROM orders WHERE o_totalprice > 1000) i ON i.k = c.k""")
def upsert_apply(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cur = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    inc = o.where("o_totalprice > 1000").select((F.col("o_orderkey") + 7).alias("k"), F.when(F.col("o_orderstatus") == "O", "X").alias("status"), (F.col("o_totalprice") * 2).alias("price"))
    return mutate.apply_upsert(cur, inc, "k", ["status", "price"])


@query("""SELECT session_id, min(sentinel_id) AS sentinel_id FROM stop_sentinels s WHERE session_id IS NOT NULL AND NOT EXISTS
(SELECT 1 FROM observations o WHERE o.session_id = s.session_id) GROUP BY session_id""")
def insert_new(spark: SparkSession, d: str) -> DataFrame:
    inc = table(spark, d, "stop_sentinels").where("session_id is not null").select("session_id", "sentinel_id")
    return mutate.insert_new(table(spark, d, "observations").select("session_id"), inc, ["session_id"], "sentinel_id")


@query("SELECT obs_id, CASE WHEN status='active' AND obs_type='change' THEN 'archived' ELSE status END AS status, coalesce(status='active' AND obs_type='change', false) AS changed FROM observations")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return mutate.soft_delete(table(spark, d, "observations").select("obs_id", "status", "obs_type"), F.col("obs_type") == "change").select("obs_id", "status", "changed")


@query("""SELECT o.n_nationkey, CASE WHEN p.after IS NOT NULL AND o.n_regionkey IS NOT DISTINCT FROM p.before THEN p.after ELSE o.n_regionkey END AS n_regionkey,
CASE WHEN p.after IS NOT NULL THEN o.n_regionkey IS NOT DISTINCT FROM p.before END AS applied
FROM nation o LEFT JOIN (VALUES (0, 0, 4), (1, 1, 3), (2, 0, 2)) p(k, before, after) ON p.k = o.n_nationkey""")
def guarded_rewrite(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.createDataFrame([(0, 0, 4), (1, 1, 3), (2, 0, 2)], "n_nationkey int, was int, will int")
    return mutate.guarded_rewrite(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), plan, "n_nationkey", {"n_regionkey": "was"}, {"n_regionkey": "will"})


# ---- capture and repair ------------------------------------------------------------------------------------

BOUNDS = """SELECT session_id, transcript_path, CASE WHEN transcript_offset >= 0 THEN transcript_offset END AS b FROM thin_events UNION ALL
SELECT session_id, transcript_path, CASE WHEN hwm_offset >= 0 THEN hwm_offset END FROM stop_sentinels"""


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events").select("session_id", "transcript_path", jsonl.boundary(F.col("transcript_offset"), F.lit(None)).alias("b"))
    s = table(spark, d, "stop_sentinels").select("session_id", "transcript_path", jsonl.boundary(F.lit(None), F.col("hwm_offset")).alias("b"))
    return e.unionByName(s)


@query(f"SELECT transcript_path, max(b) AS boundary, min(b) AS first_seen, count(*) AS records FROM ({BOUNDS}) WHERE transcript_path IS NOT NULL AND b IS NOT NULL GROUP BY transcript_path")
def spool_boundaries(spark: SparkSession, d: str) -> DataFrame:
    b = _bounds(spark, d).where("transcript_path is not null and b is not null")
    return b.groupBy("transcript_path").agg(F.max("b").alias("boundary"), F.min("b").alias("first_seen"), F.count("*").alias("records"))


@query(f"""WITH b AS (SELECT session_id, transcript_path, max(b) AS m FROM ({BOUNDS}) WHERE transcript_path IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
c AS (SELECT transcript_path, max(end_offset) AS done FROM transcript_chunks GROUP BY 1)
SELECT session_id, sum(greatest(0, m - coalesce(done, 0)))::BIGINT AS pending_bytes, sum(ceil(greatest(0, m - coalesce(done, 0)) / 32768.0))::BIGINT AS calls
FROM b LEFT JOIN c USING (transcript_path) GROUP BY session_id""")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    b = _bounds(spark, d).where("transcript_path is not null and b is not null").groupBy("session_id", "transcript_path").agg(F.max("b").alias("m"))
    c = table(spark, d, "transcript_chunks").groupBy("transcript_path").agg(F.max("end_offset").alias("done"))
    p = b.join(c, "transcript_path", "left").withColumn("p", F.greatest(F.lit(0), F.col("m") - F.coalesce("done", F.lit(0))))
    return p.groupBy("session_id").agg(F.sum("p").alias("pending_bytes"), F.sum(F.ceil(F.col("p") / 32768)).alias("calls"))


@query("""WITH seen AS (SELECT DISTINCT session_id AS session, transcript_path AS path, start_offset AS start, end_offset AS "end" FROM transcript_chunks WHERE session_id IS NOT NULL AND transcript_path IS NOT NULL AND end_offset > start_offset),
w AS (SELECT DISTINCT session_id AS session, transcript_path AS path, transcript_offset AS start, transcript_offset + 1 AS "end" FROM thin_events WHERE session_id IS NOT NULL AND transcript_path IS NOT NULL AND transcript_offset >= 0),
p AS (SELECT session, count(DISTINCT path) AS paths, min(path) AS one, max("end") AS last FROM seen GROUP BY 1),
m AS (SELECT w.*, max(s."end") AS far FROM w LEFT JOIN seen s ON s.session = w.session AND s.path = w.path AND s.start <= w.start GROUP BY ALL)
SELECT m.session, m.path, m.start, m."end", CASE WHEN far >= m."end" THEN 'ok' WHEN paths IS NULL OR paths <> 1 OR one <> m.path THEN 'rollup-order-unknown' WHEN last > m.start THEN 'later-rollup-exists' ELSE 'ok' END AS verdict
FROM m LEFT JOIN p ON p.session = m.session""")
def late_verdict(spark: SparkSession, d: str) -> DataFrame:
    # chunks are taken in, the bytes of events arrive
    at, keys = F.col("transcript_offset"), [F.col("session_id").alias("session"), F.col("transcript_path").alias("path")]
    w = table(spark, d, "thin_events").where("session_id is not null and transcript_path is not null and transcript_offset >= 0").select(*keys, at.alias("start"), (at + 1).alias("end")).distinct()
    seen = table(spark, d, "transcript_chunks").where("session_id is not null and transcript_path is not null and end_offset > start_offset")
    return ranges.late_verdict(w, seen.select(*keys, F.col("start_offset").alias("start"), F.col("end_offset").alias("end")).distinct())


@query("""WITH RECURSIVE c AS (SELECT chunk_id, raw, strlen(raw)::BIGINT AS n FROM transcript_chunks WHERE raw <> ''),
l AS (SELECT * FROM (SELECT chunk_id, n, sum(strlen(x) + 1) OVER (PARTITION BY chunk_id ORDER BY k)::BIGINT AS e FROM (SELECT chunk_id, n, unnest(string_split(raw, chr(10))) AS x, generate_subscripts(string_split(raw, chr(10)), 1) AS k FROM c)) WHERE e <= n),
h AS (SELECT chunk_id, sum(strlen(x)) OVER (PARTITION BY chunk_id ORDER BY k)::BIGINT AS e FROM (SELECT chunk_id, unnest(regexp_extract_all(raw, '(?s).')) AS x, generate_subscripts(regexp_extract_all(raw, '(?s).'), 1) AS k FROM c WHERE n > 32768)),
w AS (SELECT chunk_id, n, 0::BIGINT AS a, 0::BIGINT AS z, -1 AS no FROM c UNION ALL
SELECT w.chunk_id, w.n, w.z, CASE WHEN w.z + 32768 >= w.n THEN w.n ELSE coalesce((SELECT max(e) FROM l WHERE l.chunk_id = w.chunk_id AND e > w.z AND e <= w.z + 32768), (SELECT max(e) FROM h WHERE h.chunk_id = w.chunk_id AND e > w.z AND e <= w.z + 32768)) END, no + 1 FROM w WHERE w.z < w.n)
SELECT chunk_id, no::INT AS window_no, a AS start, z AS "end" FROM w WHERE no >= 0""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return capture.byte_windows(table(spark, d, "transcript_chunks").where("raw is not null"), "chunk_id", "raw", 32 * 1024)


@query("""WITH RECURSIVE o AS (SELECT session_id, obs_id, strlen(to_json({'title': title, 'facts': facts, 'narrative': narrative})::VARCHAR)::BIGINT AS size, coalesce(obs_type = 'decision', false) AS first, observed_at AS t FROM observations WHERE session_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first DESC, t DESC NULLS LAST, obs_id DESC) AS rn FROM o WHERE size <= 16384),
r AS (SELECT session_id, obs_id, size, rn, 16384 - size AS room, true AS take FROM n WHERE rn = 1 UNION ALL
SELECT n.session_id, n.obs_id, n.size, n.rn, CASE WHEN n.size <= r.room THEN r.room - n.size ELSE r.room END, n.size <= r.room FROM r JOIN n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
SELECT session_id, obs_id, size FROM r WHERE take""")
def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").select("session_id", "obs_id", (F.col("obs_type") == "decision").alias("first"), F.unix_micros("observed_at").alias("t"), F.octet_length(F.to_json(F.struct("title", "facts", "narrative"))).cast("long").alias("size"))
    return capture.greedy_fit(o, "session_id", "obs_id", "first", "t", "size", 16 * 1024)


@query("""WITH s AS (SELECT session_id, count(DISTINCT project_id) AS ids, min(project_id) AS target FROM thin_events WHERE session_id IS NOT NULL AND project_id IS NOT NULL GROUP BY 1)
SELECT o.obs_id, CASE WHEN s.ids IS NULL THEN 'missing evidence' WHEN s.ids > 1 THEN 'ambiguous' WHEN s.target = o.project_id THEN 'unchanged' ELSE 'update' END AS action,
CASE WHEN s.ids = 1 THEN s.target END AS target FROM observations o LEFT JOIN s ON s.session_id = o.session_id""")
def remap_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "thin_events").where("session_id is not null and project_id is not null").groupBy("session_id").agg(F.count_distinct("project_id").alias("ids"), F.min("project_id").alias("to"))
    o = table(spark, d, "observations").select("obs_id", "session_id", "project_id").join(s, "session_id", "left")
    a = F.when(F.col("ids").isNull(), "missing evidence").when(F.col("ids") > 1, "ambiguous").when(F.col("to") == F.col("project_id"), "unchanged").otherwise("update")
    return o.select("obs_id", a.alias("action"), F.when(F.col("ids") == 1, F.col("to")).alias("target"))


@query("""WITH l AS (SELECT session_id, count(*) AS linked FROM observations GROUP BY 1), r AS (SELECT summary_id, s.session_id, coalesce(linked, 0) AS linked, updated_at FROM session_summaries s LEFT JOIN l USING (session_id) WHERE s.session_id IS NOT NULL)
SELECT session_id, first(summary_id ORDER BY linked DESC, updated_at NULLS FIRST, summary_id) AS survivor, count(*) - 1 AS merged FROM r GROUP BY session_id HAVING count(*) > 1""")
def merge_survivor(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "observations").groupBy("session_id").agg(F.count("*").alias("linked"))
    s = table(spark, d, "session_summaries").where("session_id is not null").join(linked, "session_id", "left")
    rank = F.struct(-F.coalesce("linked", F.lit(0)), F.col("updated_at"), F.col("summary_id"))
    g = s.groupBy("session_id").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    return g.select("session_id", F.col("best.summary_id").alias("survivor"), (F.col("n") - 1).alias("merged"))


@query(f"""WITH s AS (SELECT transcript_path AS path, max(end_offset) AS c FROM transcript_chunks GROUP BY 1),
b AS (SELECT transcript_path AS path, max(b) AS m FROM ({BOUNDS}) WHERE transcript_path IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT path, coalesce(c, m) AS start, m AS "end", c IS NULL AS baseline FROM b LEFT JOIN s USING (path) WHERE c IS NULL OR m > c""")
def advance_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "transcript_chunks")  # what has been captured
    st = done.select(F.col("transcript_path").alias("path"), F.col("end_offset").alias("checkpoint"))
    return state.advance_checkpoints(st, _bounds(spark, d).select(F.col("transcript_path").alias("path"), F.col("b").alias("boundary")))


@query("""WITH e AS (SELECT session_id AS session, max(observed_at) AS last_event FROM observations WHERE session_id IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT session_id AS session FROM stop_sentinels WHERE session_id IS NOT NULL), p AS (SELECT session_id AS session, count(*) AS pending FROM pending_summaries WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session FROM e LEFT JOIN p USING (session) LEFT JOIN c USING (session) WHERE coalesce(pending, 0) = 0 AND (c.session IS NOT NULL OR epoch_us(TIMESTAMPTZ '2025-06-15 00:00:00+00') - epoch_us(last_event) >= 21600000000)""")
def finalise_due(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "observations").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.max("observed_at").alias("last_event"))
    c = table(spark, d, "stop_sentinels").where("session_id is not null").select(F.col("session_id").alias("session"), F.lit(True).alias("closed")).distinct()
    p = table(spark, d, "pending_summaries").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.count("*").alias("pending"))
    s = e.join(c, "session", "left").join(p, "session", "left").withColumn("backfill", F.lit(False))
    return state.finalise_due(s, F.lit("2025-06-15 00:00:00").cast("timestamp")).select("session")


@query("""WITH c AS (SELECT session_id AS session, max_by(summary, summary_id) AS summary, count(*) AS n, min(summary_id) AS first_id FROM session_summaries WHERE session_id IS NOT NULL GROUP BY 1),
w AS (SELECT session_id AS session, max_by(narrative, obs_id) AS summary, count(*) AS n, sum(discovery_tokens)::BIGINT AS t, string_agg(obs_id, ',' ORDER BY obs_id) AS ids FROM observations WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session, coalesce(w.summary, c.summary) AS summary, (coalesce(c.n, 0) + coalesce(w.n, 0))::BIGINT AS summarize_count, coalesce(w.t, 0)::BIGINT AS discovery_tokens, coalesce(ids, '') AS ids FROM c FULL JOIN w USING (session)""")
def fold_rollups(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_summaries").where("session_id is not null")
    cur = s.groupBy(F.col("session_id").alias("session")).agg(F.max_by("summary", "summary_id").alias("summary"), F.count("*").alias("summarize_count"))
    cur = cur.withColumn("discovery_tokens", F.lit(0).cast("long")).withColumn("observation_ids", F.expr("cast(array() as array<bigint>)"))
    o = table(spark, d, "observations").where("session_id is not null")
    w = o.select(F.col("session_id").alias("session"), F.col("narrative").alias("summary"), "discovery_tokens", F.array("obs_id").alias("observation_ids"), F.col("obs_id").alias("end"))
    r = state.fold_rollups(cur, w)
    return r.select("session", "summary", "summarize_count", "discovery_tokens", F.array_join(F.col("observation_ids").cast("array<string>"), ",").alias("ids"))


@query("""WITH b AS (SELECT user_id, event_id, ts, CASE WHEN value >= 90 THEN 'high' WHEN value >= 70 THEN 'warn' ELSE 'ok' END AS band FROM events),
l AS (SELECT *, lag(band) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM b) SELECT user_id, event_id, band FROM l WHERE band = 'warn' AND was IS DISTINCT FROM 'warn'""")
def band_crossings(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(v >= 90, "high").when(v >= 70, "warn").otherwise("ok").alias("band"))
    e = lagged(e, ["user_id"], days(F.col("ts")), ["ts", "event_id"], F.col("band"), "was")
    return e.where((F.col("band") == "warn") & ~F.col("was.v").eqNullSafe(F.lit("warn"))).select("user_id", "event_id", "band")
