"""Queries of joins, orders, mutation, evaluation and repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import provider
from weftline.operators import evaluate, mutate, quality, repair, search, state
from weftline.operators.search import Search
from weftline.plans.capture_queries import NOW_SQL, now
from weftline.plans.core_queries import query
from weftline.plans.search_queries import memories
from weftline.session import cut, table

# ---- joins, orders, sets -------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT project_id, session_id AS sid, len(decisions) > 0 AS fin FROM session_summaries)
SELECT o.session_id, o.project_id, count(*) AS n, coalesce(bool_or(fin), false) AS finalised, epoch_us(max(o.created_at)) // 1000 AS last_ms FROM observations o LEFT JOIN (SELECT project_id, sid, bool_or(fin) AS fin FROM m GROUP BY 1, 2) m ON m.sid = o.session_id AND m.project_id = o.project_id
WHERE o.session_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def finalised_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with enough observations and whether their rollup, found by the session in its metadata, is finalised."""
    meta = F.to_json(F.struct(F.struct("session_id", F.when(F.size("decisions") > 0, "x").alias("finalized_at")).alias("capture")))
    v = F.try_parse_json(meta)
    s = table(spark, d, "session_summaries").select("project_id", F.try_variant_get(v, "$.capture.session_id", "string").alias("session_id"), F.try_variant_get(v, "$.capture.finalized_at", "string").isNotNull().alias("f"))
    s = s.groupBy("project_id", "session_id").agg(F.bool_or("f").alias("f"))  # joined after pre-aggregation: no session multiplies
    o = table(spark, d, "observations").where("session_id is not null").groupBy("session_id", "project_id").agg(F.count("*").alias("n"), F.max("created_at").alias("t")).where("n >= 2")
    return o.join(s, ["project_id", "session_id"], "left").select("session_id", "project_id", "n", F.coalesce("f", F.lit(False)).alias("finalised"), F.unix_millis("t").alias("last_ms"))


@query("""SELECT s.session_id, count(o.obs_id) AS n FROM (SELECT DISTINCT session_id FROM stop_sentinels WHERE session_id IS NOT NULL) s LEFT JOIN observations o ON o.session_id = s.session_id GROUP BY 1 HAVING count(o.obs_id) < 3""")
def poor_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").groupBy("session_id").agg(F.count("obs_id").alias("n"))
    s = table(spark, d, "stop_sentinels").where("session_id is not null").select("session_id").distinct()
    return s.join(o, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n")).where("n < 3")


@query("""SELECT v.id, obs_id IS NOT NULL AS found, obs_id IS NULL AND summary_id IS NOT NULL AS is_memory FROM (VALUES (3), (7), (-5), (100000000)) v(id) LEFT JOIN observations ON obs_id = v.id LEFT JOIN session_summaries ON summary_id = CASE WHEN v.id < 0 THEN -v.id ELSE v.id END""")
def id_hint(spark: SparkSession, d: str) -> DataFrame:
    """Which of the ids asked for are no observations but memories (their ids are negative here)."""
    want = spark.createDataFrame([(3,), (7,), (-5,), (100000000,)], "id int")
    o, s = table(spark, d, "observations").select(F.col("obs_id").alias("id"), F.lit(True).alias("o")), table(spark, d, "session_summaries").select(F.col("summary_id").alias("m"), F.lit(True).alias("s"))
    j = want.join(o, "id", "left").join(s, F.abs("id") == F.col("m"), "left")
    return j.select("id", F.col("o").isNotNull().alias("found"), (F.col("o").isNull() & F.col("s").isNotNull()).alias("is_memory"))


@query("SELECT session_id FROM thin_events WHERE session_id IS NOT NULL INTERSECT SELECT session_id FROM observations INTERSECT SELECT session_id FROM session_summaries")
def common_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = lambda n: table(spark, d, n).select("session_id").where("session_id is not null")
    return s("thin_events").intersect(s("observations")).intersect(s("session_summaries"))


_CATALOG = ("observations", "session_summaries", "thin_events", "documents")


@query(f"SELECT table_name, column_name, ordinal_position::BIGINT AS position FROM information_schema.columns WHERE table_name IN {_CATALOG}")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of tables, as their files declare them."""
    rows = [(t, f.name, k) for t in _CATALOG for k, f in enumerate(table(spark, d, t).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position long")


@query("""WITH c AS (SELECT transcript_path AS path FROM transcript_chunks WHERE transcript_path IS NOT NULL UNION SELECT transcript_path FROM stop_sentinels WHERE transcript_path IS NOT NULL), k AS (SELECT path AS cursor FROM c ORDER BY path OFFSET 20 LIMIT 1)
SELECT path, row_number() OVER (ORDER BY path <= cursor, path)::BIGINT AS place FROM c, k QUALIFY place <= 40""")
def rotation_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from weftline.operators.progress import rotated

    p = lambda n: table(spark, d, n).select(F.col("transcript_path").alias("path")).where("path is not null")
    paths = p("transcript_chunks").union(p("stop_sentinels")).distinct()
    cursor = paths.orderBy("path").offset(20).limit(1).first()
    order = rotated(F.col("path"), cursor[0] if cursor else None)
    top = paths.orderBy(*order).limit(40)
    return top.select("path", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long").alias("place"))


@query("SELECT project_id, arg_min(obs_id, (status <> 'active', obs_id)) AS obs_id FROM observations GROUP BY 1")
def active_first(spark: SparkSession, d: str) -> DataFrame:
    """Of each project one row, an active one if there is any: a grouped minimum, nothing is sorted."""
    o = table(spark, d, "observations").groupBy("project_id").agg(F.min(F.struct((F.col("status") != "active").alias("s"), "obs_id")).alias("b"))
    return o.select("project_id", "b.obs_id")


@query("SELECT summary_id FROM session_summaries ORDER BY coalesce(nullif(session_id, ''), project_id) NULLS FIRST, summary_id LIMIT 30")
def coalesce_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_summaries").orderBy(F.coalesce(F.nullif("session_id", F.lit("")), F.col("project_id")).asc_nulls_first(), "summary_id").limit(30).select("summary_id")


@query("""SELECT chunk_id, row_number() OVER (ORDER BY provider NULLS FIRST, session_id NULLS FIRST, start_offset NULLS FIRST, end_offset NULLS FIRST, chunk_id)::BIGINT AS place FROM transcript_chunks QUALIFY place <= 50""")
def replay_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "transcript_chunks").select("chunk_id", F.col("provider").alias("project"), F.col("session_id").alias("session"), F.col("start_offset").alias("spool_start"), F.col("end_offset").alias("spool_end"))
    top = c.orderBy(*evaluate.replay_order(), "chunk_id").limit(50)
    return top.select("chunk_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*evaluate.replay_order(), "chunk_id")).cast("long").alias("place"))


@query("""WITH s AS (SELECT session_id, min(project_id) AS project FROM observations WHERE session_id IS NOT NULL GROUP BY 1), z AS (SELECT project, count(*) AS size FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY md5('7:' || session_id), session_id) AS r FROM s) SELECT session_id, project FROM r JOIN z USING (project) ORDER BY r, size DESC, project LIMIT 40""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "observations").where("session_id is not null").groupBy("session_id").agg(F.min("project_id").alias("project"))
    return evaluate.stratified(s, "project", "session_id", 40, 7)


@query(r"SELECT writer_host, max(spool_relpath) FILTER (WHERE regexp_matches(spool_relpath, '\.jsonl$')) AS latest FROM sealed_manifest GROUP BY 1")
def latest_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sealed_manifest").groupBy("writer_host").agg(F.max(F.when(F.col("spool_relpath").rlike(r"\.jsonl$"), F.col("spool_relpath"))).alias("latest"))


@query("SELECT p, EXISTS (SELECT 1 FROM observations WHERE project_id = p) OR EXISTS (SELECT 1 FROM session_summaries WHERE project_id = p) AS known FROM (SELECT min(project_id) AS p FROM session_summaries UNION ALL SELECT 'no such project')")
def known_projects(spark: SparkSession, d: str) -> DataFrame:
    o, s = table(spark, d, "observations"), table(spark, d, "session_summaries")
    asked = [s.agg(F.min("project_id")).first()[0], "no such project"]
    return spark.createDataFrame([(p, evaluate.exists_any(o.where(F.col("project_id") == p), s.where(F.col("project_id") == p))) for p in asked], "p string, known boolean")


# ---- mutation ------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select(F.col("obs_id").alias("id"), F.col("project_id").alias("project"), F.col("session_id").alias("session"), F.md5("title").alias("key"), "status", F.col("observed_at").alias("created_at"))


@query("""WITH p AS (SELECT project_id, md5(title) AS k FROM observations WHERE status = 'active' ORDER BY obs_id LIMIT 1),
h AS (SELECT max((observed_at, obs_id)).obs_id AS id FROM (SELECT observed_at, obs_id FROM observations, p WHERE observations.project_id = p.project_id AND md5(title) = k AND status = 'active' AND epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(observed_at) < 400 * 86400 * 1000000::BIGINT))
SELECT obs_id AS id, CASE WHEN obs_id = h.id THEN 'archived' ELSE status END AS status, coalesce(obs_id = h.id, false) AS changed FROM observations, h""".replace("max((observed_at, obs_id)).obs_id", "arg_max(obs_id, (observed_at, obs_id))"))
def undo_recent(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    p = r.where("status = 'active'").orderBy("id").limit(1).first()
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return mutate.undo_recent(r, p.project, p.key, at, 400 * 86400).select("id", "status", "changed")


@query("""WITH r AS (SELECT DISTINCT obs_id AS id, project_id AS project FROM observations WHERE obs_type = 'change' UNION SELECT obs_id, 'another' FROM observations WHERE obs_type = 'bugfix'),
j AS (SELECT o.obs_id AS id, o.status, r.id IS NOT NULL AND o.status = 'active' AS changed FROM observations o LEFT JOIN r ON r.id = o.obs_id AND r.project = o.project_id)
SELECT id, CASE WHEN changed THEN 'archived' ELSE status END AS status, changed, CASE WHEN changed THEN '2025-06-15' END AS noted, id % 2 = 0 AS kept FROM j""")
def refine_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows archived with a note in their metadata; what the metadata held before stays."""
    o = table(spark, d, "observations")
    rows = o.select(F.col("obs_id").alias("id"), F.col("project_id").alias("project"), "status", F.when(F.col("obs_id") % 2 == 0, F.lit('{"a": [1, "x"]}')).alias("metadata"))
    ask = o.where("obs_type = 'change'").select(F.col("obs_id").alias("id"), F.col("project_id").alias("project")).union(o.where("obs_type = 'bugfix'").select("obs_id", F.lit("another")))
    r = mutate.refine_delete(rows, ask, F.lit("2025-06-15"))
    v = F.try_parse_json("metadata")
    return r.select("id", "status", "changed", F.try_variant_get(v, "$.refine.deleted.at", "string").alias("noted"), F.try_variant_get(v, "$.a[1]", "string").eqNullSafe(F.lit("x")).alias("kept"))


@query("SELECT obs_id AS id FROM observations WHERE obs_type = 'bugfix' UNION SELECT obs_id FROM observations WHERE obs_type = 'change' AND status <> 'active'")
def refine_not_found(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    rows = o.select(F.col("obs_id").alias("id"), F.col("project_id").alias("project"), "status")
    ask = o.where("obs_type = 'change'").select(F.col("obs_id").alias("id"), F.col("project_id").alias("project")).union(o.where("obs_type = 'bugfix'").select("obs_id", F.lit("another")))
    return mutate.not_found(ask, rows).select("id")


@query("""SELECT o.obs_id, embedding IS NULL AND trim(title) <> '' AS filled, CASE WHEN embedding IS NULL AND trim(title) = '' THEN NULL ELSE true END AS has FROM observations o LEFT JOIN embeddings ON vec_id = obs_id""")
def vector_backfill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), "embedding")
    o = table(spark, d, "observations").select("obs_id", "title").join(e, "obs_id", "left")
    f = provider.backfill(o, "obs_id", "title", "embedding", provider.stub_vector(64))
    return f.select("obs_id", "filled", F.when(F.col("embedding").isNotNull(), True).alias("has"))


@query("SELECT summary_id, trim(summary) AS first_line, 0::BIGINT AS provider FROM session_summaries WHERE summary IS NOT NULL AND regexp_full_match(summary, '[A-Za-z .,]{1,180}')")
def stub_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extraction behind two providers, the first of which always fails."""
    s = table(spark, d, "session_summaries").where(F.col("summary").rlike("^[A-Za-z .,]{1,180}$"))
    e = provider.extract(s, "summary_id", "summary", [_failing, provider.stub_extraction])
    return e.select("summary_id", F.try_variant_get(F.try_parse_json("extraction"), "$.summary", "string").alias("first_line"), (F.col("provider") - 1).cast("long").alias("provider"))


def _failing(text: str) -> str:
    raise RuntimeError("unavailable")


@query("SELECT count(*) FILTER (WHERE obs_type = 'decision') AS rows, count(*) FILTER (WHERE obs_type = 'decision') AS copied, true AS may_delete FROM observations")
def personal_copy(spark: SparkSession, d: str) -> DataFrame:
    """Rows copied to another table, and whether their checksums there allow deleting them here."""
    o = table(spark, d, "observations").select("obs_id", "project_id", "title", "obs_type")
    target = o.where("obs_type = 'decision'").orderBy("obs_id").limit(3)  # some are there already
    row = F.concat_ws("|", F.col("obs_id").cast("string"), "project_id", "title")
    _, gate = repair.copy_rows(o, target, "obs_id", F.col("obs_type") == "decision", lambda x: quality.table_checksum(x, "obs_id", row))
    return gate


# ---- evaluation ----------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT q, obs_id, project_id, row_number() OVER (PARTITION BY q ORDER BY observed_at DESC NULLS LAST, obs_id)::INT AS r FROM (VALUES ('lock'), ('retry'), ('quota')) v(q) JOIN observations ON contains(lower(title), q) QUALIFY r <= 10)
SELECT q AS query, count(*)::INT AS n, string_agg(obs_id, ',' ORDER BY r) AS ids, true AS valid FROM h GROUP BY q""")
def search_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Results of searches kept as lists in order of rank."""
    from pyspark.sql import Window

    o = table(spark, d, "observations").select("obs_id", F.col("project_id").alias("project"), "observed_at", F.lower("title").alias("t"))
    order = [F.desc_nulls_last("observed_at"), F.asc("obs_id")]
    pages = None
    for q in ("lock", "retry", "quota"):
        top = o.where(F.col("t").contains(q)).orderBy(*order).limit(10)
        page = top.select(F.lit(q).alias("query"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"), F.col("obs_id").alias("id"), "project", F.lit(None).cast("double").alias("score"))
        pages = page if pages is None else pages.unionByName(page)
    return evaluate.feedback(pages).select("query", "n", F.array_join("result_ids", ",").alias("ids"), "valid")


_GRADE = "list_extract(['correct', 'partial', 'no_answer', 'wrong', 'confident_wrong'], (({x}) % 5 + 1)::INT)"
_SCORE = "CASE {x} WHEN 'correct' THEN 3 WHEN 'partial' THEN 2 WHEN 'no_answer' THEN 1 WHEN 'wrong' THEN 0 ELSE -1 END"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("correct", "partial", "no_answer", "wrong", "confident_wrong")])
    e = table(spark, d, "events")
    grade = lambda g, s, x: e.select(F.col("event_id").alias("question"), F.lit(g).alias("grader"), F.lit(s).alias("system"), F.get(names, (x % 5).cast("int")).alias("verdict"))
    i, u = F.col("event_id"), F.col("user_id")
    g = grade(1, "a", i).unionByName(grade(1, "b", u)).unionByName(grade(2, "a", i + u % 2)).unionByName(grade(2, "b", u))
    return state.resolve_verdicts(g, {"correct": 3, "partial": 2, "no_answer": 1, "wrong": 0, "confident_wrong": -1}, ("a", "b"))


_RESOLVED = f"""g AS (SELECT event_id AS question, {_GRADE.format(x='event_id')} AS a1, {_GRADE.format(x='user_id')} AS b1, {_GRADE.format(x='event_id + user_id % 2')} AS a2, {_GRADE.format(x='user_id')} AS b2 FROM events),
s AS (SELECT *, sign({_SCORE.format(x='a1')} - {_SCORE.format(x='b1')}) AS w1, sign({_SCORE.format(x='a2')} - {_SCORE.format(x='b2')}) AS w2 FROM g),
v AS (SELECT question, CASE WHEN w1 <> w2 THEN 'undecided' WHEN w1 > 0 THEN 'a' WHEN w1 < 0 THEN 'b' ELSE 'tie' END AS winner,
CASE WHEN a1 = a2 THEN a1 WHEN w1 <> w2 THEN 'DISAGREE' WHEN {_SCORE.format(x='a1')} <= {_SCORE.format(x='a2')} THEN a1 ELSE a2 END AS final_a, b1 AS final_b FROM s)"""


@query(f"WITH {_RESOLVED} SELECT * FROM v")
def exam_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"""WITH {_RESOLVED}, c AS (SELECT count(*) FILTER (WHERE winner = 'a') AS a, count(*) FILTER (WHERE winner = 'b') AS b, count(*) FILTER (WHERE winner = 'tie') AS t, count(*) FILTER (WHERE winner = 'undecided') AS u,
count(*) FILTER (WHERE final_a = 'confident_wrong') AS ca, count(*) FILTER (WHERE final_b = 'confident_wrong') AS cb FROM v), k AS (SELECT count(*) AS n, sum(user_id)::BIGINT AS turns FROM events)
SELECT 'a' AS system, a AS win, t AS tie, b AS loss, u AS undecided, ca AS confident_wrong, n AS cost, turns FROM c, k UNION ALL SELECT 'b', b, t, a, u, cb, n * 2, turns FROM c, k""")
def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    answers = e.select(F.col("event_id").alias("question"), F.lit("a").alias("system"), F.lit(1).alias("cost"), F.col("user_id").alias("turns")).unionByName(e.select(F.col("event_id").alias("question"), F.lit("b").alias("system"), F.lit(2).alias("cost"), F.col("user_id").alias("turns")))
    return evaluate.verdict_tally(_verdicts(spark, d), answers, ("a", "b"))


@query("""SELECT count(*) AS n, round(avg(abs(length(title) / 4.0 - discovery_tokens) / discovery_tokens::DOUBLE), 6)::DOUBLE AS mean_error, count(*) FILTER (WHERE abs(length(title) / 4.0 - discovery_tokens) / discovery_tokens::DOUBLE <= 0.2) AS within FROM observations WHERE discovery_tokens > 0 AND title IS NOT NULL""")
def estimator_error(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").where("title is not null")
    return evaluate.estimator_error(o, F.char_length("title") / 4, F.col("discovery_tokens"))


@query("""WITH r AS (SELECT obs_type AS query, project_id AS project FROM observations UNION ALL SELECT 'unnamed', NULL FROM nation), p AS (SELECT min(project_id) AS scope FROM observations),
g AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE project = scope) AS own, count(*) FILTER (WHERE coalesce(project, '') = '') AS un FROM r, p GROUP BY 1), w AS (SELECT *, CASE WHEN un > 0 THEN 'no project named' WHEN n >= 50 AND own < 5 THEN 'saturated' END AS why FROM g)
SELECT query, why IS NULL AS verified, CASE WHEN why IS NULL THEN own ELSE 0 END AS kept, CASE WHEN why IS NULL THEN n - own ELSE 0 END AS excluded, coalesce(why, 'ok') AS reason FROM w""")
def scope_verification(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    r = o.select(F.col("obs_type").alias("query"), F.col("project_id").alias("project")).unionByName(table(spark, d, "nation").select(F.lit("unnamed").alias("query"), F.lit(None).cast("string").alias("project")))
    return evaluate.verify_scope(r, o.agg(F.min("project_id")).first()[0])


@query("""WITH c AS (SELECT count(*) AS active, count(embedding) AS embedded FROM observations LEFT JOIN embeddings ON vec_id = obs_id WHERE status = 'active')
SELECT 'PARTIAL' AS status, 'real queries' || CASE WHEN active = 0 THEN ', no corpus' ELSE '' END || CASE WHEN embedded < active THEN ', embeddings' ELSE '' END AS issues FROM c""")
def report_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), "embedding")
    n = lambda v, c: F.lit(v).alias(c)
    o = table(spark, d, "observations").where("status = 'active'").join(e, "obs_id", "left").agg(F.count("*").alias("active"), F.count("embedding").alias("embedded"))
    return evaluate.completeness(o.select("*", n(10, "fixed"), n(10, "fixed_wanted"), n(3, "real"), n(20, "real_wanted"), n(0, "unverified"), n(0, "drill_errors")))


@query("""WITH v(q) AS (VALUES ('lock'), ('retry'), ('snapshot')), t AS (SELECT q, summary_id, session_id, row_number() OVER (PARTITION BY q ORDER BY updated_at DESC NULLS LAST, 'm' || summary_id) AS r FROM v JOIN session_summaries ON contains(lower(coalesce(summary, '') || ' ' || coalesce(array_to_string(keywords, ' '), '')), q) WHERE session_id IS NOT NULL QUALIFY r <= 5)
SELECT q AS query, summary_id, count(obs_id) AS observations, CASE WHEN count(obs_id) > 0 THEN 'available' ELSE 'legal-empty' END AS verdict FROM t LEFT JOIN observations o ON o.session_id = t.session_id GROUP BY q, summary_id""")
def benchmark_run(spark: SparkSession, d: str) -> DataFrame:
    """A set of queries run over the rollups, five results each, with what can be opened behind them."""
    m = memories(spark, d).where("cls = 'rollup'")
    pages = None
    for q in ("lock", "retry", "snapshot"):
        page = search.search_memories(m, Search(q, "keyword", limit=5)).select(F.lit(q).alias("query"), F.expr("cast(substring(id, 2) as bigint)").alias("summary_id"))
        pages = page if pages is None else pages.unionByName(page)
    s = table(spark, d, "session_summaries").select("summary_id", "session_id")
    hit = pages.join(s, "summary_id")
    n = table(spark, d, "observations").join(F.broadcast(hit.select("session_id").distinct()), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))  # the sessions of fifteen results
    none = F.expr("cast(array() as array<string>)")
    return hit.join(n, "session_id", "left").select("query", "summary_id", F.coalesce("n", F.lit(0)).alias("observations"), state.drill_down(F.coalesce("n", F.lit(0)), none).alias("verdict"))


@query("""WITH s AS (SELECT DISTINCT session_id AS session, transcript_path AS path FROM thin_events WHERE session_id IS NOT NULL), z AS (SELECT transcript_path AS path, max(end_offset) AS size FROM transcript_chunks WHERE transcript_path IS NOT NULL GROUP BY 1), k AS (SELECT transcript_path AS path, min(hwm_offset) AS cp FROM stop_sentinels WHERE transcript_path IS NOT NULL GROUP BY 1)
SELECT session, CASE WHEN count(s.path) = 0 THEN 'no_path' WHEN count(size) = 0 THEN 'all_missing' WHEN count(size) = count(s.path) THEN 'all_present' ELSE 'mixed' END AS class, count(s.path) AS paths, coalesce(sum(greatest(size - coalesce(cp, 0), 0)) FILTER (WHERE size IS NOT NULL), 0)::BIGINT AS pending
FROM s LEFT JOIN z ON z.path = s.path LEFT JOIN k ON k.path = s.path GROUP BY 1""")
def checkpoint_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "thin_events").where("session_id is not null").select(F.col("session_id").alias("session"), F.col("transcript_path").alias("path"))
    z = table(spark, d, "transcript_chunks").where("transcript_path is not null").groupBy(F.col("transcript_path").alias("path")).agg(F.max("end_offset").alias("size"))
    k = table(spark, d, "stop_sentinels").where("transcript_path is not null").groupBy(F.col("transcript_path").alias("path")).agg(F.min("hwm_offset").alias("checkpoint"))
    return evaluate.checkpoint_classes(s, z, k)


@query("""WITH b AS (SELECT session_id, max(transcript_offset) AS boundary FROM thin_events WHERE session_id IS NOT NULL GROUP BY 1), z AS (SELECT session_id, max(end_offset) AS size FROM transcript_chunks WHERE session_id IS NOT NULL GROUP BY 1), k AS (SELECT session_id, min(hwm_offset) AS cp FROM stop_sentinels WHERE session_id IS NOT NULL GROUP BY 1),
c AS (SELECT CASE WHEN boundary IS NULL THEN 'no_boundary' WHEN size IS NULL THEN 'source_missing' WHEN cp IS NULL THEN 'baseline_only' WHEN cp >= least(boundary, size) THEN 'complete' ELSE 'pending' END AS class, boundary, size, cp FROM b LEFT JOIN z USING (session_id) LEFT JOIN k USING (session_id))
SELECT class, count(*) AS sessions, sum(CASE WHEN class = 'pending' THEN least(boundary, size) - cp ELSE 0 END)::BIGINT AS pending, sum(CASE WHEN class = 'pending' THEN ceil((least(boundary, size) - cp) / 32768.0) ELSE 0 END)::BIGINT AS calls FROM c GROUP BY 1""")
def backlog_classes(spark: SparkSession, d: str) -> DataFrame:
    by = lambda n, c, f, a: table(spark, d, n).where("session_id is not null").groupBy("session_id").agg(f(c).alias(a))
    b = by("thin_events", "transcript_offset", F.max, "boundary").join(by("transcript_chunks", "end_offset", F.max, "size"), "session_id", "left").join(by("stop_sentinels", "hwm_offset", F.min, "checkpoint"), "session_id", "left")
    return evaluate.backlog_classes(b, 32768)


@query("""WITH z AS (SELECT transcript_path AS path, max(hwm_offset) AS length FROM stop_sentinels WHERE transcript_path IS NOT NULL GROUP BY 1)
SELECT chunk_id, CASE WHEN provider IS DISTINCT FROM 'api' THEN 'error-code-filtered' WHEN path_hash IS NULL THEN 'no-source' WHEN transcript_path IS NULL THEN 'path-unresolved' WHEN length IS NULL THEN 'transcript-deleted' WHEN length < end_offset THEN 'transcript-truncated' ELSE 'READABLE' END AS class
FROM transcript_chunks LEFT JOIN z ON path = transcript_path""")
def dead_letter_classes(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "stop_sentinels").where("transcript_path is not null").groupBy("transcript_path").agg(F.max("hwm_offset").alias("length"))
    c = table(spark, d, "transcript_chunks").join(z, "transcript_path", "left")
    return c.select("chunk_id", evaluate.dead_letter_class(F.col("provider"), "api", F.col("path_hash"), F.col("transcript_path"), F.col("length"), F.col("end_offset")).alias("class"))


@query("""SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'content-hash-mismatch' WHEN trim(array_to_string(list_filter(string_split(raw, chr(10)), lambda x: NOT contains(x, 'a')), chr(10)), ' ') = '' THEN 'empty-transcript' ELSE 'replay' END AS verdict FROM transcript_chunks WHERE raw IS NOT NULL""")
def replay_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every third chunk has another digest by now; lines with an a count as put in."""
    c = table(spark, d, "transcript_chunks").where("raw is not null")
    digest = F.when(F.col("chunk_id") % 3 == 0, F.lit("other")).otherwise(F.sha2("raw", 256))
    return c.select("chunk_id", evaluate.replay_verdict(F.col("raw"), digest, "a").alias("verdict"))


@query("""WITH l AS (SELECT sentinel_id AS letter, session_id AS session, hwm_offset - 2000 AS start, hwm_offset AS "end", project_id IS NULL AS legacy FROM stop_sentinels), r AS (SELECT session_id AS session, start_offset AS start, end_offset AS "end", transcript_path AS path FROM transcript_chunks),
h AS (SELECT DISTINCT letter, path FROM l JOIN r ON l.session = r.session AND r."end" > l.start AND r.start < l."end" AND l."end" > l.start AND r."end" > r.start WHERE path IS NOT NULL), s AS (SELECT DISTINCT transcript_path AS path FROM thin_events WHERE transcript_path IS NOT NULL),
g AS (SELECT letter, count(*) AS paths, count(*) FILTER (WHERE s.path IS NULL) AS gone FROM h LEFT JOIN s ON s.path = h.path GROUP BY 1), j AS (SELECT l.letter, coalesce(paths, 0) AS p, coalesce(gone, 0) AS g, legacy FROM l LEFT JOIN g ON g.letter = l.letter)
SELECT letter, array_to_string(list_filter([CASE WHEN p = 1 THEN 'single_transcript_path' END, CASE WHEN p > 1 THEN 'mixed_transcript_paths' END, CASE WHEN p = 0 OR g > 0 THEN 'source_missing' END, CASE WHEN legacy THEN 'prior_chunk_commit_unknown' END, CASE WHEN p = 1 AND g = 0 AND NOT legacy THEN 'recoverable_single_path' END], lambda x: x IS NOT NULL), ',') AS classes,
CASE WHEN p = 1 AND g = 0 AND NOT legacy THEN 'prepare' ELSE 'review' END AS action FROM j""")
def recovery_audit(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("hwm_offset")
    letters = table(spark, d, "stop_sentinels").select(F.col("sentinel_id").alias("letter"), F.col("session_id").alias("session"), (at - 2000).alias("start"), at.alias("end"), F.col("project_id").isNull().alias("legacy"))
    records = table(spark, d, "transcript_chunks").select(F.col("session_id").alias("session"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.col("transcript_path").alias("path"))
    return evaluate.recovery_audit(letters, records, table(spark, d, "thin_events").where("transcript_path is not null").select(F.col("transcript_path").alias("path")))


# ---- repair --------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT session_id AS session, count(DISTINCT project_id) AS n, min(project_id) AS t FROM thin_events WHERE session_id IS NOT NULL AND project_id IS NOT NULL GROUP BY 1),
r AS (SELECT obs_id AS id, 'old-' || project_id AS project, session_id AS session, md5(title) AS key FROM observations),
w AS (SELECT r.*, CASE WHEN n IS NULL THEN 'no evidence' WHEN n > 1 THEN 'ambiguous' WHEN t = project THEN 'unchanged' END AS why, t FROM r LEFT JOIN h ON h.session = r.session),
s AS (SELECT DISTINCT project, key FROM w WHERE why IS NOT NULL AND key IS NOT NULL), c AS (SELECT t, key, count(*) AS m FROM w WHERE why IS NULL AND key IS NOT NULL GROUP BY 1, 2)
SELECT id, coalesce(why, CASE WHEN s.key IS NOT NULL THEN 'target exists' WHEN m > 1 THEN 'collision' END, 'ok') AS reason, CASE WHEN why IS NULL AND s.key IS NULL AND coalesce(m, 0) <= 1 THEN w.t END AS target
FROM w LEFT JOIN s ON s.project = w.t AND s.key = w.key AND why IS NULL LEFT JOIN c ON c.t = w.t AND c.key = w.key AND why IS NULL""")
def remap_build(spark: SparkSession, d: str) -> DataFrame:
    """Rows of renamed projects moved to what the events of their session say, unless two would meet under one key."""
    return _plan(spark, d)[1].select("id", "reason", "target")


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, d).select("id", F.concat(F.lit("old-"), "project").alias("project"), "session", "key", "created_at")
    e = table(spark, d, "thin_events").select(F.col("session_id").alias("session"), F.col("project_id").alias("project"))
    return rows, repair.remap(rows, e)


@query("SELECT \"check\", 0::BIGINT AS n FROM (VALUES ('missing'), ('changed'), ('target taken')) t(\"check\")")
def remap_preflight(spark: SparkSession, d: str) -> DataFrame:
    rows, plan = _plan(spark, d)
    return repair.preflight(plan, rows)


@query("""SELECT count(*) AS rows, 0::BIGINT AS wrong, 0::BIGINT AS different FROM observations""")
def remap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A plan applied and taken back: rows of the plan are at their target between, and all are as before in the end."""
    rows, plan = _plan(spark, d)
    plan = cut(plan)
    there = cut(repair.apply_remap(plan, rows.select("id", "project")))
    wrong = there.join(plan.where("action = 'update'").select("id", "target"), "id", "left").where("not project <=> coalesce(target, project)").agg(F.count("*").alias("wrong"))
    back = repair.apply_remap(plan, there.drop("applied"), back=True)
    diff = back.join(rows.select("id", F.col("project").alias("was")), "id").agg(F.count("*").alias("rows"), F.count_if(~F.col("project").eqNullSafe(F.col("was"))).alias("different"))
    return diff.join(wrong, F.lit(True)).select("rows", "wrong", "different")  # one row each


@query("""WITH h AS (SELECT session_id AS session, count(DISTINCT project_id) AS n, min(project_id) AS t FROM thin_events WHERE session_id IS NOT NULL AND project_id IS NOT NULL GROUP BY 1),
r AS (SELECT obs_id AS id, 'old-' || project_id AS project, session_id AS session, md5(title) AS key, observed_at FROM observations), w AS (SELECT r.*, n = 1 AND t <> project AS go, t FROM r LEFT JOIN h ON h.session = r.session),
s AS (SELECT DISTINCT project, key FROM w WHERE NOT coalesce(go, false) AND key IS NOT NULL), c AS (SELECT t, key, count(*) AS m FROM w WHERE go AND key IS NOT NULL GROUP BY 1, 2),
m AS (SELECT w.id, observed_at FROM w LEFT JOIN s ON s.project = w.t AND s.key = w.key LEFT JOIN c ON c.t = w.t AND c.key = w.key WHERE go AND s.key IS NULL AND coalesce(m, 0) <= 1)
SELECT 'linked from outside' AS "check", (SELECT count(*) FROM observations o WHERE o.obs_id + 1 IN (SELECT id FROM m) AND o.obs_id NOT IN (SELECT id FROM m)) AS n UNION ALL SELECT 'changed since', (SELECT count(*) FROM m WHERE observed_at > TIMESTAMPTZ '2025-06-15 00:00:00+00')""")
def rollback_refusal(spark: SparkSession, d: str) -> DataFrame:
    rows, plan = _plan(spark, d)
    links = rows.select("id", (F.col("id") + 1).alias("rollup"))
    return repair.refuse_rollback(plan, links, rows.select("id", F.col("created_at").alias("updated_at")), now())


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "session_summaries")
    r = s.select(F.col("summary_id").alias("id"), F.col("session_id").alias("session"), F.col("project_id").alias("project"), F.col("updated_at").alias("created"), F.when(F.size("keywords") > 0, "active").otherwise("archived").alias("status"), F.lit(None).cast("long").alias("merged_into"))
    first = s.where("session_id is not null").groupBy("session_id").agg(F.max("summary_id").alias("rollup"))
    o = table(spark, d, "observations").join(first, "session_id", "left").select(F.col("obs_id").alias("id"), "rollup")
    return r, o, repair.merge_plan(r, o.where("rollup is not null").groupBy(F.col("rollup").alias("id")).agg(F.count("*").alias("n")))


_MERGE = """r AS (SELECT summary_id AS id, session_id AS session, project_id AS project, updated_at AS created FROM session_summaries WHERE len(keywords) > 0 AND session_id IS NOT NULL),
f AS (SELECT session_id, max(summary_id) AS rollup FROM session_summaries WHERE session_id IS NOT NULL GROUP BY 1), n AS (SELECT rollup AS id, count(*) AS n FROM observations JOIN f USING (session_id) GROUP BY 1),
x AS (SELECT r.*, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY session) AS m, first_value(r.id) OVER (PARTITION BY session ORDER BY coalesce(n, 0) DESC, created NULLS FIRST, r.id) AS b FROM r LEFT JOIN n ON n.id = r.id), y AS (SELECT *, (SELECT count(DISTINCT project) FROM r q WHERE q.session = x.session) AS p FROM x WHERE m > 1)"""


@query(f"WITH {_MERGE} SELECT id, session, CASE WHEN p > 1 THEN 'skip' WHEN id = b THEN 'keep' ELSE 'merge' END AS action, CASE WHEN p = 1 THEN b END AS survivor, CASE WHEN p > 1 THEN 'several projects' ELSE 'ok' END AS reason FROM y")
def merge_build(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d)[2]


@query(f"""WITH {_MERGE}, g AS (SELECT id, b FROM y WHERE p = 1 AND id <> b), l AS (SELECT obs_id AS id, coalesce(g.b, f.rollup) AS rollup FROM observations o LEFT JOIN f ON f.session_id = o.session_id LEFT JOIN g ON g.id = f.rollup) SELECT rollup, count(*) AS n FROM l WHERE rollup IS NOT NULL GROUP BY 1""")
def merge_links(spark: SparkSession, d: str) -> DataFrame:
    """How many rows link to each rollup after the merge."""
    r, links, plan = _merge(spark, d)
    return repair.apply_merge(plan, r, links)[1].where("rollup is not null").groupBy("rollup").agg(F.count("*").alias("n"))


@query("SELECT \"check\", 0::BIGINT AS n FROM (VALUES ('not archived'), ('survivor gone'), ('stale link'), ('unplanned'), ('unexpected'), ('missing')) t(\"check\")")
def merge_checks(spark: SparkSession, d: str) -> DataFrame:
    """After a merge all its rules hold, and the merged rollups are exactly those of the plan."""
    r, links, plan = _merge(spark, d)
    links = links.where("rollup is not null").join(r.where("status = 'active'").select(F.col("id").alias("rollup")), "rollup", "left_semi").select("id", "rollup")
    after, moved = repair.apply_merge(plan, r, links)
    same = repair.set_equality(after.where("merged_into is not null").select("id"), plan.where("action = 'merge'").select("id"))
    return repair.after_merge(plan, after, moved).unionByName(same.withColumnRenamed("side", "check"))


@query("SELECT (SELECT count(*) FROM session_summaries) AS rollups, (SELECT count(*) FROM observations) AS links, 0::BIGINT AS different")
def merge_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A merge taken back gives the tables from before."""
    r, links, plan = _merge(spark, d)
    plan = cut(plan)
    after, moved = repair.apply_merge(plan, r, links)
    old, was = repair.reverse_merge(plan, cut(after), cut(moved), links)
    x = old.join(r.select("id", F.col("status").alias("s"), F.col("merged_into").alias("m")), "id").agg(F.count("*").alias("rollups"), F.count_if((F.col("status") != F.col("s")) | ~F.col("merged_into").eqNullSafe(F.col("m"))).alias("a"))
    y = was.join(links.select("id", F.col("rollup").alias("r")), "id").agg(F.count("*").alias("links"), F.count_if(~F.col("rollup").eqNullSafe(F.col("r"))).alias("b"))
    return x.join(y, F.lit(True)).select("rollups", "links", (F.col("a") + F.col("b")).alias("different"))  # one row each


@query("""WITH p AS (SELECT 'p' || pending_id AS id, project_id AS project, session_id AS key, 'active' AS status FROM pending_summaries), r AS (SELECT * FROM p), o AS (SELECT obs_id, 'p' || (obs_id % 200 + 1) AS rollup_id, project_id AS project FROM observations),
j AS (SELECT o.*, r.id, r.project AS rp FROM o LEFT JOIN r ON r.id = o.rollup_id)
SELECT 'orphan' AS rule, count(*) FILTER (WHERE rp IS NULL) AS violations FROM j UNION ALL SELECT 'cross_project', count(*) FILTER (WHERE rp <> project) FROM j UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM r WHERE key IS NOT NULL GROUP BY project, key HAVING count(*) > 1)""")
def post_invariants(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "pending_summaries").select(F.concat(F.lit("p"), "pending_id").alias("id"), F.col("project_id").alias("project"), F.col("session_id").alias("key"), F.lit("active").alias("status"))
    o = table(spark, d, "observations").select(F.concat(F.lit("p"), F.col("obs_id") % 200 + 1).alias("rollup_id"), F.col("project_id").alias("project"))
    return state.invariants(o, r)


@query(f"""SELECT 'observations' AS t, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE embedding IS NULL) AS no_vector, count(*) FILTER (WHERE created_at >= {NOW_SQL}) AS fresh, count(DISTINCT project_id) AS projects FROM observations LEFT JOIN embeddings ON vec_id = obs_id
UNION ALL SELECT 'session_summaries', count(*), count(*), count(*) FILTER (WHERE embedding IS NULL), count(*) FILTER (WHERE updated_at >= {NOW_SQL}), count(DISTINCT project_id) FROM session_summaries LEFT JOIN embeddings ON vec_id = summary_id""")
def ops_check(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two tables, each in one pass."""
    e = lambda k: table(spark, d, "embeddings").select(F.col("vec_id").alias(k), "embedding")
    one = lambda df, name, time, active: df.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("embedding").isNull()).alias("no_vector"), F.count_if(F.col(time) >= now()).alias("fresh"), F.count_distinct("project_id").alias("projects")).select(F.lit(name).alias("t"), "*")
    o = table(spark, d, "observations").join(e("obs_id"), "obs_id", "left")
    s = table(spark, d, "session_summaries").join(e("summary_id"), "summary_id", "left")
    return one(o, "observations", "created_at", F.col("status") == "active").unionByName(one(s, "session_summaries", "updated_at", F.lit(True)))


@query("SELECT 'sessions' AS what, (SELECT count(DISTINCT session_id) FROM thin_events) AS have, 0::BIGINT AS unexpected, 0::BIGINT AS missing")
def inventory_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events").where("session_id is not null").select("session_id")
    s = repair.set_equality(e, e.distinct())
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("n"))).alias(k)
    return s.agg(side("unexpected"), side("missing")).join(e.agg(F.count_distinct("session_id").alias("have")), F.lit(True)).select(F.lit("sessions").alias("what"), "have", "unexpected", "missing")  # one row each
