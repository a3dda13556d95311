"""Queries of capture and its state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import capture, progress, ranges, state
from weftline.plans.core_queries import big, query
from weftline.session import table

NOW_SQL = "TIMESTAMPTZ '2025-06-15 00:00:00+00'"


def now():
    return F.lit("2025-06-15 00:00:00").cast("timestamp")


_SESSIONS = """s AS (SELECT session_id AS path, max(observed_at) AS last_event FROM observations WHERE session_id IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT session_id AS path FROM stop_sentinels WHERE session_id IS NOT NULL),
b AS (SELECT session_id AS path, count(*) AS windows FROM transcript_chunks WHERE session_id IS NOT NULL GROUP BY 1), cur AS (SELECT min(path) AS cursor FROM c),
t AS (SELECT s.path, last_event, coalesce(windows, 0) AS windows, CASE WHEN c.path IS NOT NULL THEN 0 WHEN epoch_us({now}) - epoch_us(last_event) < 4320 * 60000000::BIGINT THEN 3
WHEN epoch_us({now}) - epoch_us(last_event) <= 43200 * 60000000::BIGINT THEN 1 ELSE 2 END AS tier, CASE WHEN tier = 2 THEN s.path <= cursor END AS behind FROM s LEFT JOIN c USING (path) LEFT JOIN b ON b.path = s.path, cur)""".replace("{now}", NOW_SQL)
_ORDER = "tier, CASE WHEN tier < 2 THEN last_event END DESC NULLS LAST, behind NULLS LAST, path"


def _tick(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "observations").where("session_id is not null").groupBy(F.col("session_id").alias("path")).agg(F.max("observed_at").alias("last_event"))
    c = table(spark, d, "stop_sentinels").where("session_id is not null").select(F.col("session_id").alias("path"), F.lit(True).alias("closed")).distinct()
    b = table(spark, d, "transcript_chunks").where("session_id is not null").groupBy(F.col("session_id").alias("path")).agg(F.count("*").alias("windows"))
    cursor = c.agg(F.min("path")).first()[0]
    return progress.tick_order(s.join(c, "path", "left").join(b, "path", "left").fillna(0, ["windows"]), now(), cursor, 43200, 4320)


@query(f"WITH {_SESSIONS} SELECT path, tier::BIGINT AS tier, row_number() OVER (ORDER BY {_ORDER})::BIGINT AS place FROM t WHERE tier < 3 QUALIFY place <= 60")
def tick_order(spark: SparkSession, d: str) -> DataFrame:
    """The first sessions of a tick: closed and fresh ones newest first, stale ones rotated behind the cursor."""
    from pyspark.sql import Window

    top = _tick(spark, d).where("tier < 3").orderBy(*progress.tick_sort()).limit(60)
    return top.select("path", *big("tier"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*progress.tick_sort())).cast("long").alias("place"))


@query(f"""WITH {_SESSIONS}, o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM t WHERE tier < 3 AND windows > 0 QUALIFY r <= 40),
p AS (SELECT *, coalesce(sum(windows) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) SELECT path, least(windows, 50 - before)::BIGINT AS taken FROM p WHERE before < 50""")
def tick_budget(spark: SparkSession, d: str) -> DataFrame:
    return progress.within_budget(_tick(spark, d), 40, 50).select("path", *big("taken"))


@query("""WITH r AS (SELECT session_id AS session, event_id AS place, nullif(project_id, '') AS project, ingested_at AS time FROM thin_events WHERE session_id IS NOT NULL),
g AS (SELECT session, arg_min(project, place) FILTER (WHERE project IS NOT NULL) AS any_p, arg_min(project, place) FILTER (WHERE project IS NOT NULL AND time >= TIMESTAMPTZ '2025-06-15 00:00:00+00') AS new_p,
coalesce(bool_or(project IS NOT NULL AND time < TIMESTAMPTZ '2025-06-15 00:00:00+00'), false) AS old FROM r GROUP BY 1),
k AS (SELECT session_id AS session, min(project_id) AS state FROM pending_summaries WHERE session_id IS NOT NULL GROUP BY 1), f AS (SELECT session_id AS session, min(string_split(transcript_path, '/')[-2]) AS folder FROM transcript_chunks WHERE session_id IS NOT NULL GROUP BY 1)
SELECT g.session, CASE WHEN new_p IS NOT NULL THEN new_p WHEN old THEN coalesce(state, folder, any_p) ELSE coalesce(state, any_p) END AS project,
CASE WHEN new_p IS NOT NULL THEN 'new era' WHEN state IS NOT NULL THEN 'state' WHEN old AND folder IS NOT NULL THEN 'folder' WHEN any_p IS NOT NULL THEN 'record' ELSE 'none' END AS basis
FROM g LEFT JOIN k USING (session) LEFT JOIN f USING (session)""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "thin_events").where("session_id is not null").select(F.col("session_id").alias("session"), F.col("event_id").alias("place"), F.col("project_id").alias("project"), F.col("ingested_at").alias("time"))
    k = table(spark, d, "pending_summaries").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.min("project_id").alias("state"))
    f = table(spark, d, "transcript_chunks").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.min(F.element_at(F.split("transcript_path", "/"), -2)).alias("folder"))
    return progress.attribute(r, k.join(f, "session", "full_outer"), now())


@query("""WITH c AS (SELECT chunk_id, strlen(raw) AS n, raw FROM transcript_chunks WHERE raw IS NOT NULL), h AS (SELECT chunk_id FROM c WHERE strlen(raw) = length(raw) AND length(raw) > 10)
SELECT chunk_id, 7::BIGINT AS cut, n::BIGINT AS "end", 2::BIGINT AS parts FROM c JOIN h USING (chunk_id)""")
def split_by_hint(spark: SparkSession, d: str) -> DataFrame:
    """Windows that were too long before are divided where a hint says, as long as its bytes are the same (plain texts here)."""
    c = table(spark, d, "transcript_chunks").where("octet_length(raw) = char_length(raw) and char_length(raw) > 10")
    hints = c.select("chunk_id", F.lit(0).cast("long").alias("hint_start"), F.lit(7).cast("long").alias("hint_end"), F.sha2(F.substring("raw", 1, 7), 256).alias("hint_hash"))
    p = progress.adaptive_split(c, "chunk_id", "raw", hints).where("by_hint")
    return p.groupBy("chunk_id").agg(F.min("end").alias("cut"), F.max("end").alias("end"), F.count("*").alias("parts"))


@query("""SELECT chunk_id, strlen(raw)::BIGINT AS bytes, true AS chained, true AS halved FROM transcript_chunks WHERE strlen(raw) > 1024""")
def split_in_halves(spark: SparkSession, d: str) -> DataFrame:
    """Without a hint that holds, windows are halved at natural boundaries: the parts follow one another and cover the window."""
    from pyspark.sql import Window

    c = table(spark, d, "transcript_chunks").where("octet_length(raw) > 1024").select("chunk_id", "raw", F.octet_length("raw").alias("n"))
    stale = c.select("chunk_id", F.lit(0).cast("long").alias("hint_start"), F.lit(7).cast("long").alias("hint_end"), F.lit("stale").alias("hint_hash"))
    p = progress.adaptive_split(c, "chunk_id", "raw", stale).join(c.select("chunk_id", "n"), "chunk_id")
    p = p.withColumn("prev", F.lag("end", 1, 0).over(Window.partitionBy("chunk_id").orderBy("part")))  # the parts of one window
    half = F.col("end") - F.col("start") <= F.greatest(F.lit(1024), F.floor(F.col("n") / 2))
    return p.groupBy("chunk_id").agg(F.max("end").alias("bytes"), F.every(F.col("prev") == F.col("start")).alias("chained"), F.every(half).alias("halved"))


@query("""WITH c AS (SELECT session_id AS spool, transcript_path AS path, start_offset AS place, max(end_offset) AS e, bool_and(raw IS NOT NULL) AS ok FROM transcript_chunks WHERE session_id IS NOT NULL AND transcript_path IS NOT NULL GROUP BY 1, 2, 3),
st AS (SELECT spool, path, min(place) FILTER (WHERE NOT ok) AS stop FROM c GROUP BY 1, 2), dn AS (SELECT c.spool, c.path, max(e) FILTER (WHERE ok AND (stop IS NULL OR place < stop)) AS done FROM c JOIN st ON st.spool = c.spool AND st.path = c.path GROUP BY 1, 2),
w AS (SELECT spool, bool_and(ok) AS whole, max(e) AS safe FROM c GROUP BY 1), s AS (SELECT session_id AS spool, transcript_path AS path, min(hwm_offset) AS checkpoint FROM stop_sentinels WHERE session_id IS NOT NULL AND transcript_path IS NOT NULL GROUP BY 1, 2)
SELECT s.spool, s.path, CASE WHEN checkpoint IS NULL THEN done WHEN done IS NULL THEN checkpoint ELSE greatest(checkpoint, done) END AS checkpoint, CASE WHEN whole THEN safe ELSE 0 END AS cursor FROM s LEFT JOIN dn ON dn.spool = s.spool AND dn.path = s.path LEFT JOIN w ON w.spool = s.spool""")
def two_levels(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that were lost (no text) stop their transcript's checkpoint and their spool's cursor."""
    c = table(spark, d, "transcript_chunks").where("session_id is not null and transcript_path is not null").groupBy(F.col("session_id").alias("spool"), F.col("transcript_path").alias("path"), F.col("start_offset").alias("place"))
    c = c.agg(F.max("end_offset").alias("end"), F.every(F.col("raw").isNotNull()).alias("committed")).withColumn("safe_end", F.col("end"))
    s = table(spark, d, "stop_sentinels").where("session_id is not null and transcript_path is not null").groupBy(F.col("session_id").alias("spool"), F.col("transcript_path").alias("path"))
    return progress.progress(c, s.agg(F.min("hwm_offset").alias("checkpoint")).withColumn("cursor", F.lit(0).cast("long")))


@query("""WITH RECURSIVE s AS (SELECT transcript_path AS path, min(end_offset) AS c0 FROM transcript_chunks WHERE transcript_path IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT transcript_path AS path, start_offset AS a, end_offset AS z FROM transcript_chunks WHERE transcript_path IS NOT NULL AND end_offset > start_offset),
r AS (SELECT path, c0 AS c FROM s UNION SELECT r.path, d.z FROM r JOIN d ON d.path = r.path AND d.a <= r.c AND d.z > r.c), m AS (SELECT path, max(c) AS checkpoint FROM r GROUP BY 1)
SELECT m.path, m.checkpoint, (SELECT count(*) FROM d, s WHERE d.path = m.path AND s.path = m.path AND d.z <= m.checkpoint AND d.z > s.c0) AS skipped FROM m""")
def skip_past(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "transcript_chunks").where("transcript_path is not null")
    s = c.groupBy(F.col("transcript_path").alias("path")).agg(F.min("end_offset").alias("checkpoint"))
    dead = c.where("end_offset > start_offset").select(F.col("transcript_path").alias("path"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end")).distinct()
    return progress.skip_past(s, dead)


@query("""WITH p AS (SELECT session_id AS session, transcript_path AS path, max(event_id) AS place FROM thin_events WHERE session_id IS NOT NULL AND transcript_path IS NOT NULL GROUP BY 1, 2)
SELECT session, max(place) AS cursor, count(DISTINCT path) AS missing FROM p GROUP BY session HAVING NOT bool_or(path IN (SELECT transcript_path FROM transcript_chunks WHERE transcript_path IS NOT NULL))""")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events").where("session_id is not null and transcript_path is not null").select(F.col("session_id").alias("session"), F.col("transcript_path").alias("path"), F.col("event_id").alias("place"))
    return progress.missing_sources(e, table(spark, d, "transcript_chunks").select(F.col("transcript_path").alias("path")))


@query("""WITH f AS (SELECT DISTINCT session_id FROM transcript_chunks WHERE raw IS NULL) SELECT session_id AS session, max(hwm_offset) AS checkpoint, session_id IN (SELECT session_id FROM f WHERE session_id IS NOT NULL) AS stopped FROM stop_sentinels WHERE session_id IS NOT NULL GROUP BY 1""")
def sink_failure(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stop_sentinels").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.max("hwm_offset").alias("checkpoint"))
    return progress.after_failed_write(s, table(spark, d, "transcript_chunks").where("raw is null").select(F.col("session_id").alias("session")))


@query(f"""WITH s AS (SELECT session_id, max(transcript_offset) AS size, max(ingested_at) AS t, min(transcript_offset) AS lo FROM thin_events WHERE session_id IS NOT NULL GROUP BY 1), z AS (SELECT session_id, max(hwm_offset) AS cur FROM stop_sentinels WHERE session_id IS NOT NULL GROUP BY 1)
SELECT s.session_id, coalesce(cur >= size AND (size > 100000 OR epoch_us({NOW_SQL}) - epoch_us(t) > 24 * 3600000000::BIGINT), false) AS sealed FROM s LEFT JOIN z USING (session_id)""")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "thin_events").where("session_id is not null").groupBy("session_id").agg(F.max("transcript_offset").alias("size"), F.max("ingested_at").alias("t"))
    z = table(spark, d, "stop_sentinels").where("session_id is not null").groupBy("session_id").agg(F.max("hwm_offset").alias("cur"))
    on = progress.rotates(F.col("size"), F.col("cur"), F.col("t"), F.col("cur").isNotNull(), F.lit(False), now(), 100_000)
    return s.join(z, "session_id", "left").select("session_id", on.alias("sealed"))


@query("""SELECT chunk_id::VARCHAR AS path, CASE WHEN NOT coalesce(regexp_full_match(h, '[a-f0-9]{64}'), false) THEN 'path_hash' WHEN coalesce(trim(provider), '') = '' THEN 'generation' WHEN NOT coalesce(start_offset >= 100, false) THEN 'cursor'
WHEN NOT coalesce(end_offset >= start_offset, false) THEN 'range' END AS reason FROM (SELECT *, CASE WHEN chunk_id % 7 = 0 THEN path_hash ELSE sha256(transcript_path) END AS h FROM transcript_chunks) WHERE reason IS NOT NULL""")
def corrupt_state(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "transcript_chunks").select(
        F.col("chunk_id").cast("string").alias("path"), F.when(F.col("chunk_id") % 7 == 0, F.col("path_hash")).otherwise(F.sha2("transcript_path", 256)).alias("path_hash"), F.col("provider").alias("generation"),
        (F.col("start_offset") - 100).alias("cursor"), F.col("end_offset").alias("checkpoint"), F.lit(0).alias("attempts"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"),
    )
    return progress.corrupt_state(c)


@query(f"""WITH r AS (SELECT summary_id AS id, len(keywords) AS generation, CASE WHEN summary_id % 3 = 0 THEN len(keywords) END AS fg, len(decisions) AS rg, len(next_steps) AS attempts, updated_at AS next_at, updated_at - INTERVAL 1 DAY AS lease FROM session_summaries),
c AS (SELECT *, coalesce(rg = generation, false) AS same FROM r), o AS (SELECT *, CASE WHEN same THEN coalesce(attempts, 0) ELSE 0 END AS tries FROM c)
SELECT id, coalesce(generation >= 1 AND NOT coalesce(fg = generation, false) AND NOT coalesce(lease > {NOW_SQL}, false) AND NOT (same AND (coalesce(next_at > {NOW_SQL}, false) OR tries >= 3)), false) AS claimed,
CASE WHEN claimed THEN tries + 1 ELSE attempts END::BIGINT AS attempts FROM o""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    """Rollups claimed for finalising (generation, attempts and times stand in the lists and dates of the summaries)."""
    s = table(spark, d, "session_summaries")
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    r = s.select(
        F.col("summary_id").alias("id"), n("keywords").alias("generation"), F.when(F.col("summary_id") % 3 == 0, n("keywords")).alias("finalised_generation"), n("decisions").alias("retry_generation"), n("next_steps").alias("attempts"),
        F.col("updated_at").alias("next_at"), (F.col("updated_at") - F.expr("interval 1 day")).alias("lease_until"),
    )
    return progress.claim(r, now()).select("id", "claimed", *big("attempts"))


@query("""SELECT a.summary_id AS id, a.session_id AS session FROM session_summaries a JOIN pending_summaries b ON b.pending_id = a.summary_id WHERE len(a.decisions) = len(b.decisions) AND len(a.next_steps) = len(b.next_steps)""")
def fence(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "session_summaries").select(F.col("summary_id").alias("id"), F.col("session_id").alias("session"), F.size("decisions").alias("generation"), F.size("next_steps").alias("attempts"))
    b = table(spark, d, "pending_summaries").select(F.col("pending_id").alias("id"), F.size("decisions").alias("generation"), F.size("next_steps").alias("attempts"))
    return progress.fenced(a, b).select("id", "session")


_W = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3100}-\x{312f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"


@query(rf"""WITH c AS (SELECT session_id AS session, max_by(summary, summary_id) AS summary, count(*) AS windows, 0 AS tokens FROM session_summaries WHERE session_id IS NOT NULL GROUP BY 1),
w AS (SELECT session_id AS session, obs_id, narrative, discovery_tokens AS t, source_hook = 'stop' AS seen FROM observations WHERE session_id IS NOT NULL),
n AS (SELECT session, max_by(narrative, obs_id) AS next, count(*) AS n, sum(t) AS t FROM w WHERE NOT seen GROUP BY 1), o AS (SELECT session, count(*) AS replayed FROM w WHERE seen GROUP BY 1),
j AS (SELECT coalesce(c.session, n.session) AS session, summary, windows, tokens, next, n, t, replayed, length(summary) + len(regexp_extract_all(summary, '{_W}')) AS a, length(next) + len(regexp_extract_all(next, '{_W}')) AS b FROM c FULL JOIN n ON n.session = c.session LEFT JOIN o ON o.session = coalesce(c.session, n.session)),
s AS (SELECT *, coalesce(a >= 200 AND b < a * 0.4, false) AS shrunk FROM j)
SELECT session, CASE WHEN shrunk THEN summary ELSE coalesce(next, summary) END AS summary, CASE WHEN shrunk THEN next END AS pending, (coalesce(windows, 0) + coalesce(n, 0))::BIGINT AS windows, (coalesce(tokens, 0) + coalesce(t, 0))::BIGINT AS tokens, coalesce(replayed, 0)::BIGINT AS replayed FROM s""")
def rollup_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "session_summaries").where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.max_by("summary", "summary_id").alias("summary"), F.count("*").alias("windows")).withColumn("tokens", F.lit(0))
    o = table(spark, d, "observations").where("session_id is not null")
    w = o.select(F.col("session_id").alias("session"), F.lit("p").alias("path"), F.col("obs_id").alias("end"), F.col("narrative").alias("summary"), F.col("discovery_tokens").alias("tokens"), (F.col("source_hook") == "stop").alias("seen"))
    return progress.update_rollups(c, w).select("session", "summary", "pending", *big("windows", "tokens", "replayed"))


def _est(x: str) -> str:
    return f"ceil(length({x}) / 4.0)"


@query(f"""WITH p AS (SELECT summary_id, updated_at, CASE WHEN length(summary) > 120 THEN substr(summary, 1, 120) || '…' ELSE summary END AS excerpt, coalesce(keywords, []) AS ids FROM session_summaries WHERE summary IS NOT NULL ORDER BY updated_at DESC NULLS LAST, summary_id DESC LIMIT 30),
t AS (SELECT *, CASE WHEN length(excerpt) > 60 THEN substr(excerpt, 1, 60) || '…' ELSE excerpt END AS brief, ceil((length(excerpt) + length(array_to_string(ids, ','))) / 4.0) AS a, {_est('excerpt')} AS b, {_est('brief')} AS c FROM p),
s AS (SELECT *, CASE WHEN sum(a) OVER () <= 400 THEN 0 WHEN sum(b) OVER () <= 400 THEN 1 ELSE 2 END AS step, sum(c) OVER (ORDER BY updated_at DESC NULLS LAST, summary_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT summary_id, CASE WHEN step = 2 THEN brief ELSE excerpt END AS excerpt, CASE WHEN step = 0 THEN array_to_string(ids, ',') ELSE '' END AS ids FROM s WHERE step < 2 OR upto <= 400""")
def trimmed_activity(spark: SparkSession, d: str) -> DataFrame:
    """The newest rollups within a budget of tokens."""
    order = [F.desc_nulls_last("updated_at"), F.desc("summary_id")]
    none = F.expr("cast(array() as array<string>)")
    p = table(spark, d, "session_summaries").where("summary is not null").orderBy(*order).limit(30).select("summary_id", "updated_at", T.excerpt(F.col("summary"), 120).alias("excerpt"), F.coalesce("keywords", none).alias("ids"))
    tokens = lambda x, ids: F.ceil((F.char_length(x) + F.char_length(F.array_join(ids, ","))) / 4)
    return progress.trim_activity(p, order, tokens, 400).select("summary_id", "excerpt", F.array_join("ids", ",").alias("ids"))


# ---- state that only tests saw so far --------------------------------------------------------------------------


@query(f"SELECT obs_id, coalesce(len(facts) >= 1 AND epoch_us({NOW_SQL}) - epoch_us(observed_at) BETWEEN 0 AND 30 * 24 * 3600000000::BIGINT - 1, false) AS held, coalesce(epoch_us({NOW_SQL}) - epoch_us(observed_at) >= 360 * 60000000::BIGINT, false) AS quiet FROM observations")
def holds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select("obs_id", state.held(F.size("facts"), F.col("observed_at"), now(), 30 * 24 * 60).alias("held"), state.quiet(F.col("observed_at"), now(), 360).alias("quiet"))


@query("""WITH c AS (SELECT transcript_path AS path, max(hwm_offset) AS c FROM stop_sentinels GROUP BY 1) SELECT chunk_id FROM transcript_chunks LEFT JOIN c ON path = transcript_path WHERE c IS NULL OR end_offset > c""")
def uncovered_entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "transcript_chunks").select("chunk_id", F.col("transcript_path").alias("path"), F.col("end_offset").alias("end"))
    return state.drop_covered(e, table(spark, d, "stop_sentinels").select(F.col("transcript_path").alias("path"), F.col("hwm_offset").alias("checkpoint"))).select("chunk_id")


@query("""SELECT sha256('["' || session_id || '","' || path_hash || '","' || start_offset || '","' || end_offset || '"]') AS content_hash, count(*) FILTER (WHERE true) > 0 AS there FROM transcript_chunks
WHERE session_id IS NOT NULL AND path_hash IS NOT NULL AND raw IS NULL GROUP BY 1""")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a text count as failed for good: one letter a content."""
    f = table(spark, d, "transcript_chunks").where("session_id is not null and path_hash is not null and raw is null")
    f = f.select(F.col("session_id").alias("session"), F.col("path_hash").alias("path"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.lit(5).alias("attempts"))
    known = spark.createDataFrame([], "content_hash string")
    return state.dead_letters(f, known).select("content_hash", F.lit(True).alias("there"))


@query("SELECT obs_id, coalesce(trim(title) <> '' AND obs_type IN ('decision', 'bugfix'), false) AS valid FROM observations")
def extractions(spark: SparkSession, d: str) -> DataFrame:
    """Observations written as extractions and read back: valid ones have a summary, known kinds and titles."""
    o = table(spark, d, "observations")
    one = F.struct(F.col("obs_type").alias("type"), "title", "narrative", "facts")
    text = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("summary"), F.col("concepts").alias("keywords"), F.array(one).alias("observations")))
    return o.select("obs_id", state.parse_extraction(text, ("decision", "bugfix"))["valid"].alias("valid"))


@query("SELECT obs_id, session_id, coalesce(discovery_tokens, 0)::BIGINT AS tokens, obs_id % 2 = 0 AS present FROM (SELECT obs_id, CASE WHEN obs_id % 2 = 0 THEN session_id END AS session_id, CASE WHEN obs_id % 2 = 0 THEN discovery_tokens END AS discovery_tokens FROM observations)")
def metadata_read(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of all rows: even ones hold a capture object, some as a text in a text, odd ones a field of a wrong type."""
    o = table(spark, d, "observations")
    good = F.to_json(F.struct(F.struct("session_id", "discovery_tokens").alias("capture")))
    meta = F.when(F.col("obs_id") % 4 == 0, F.regexp_replace(F.to_json(F.array(good)), r"^\[|\]$", "")).when(F.col("obs_id") % 2 == 0, good).otherwise(F.lit('{"other": {"session_id": 5}}'))
    m = state.capture_metadata(meta)
    return o.select("obs_id", m["session_id"].alias("session_id"), m["discovery_tokens"].alias("tokens"), m["present"].alias("present"))


@query("SELECT summary_id, CASE WHEN n > 0 THEN 'available' WHEN len(coalesce(keywords, [])) = 0 THEN 'legal-empty' ELSE 'inconsistent' END AS verdict FROM (SELECT summary_id, keywords, count(obs_id) AS n FROM session_summaries s LEFT JOIN observations o ON o.session_id = s.session_id GROUP BY 1, 2)")
def drill_down(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "observations").groupBy("session_id").agg(F.count("*").alias("n"))
    s = table(spark, d, "session_summaries").join(n, "session_id", "left")
    return s.select("summary_id", state.drill_down(F.coalesce("n", F.lit(0)), F.coalesce("keywords", F.expr("cast(array() as array<string>)"))).alias("verdict"))


@query("""WITH c AS (SELECT chunk_id, strlen(raw) AS n FROM transcript_chunks WHERE raw IS NOT NULL AND raw <> '') SELECT chunk_id, n::BIGINT AS bytes, true AS chained, true AS bounded FROM c""")
def window_cover(spark: SparkSession, d: str) -> DataFrame:
    """The byte windows of a chunk follow one another, cover it and keep to their size."""
    from pyspark.sql import Window

    w = capture.byte_windows(table(spark, d, "transcript_chunks").where("raw <> ''"), "chunk_id", "raw", 32 * 1024)
    w = w.withColumn("prev", F.lag("end", 1, 0).over(Window.partitionBy("chunk_id").orderBy("window_no")))  # the windows of one chunk
    return w.groupBy("chunk_id").agg(F.max("end").alias("bytes"), F.every(F.col("prev") == F.col("start")).alias("chained"), F.every(F.col("end") - F.col("start") <= 32 * 1024).alias("bounded"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS session, l_partkey % 7 AS path, l_suppkey % 90 AS start, l_suppkey % 90 + 10 AS "end" FROM lineitem)
SELECT session, path, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY session, path ORDER BY start, "end") AS i FROM (SELECT *, CASE WHEN max("end") OVER (PARTITION BY session, path ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS nw FROM o)) GROUP BY session, path, i""")
def rollup_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges a rollup keeps: those of all its windows, merged where they touch."""
    x = F.col("l_suppkey") % 90
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_partkey") % 7).alias("path"), x.alias("start"), (x + 10).alias("end"))
    return ranges.merge_ranges(o, ["session", "path"], block=64)
