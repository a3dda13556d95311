"""Queries of sources, sinks, predicates and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import browse, capture, mutate, state
from weftline.plans.core_queries import big, query
from weftline.session import scratch, table
from weftline.sources import jsonl, markdown, transcripts

LINES = "(SELECT chunk_id, unnest(string_split(raw, chr(10))) AS x, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS line_no FROM transcript_chunks WHERE raw IS NOT NULL)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_chunks").where("raw is not null").select("chunk_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "value"))


@query(f"""SELECT chunk_id, line_no, coalesce(sum(strlen(x) + 1) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
(start + strlen(x))::BIGINT AS "end" FROM {LINES}""")
def spool_offsets(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.with_offsets(_lines(spark, d), ["chunk_id"], "line_no", "value").select("chunk_id", *big("line_no", "start", "end"))


@query(f"""SELECT chunk_id, count(*) AS lines, count(*) FILTER (WHERE NOT json_valid(x) OR json_type(CASE WHEN json_valid(x) THEN x END) <> 'OBJECT') AS malformed FROM {LINES} WHERE trim(x) <> '' GROUP BY 1""")
def spool_parsed(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.parse_events(_lines(spark, d)).groupBy("chunk_id").agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"))


@query(f"""SELECT chunk_id FROM (SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT') AS good FROM {LINES} WHERE trim(x) <> '' GROUP BY 1) WHERE good = 0""")
def malformed_only(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots without one good record: the cursor passes them and nothing is captured."""
    return state.malformed_only(jsonl.parse_events(_lines(spark, d)), "chunk_id")


@query(r"SELECT chunk_id, regexp_extract(raw, '(?s)^(.*\n)', 1) AS safe FROM transcript_chunks WHERE raw IS NOT NULL")
def safe_end(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_chunks").where("raw is not null").select("chunk_id", transcripts.complete_lines(F.col("raw")).alias("safe"))


_SKIP = ", ".join(f"'{t}'" for t in jsonl.SKIPPED_TOOLS)


@query(f"""SELECT session_id, count(*) AS events, count(DISTINCT transcript_path) AS paths, max(transcript_offset) AS last FROM thin_events WHERE coalesce(tool_name NOT IN ({_SKIP}), true) GROUP BY 1""")
def spool_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written to a spool by project and read back: a round trip through JSON lines."""
    path = scratch(spark)
    e = table(spark, d, "thin_events").select(F.coalesce("project_id", F.lit("unknown")).alias("project"), "session_id", "project_id", "tool_name", F.col("timestamp_text").alias("timestamp"), "transcript_path", "transcript_offset")
    if not jsonl.append_events(e, path, partition=["project"]):
        raise RuntimeError("the spool was not written")
    back = jsonl.read_spool(spark, path).where("not malformed")
    return back.groupBy("session_id").agg(F.count("*").alias("events"), F.count_distinct("transcript_path").alias("paths"), F.max("transcript_offset").alias("last"))


@query("SELECT transcript_path, count(*) AS sentinels, max(hwm_offset) AS hwm FROM stop_sentinels WHERE transcript_path IS NOT NULL GROUP BY 1")
def spool_sentinels(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    jsonl.append_sentinels(table(spark, d, "stop_sentinels"), path)
    return jsonl.read_spool(spark, path).groupBy("transcript_path").agg(F.count("*").alias("sentinels"), F.max("hwm_offset").alias("hwm"))


@query(f"SELECT coalesce(project_id, 'unknown') AS project, count(*) AS lines FROM thin_events WHERE coalesce(tool_name <> 'Bash', true) GROUP BY 1")
def spool_listing(spark: SparkSession, d: str) -> DataFrame:
    """The folders of a spool and their lines, under a skip list of one's own."""
    path = scratch(spark)
    jsonl.append_events(table(spark, d, "thin_events").withColumn("project", F.coalesce("project_id", F.lit("unknown"))).select("project", "session_id", "tool_name"), path, skip="Bash", partition=["project"])
    return jsonl.read_spool(spark, path).groupBy(F.regexp_extract("file", "project=([^/]+)/", 1).alias("project")).agg(F.count("*").alias("lines"))


@query(r"""SELECT DISTINCT tool_name, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(tool_name, '_u', '_u005fu', 'g'), '^\.', '_u002e'), ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9._-]') THEN c ELSE printf('_u%04x', unicode(c)) END), '') AS segment, tool_name AS back
FROM thin_events WHERE tool_name <> ''""")
def segment_codec(spark: SparkSession, d: str) -> DataFrame:
    s = T.encode_segment(F.col("tool_name"))
    return table(spark, d, "thin_events").where("tool_name <> ''").select("tool_name", s.alias("segment"), T.decode_segment(s).alias("back")).distinct()


@query("""WITH l AS (SELECT session_id, event_id, transcript_path, coalesce(sum(strlen(transcript_path) + 11) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT session_id, event_id, coalesce(transcript_path, '') AS transcript_path FROM thin_events WHERE session_id IS NOT NULL))
SELECT session_id, min_by(transcript_path, event_id) AS cwd FROM l WHERE start + strlen(transcript_path) + 10 <= 600 AND transcript_path <> '' GROUP BY 1""")
def first_cwd(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events").where("session_id is not null").select("session_id", "event_id", F.to_json(F.struct(F.coalesce("transcript_path", F.lit("")).alias("cwd"))).alias("value"))
    return transcripts.first_cwd(jsonl.with_offsets(e, ["session_id"], "event_id", "value"), ["session_id"], "event_id", "value", "start", 600)


@query("SELECT obs_id, title FROM observations WHERE obs_id > 40 ORDER BY obs_id LIMIT 25")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.keyset_page(table(spark, d, "observations"), "obs_id", 40, 25).select("obs_id", "title")


@query("SELECT count(*) AS rows, count(DISTINCT obs_id) AS ids FROM observations")
def sink_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted twice into a table with a key are there once."""
    path, o = scratch(spark), table(spark, d, "observations").select("obs_id", "project_id", "title")
    for part in (o.where("obs_type = 'decision'"), o, o):
        mutate.insert_rows(part, path, ["obs_id"])
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct("obs_id").alias("ids"))


@query("""WITH t AS (SELECT obs_type, count(*) AS n FROM observations GROUP BY 1), r AS (SELECT '| ' || obs_type || ' | ' || n || ' |' AS line, row_number() OVER (ORDER BY obs_type) + 1 AS k FROM t)
SELECT * FROM (SELECT 0::BIGINT AS line_no, '| obs_type | n |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT k, line FROM r)""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    text = markdown.to_markdown(table(spark, d, "observations").groupBy("obs_type").agg(F.count("*").alias("n")).orderBy("obs_type"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


@query("SELECT provider, max_bytes::VARCHAR AS max_bytes, overlap_bytes::VARCHAR AS overlap_bytes FROM chunk_limits")
def markdown_source(spark: SparkSession, d: str) -> DataFrame:
    """A table written as Markdown and read back."""
    return markdown.read_table(spark, markdown.to_markdown(table(spark, d, "chunk_limits")), ["provider", "max_bytes", "overlap_bytes"])


# ---- predicates --------------------------------------------------------------------------------------------


@query(r"SELECT event_id FROM thin_events WHERE tool_name LIKE 'mcp\_\_%' ESCAPE '\'")
def like_underscore(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thin_events").where(F.col("tool_name").startswith("mcp__")).select("event_id")


@query("SELECT obs_id FROM observations WHERE list_contains(concepts, 'ordering') AND NOT list_contains(coalesce(files, []), 'README.md')")
def array_has(spark: SparkSession, d: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    o = table(spark, d, "observations").where(F.array_contains("concepts", "ordering") & ~F.array_contains(F.coalesce("files", none), "README.md"))
    return o.select("obs_id")


@query("SELECT 'all' AS asked, count(*) AS n FROM observations UNION ALL SELECT 'decision', count(*) FROM observations WHERE obs_type = 'decision' UNION ALL SELECT 'session', 0")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    count = lambda name, kind: browse.of_type(o, "obs_type", kind).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
    return count("all", None).unionByName(count("decision", "decision")).unionByName(count("session", "session"))


@query("SELECT count(*) AS n, count(DISTINCT project_id) AS projects FROM observations WHERE project_id = (SELECT min(project_id) FROM observations)")
def scope_forced(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    own = browse.scope_policy("  ", [], forced=o.agg(F.min("project_id")).first()[0])
    return browse.scoped(o, "project_id", own, []).agg(F.count("*").alias("n"), F.count_distinct("project_id").alias("projects"))


@query("""WITH p AS (SELECT substr(min(spool_hash), 1, 6) AS p FROM sealed_manifest WHERE spool_hash IS NOT NULL),
h AS (SELECT entry_id, spool_hash, count(*) OVER () AS n FROM (SELECT entry_id, spool_hash FROM sealed_manifest, p WHERE spool_hash LIKE p || '%' ORDER BY entry_id DESC LIMIT 5))
SELECT 'known' AS asked, entry_id, CASE WHEN n = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS verdict FROM h UNION ALL SELECT 'unknown', NULL, 'NOT_FOUND'""")
def short_id(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sealed_manifest").where("spool_hash is not null")
    known = m.agg(F.min("spool_hash")).first()[0][:6]
    find = lambda name, p: browse.resolve_short_id(m, "spool_hash", p, F.col("entry_id")).select(F.lit(name).alias("asked"), "entry_id", "verdict")
    return find("known", known.upper()).unionByName(find("unknown", "fffffffffffff"))


# ---- scalar functions --------------------------------------------------------------------------------------


@query("SELECT summary_id, sha256(concat_ws(chr(10), coalesce(project_id, ''), 'session', coalesce(summary, ''), to_json(coalesce(keywords, [])), to_json(coalesce(decisions, [])), to_json(coalesce(next_steps, [])))) AS digest FROM session_summaries")
def memory_hash(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    h = T.memory_hash(c("project_id"), F.lit("session"), c("summary"), c("keywords"), c("decisions"), c("next_steps"))
    return table(spark, d, "session_summaries").select("summary_id", h.alias("digest"))


@query("""SELECT obs_id, sha256('[' || concat_ws(',', coalesce(to_json(project_id)::VARCHAR, 'null'), coalesce(to_json(session_id)::VARCHAR, 'null'), coalesce(to_json(obs_type)::VARCHAR, 'null'), coalesce(to_json(subtitle)::VARCHAR, 'null'), coalesce(to_json(facts)::VARCHAR, 'null'), coalesce(discovery_tokens::VARCHAR, 'null')) || ']') AS digest FROM observations""")
def observation_hash(spark: SparkSession, d: str) -> DataFrame:
    h = T.json_hash(*[F.col(c) for c in ("project_id", "session_id", "obs_type", "subtitle", "facts", "discovery_tokens")])
    return table(spark, d, "observations").select("obs_id", h.alias("digest"))


@query("SELECT summary_id, 'capture:v05:' || project_id || ':' || session_id AS key, CASE WHEN project_id IS NOT NULL THEN session_id END AS session FROM session_summaries")
def rollup_key(spark: SparkSession, d: str) -> DataFrame:
    k = T.rollup_key(F.col("project_id"), F.col("session_id"))
    return table(spark, d, "session_summaries").select("summary_id", k.alias("key"), T.rollup_key_session(k).alias("session"))


@query("SELECT obs_id, concat_ws(chr(10), nullif(title, ''), nullif(array_to_string(facts, chr(10)), ''), nullif(narrative, '')) AS x FROM observations")
def observation_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select("obs_id", T.observation_text(F.col("title"), F.col("facts"), F.col("narrative")).alias("x"))


@query("""SELECT summary_id, concat_ws(chr(10), summary, CASE WHEN len(keywords) > 0 THEN '關鍵字: ' || array_to_string(keywords, ', ') END, CASE WHEN len(decisions) > 0 THEN '決策: ' || array_to_string(decisions, '; ') END) AS x FROM session_summaries""")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_summaries").select("summary_id", T.embedding_text(F.col("summary"), F.col("keywords"), F.col("decisions")).alias("x"))


@query(r"""SELECT event_id, regexp_replace(regexp_replace(tool_name || ' via spool and quill_notes-x', 'mcp__[a-z_\-]+__', '[工具]', 'gi'), 'quill[ _\-]?notes[a-z_\-]*|mcp-search|chroma[\-_a-z]*|smart_(search|outline|unfold)|get_observations|rollup|spool|observations?\b', '[工具]', 'gi') AS safe FROM thin_events""")
def leak_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thin_events").select("event_id", T.redact_leaks(F.concat("tool_name", F.lit(" via spool and quill_notes-x")), ("quill notes",)).alias("safe"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'x' || event_id AS note FROM events""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    m = T.merge_metadata(F.col("props"), "note", F.concat(F.lit('"x'), "event_id", F.lit('"')))
    v = F.try_parse_json(m)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.note", "string").alias("note"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::BIGINT = 69 THEN 70 ELSE json_extract_string(props, '$.k')::BIGINT END AS k, coalesce(json_extract_string(props, '$.k')::BIGINT = 69, false) AS applied FROM events""")
def metadata_cas(spark: SparkSession, d: str) -> DataFrame:
    """Metadata are changed only where they still are what was read."""
    m, ok = mutate.compare_and_set(F.col("props"), F.lit('{"k":  69}'), "k", F.lit("70"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(m), "$.k", "bigint").alias("k"), ok.alias("applied"))


@query(r"""WITH x AS (SELECT 'thin_events' AS t, event_id AS id, timestamp_text AS x FROM thin_events UNION ALL SELECT 'sealed_manifest', entry_id, moved_at FROM sealed_manifest)
SELECT t, id, CASE WHEN regexp_full_match(x, '\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])') THEN epoch_ms(TRY_CAST(x || ' 00:00:00+00' AS TIMESTAMPTZ))
WHEN regexp_full_match(x, '\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)') THEN epoch_us(TRY_CAST(regexp_replace(regexp_replace(x, '([+-]\d\d)(\d\d)$', '\1:\2'), '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ)) // 1000 END AS ms FROM x""")
def iso_instants(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, k, c: table(spark, d, t).select(F.lit(t).alias("t"), F.col(k).alias("id"), T.iso_instant(F.col(c)).alias("ms"))
    return side("thin_events", "event_id", "timestamp_text").unionByName(side("sealed_manifest", "entry_id", "moved_at"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN nullif(trim(project_id), '') END, CASE WHEN tool_name = 'Bash' THEN nullif(trim(writer_host), '') END, nullif(string_split(transcript_path, '/')[-2], ''), session_id) AS id FROM thin_events""")
def project_resolution(spark: SparkSession, d: str) -> DataFrame:
    root = F.regexp_replace("transcript_path", "/[^/]*$", "")
    own = T.project_id(F.when(F.col("event_id") % 5 == 0, F.col("project_id")), F.when(F.col("tool_name") == "Bash", F.col("writer_host")), F.lit(" "), root, F.col("session_id"))
    return table(spark, d, "thin_events").select("event_id", own.alias("id"))


_RULES = "narrative || ' AKIA' || lpad(obs_id::VARCHAR, 16, '0') || ' sk-' || repeat('a1', 12) || ' password: hunter2hunter2'"


@query("SELECT obs_id, 1::BIGINT AS aws, 1::BIGINT AS openai, 1::BIGINT AS labeled, 0::BIGINT AS google FROM observations WHERE narrative IS NOT NULL")
def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("narrative", F.lit(" AKIA"), F.lpad(F.col("obs_id").cast("string"), 16, "0"), F.lit(" sk-" + "a1" * 12 + " password: hunter2hunter2"))
    n = T.redaction_counts(x)
    one = lambda k, a: n[k].cast("long").alias(a)
    return table(spark, d, "observations").where("narrative is not null").select("obs_id", one("aws_access_key", "aws"), one("openai_api_key", "openai"), one("labeled_secret", "labeled"), one("google_api_key", "google"))


_WIDE = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3100}-\x{312f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"


@query(rf"""WITH p AS (SELECT p.pending_id, s.summary AS o, p.summary AS n FROM pending_summaries p JOIN session_summaries s ON s.summary_id = p.pending_id),
l AS (SELECT *, length(o) + len(regexp_extract_all(o, '{_WIDE}')) AS a, length(n) + len(regexp_extract_all(n, '{_WIDE}')) AS b FROM p)
SELECT pending_id, coalesce(a >= 200 AND b < a * 0.4, false) AS degraded FROM l""")
def degraded(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pending_summaries").select("pending_id", F.col("summary").alias("n"))
    s = table(spark, d, "session_summaries").select(F.col("summary_id").alias("pending_id"), F.col("summary").alias("o"))
    return p.join(s, "pending_id").select("pending_id", T.is_degraded(F.col("o"), F.col("n")).alias("degraded"))


@query("""WITH p AS (SELECT p.pending_id, list_filter(list_transform(list_concat(coalesce(s.next_steps, []), coalesce(p.next_steps, [])), lambda x: substr(x, 1, 40)), lambda x: x <> '') AS x FROM pending_summaries p JOIN session_summaries s ON s.summary_id = p.pending_id),
u AS (SELECT pending_id, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM p), f AS (SELECT pending_id, v, min(k) AS k FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pending_id ORDER BY k DESC) AS r FROM f)
SELECT p.pending_id, coalesce(string_agg(v, '|' ORDER BY k) FILTER (WHERE r <= 3), '') AS items FROM p LEFT JOIN r ON r.pending_id = p.pending_id GROUP BY 1""")
def merged_items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pending_summaries").select("pending_id", F.col("next_steps").alias("n"))
    s = table(spark, d, "session_summaries").select(F.col("summary_id").alias("pending_id"), F.col("next_steps").alias("o"))
    return p.join(s, "pending_id").select("pending_id", F.array_join(T.merge_items(F.col("o"), F.col("n"), 3, 40), "|").alias("items"))


@query("SELECT event_id, event_id AS held, 0::BIGINT AS lost, '{\"a\": {\"b\": ' || event_id || '}}' AS body FROM thin_events")
def line_fields(spark: SparkSession, d: str) -> DataFrame:
    line, fenced = F.concat(F.lit("tick held="), "event_id", F.lit(" xlost=7")), F.concat(F.lit('```json\n{"a": {"b": '), "event_id", F.lit("}}\n```"))
    return table(spark, d, "thin_events").select("event_id", T.summary_field(line, "held").alias("held"), T.summary_field(line, "lost").alias("lost"), T.json_candidate(fenced).alias("body"))


@query("""SELECT event_id, '‹transcript>' || tool_name || chr(10) || '［L7' AS safe FROM thin_events WHERE NOT regexp_matches(tool_name, '[^\\x00-\\x7F]')""")
def neutralised(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thin_events").where(~F.col("tool_name").rlike("[^\\x00-\\x7F]"))
    return e.select("event_id", T.neutralise_transcript(F.concat(F.lit("<tran​script>"), "tool_name", F.lit("\n  [L7"))).alias("safe"))


@query("""SELECT summary_id, CASE WHEN length(x) > 50 THEN substr(x, 1, 50) || '…〔後略 ' || (length(x) - 50) || ' 字元〕' ELSE x END AS clipped,
CASE WHEN length(x) > 60 THEN substr(x, 1, 30) || chr(10) || '…〔中略 ' || (length(x) - 60) || ' 字元〕…' || chr(10) || right(x, 30) ELSE x END AS middle FROM (SELECT summary_id, trim(summary, ' ') AS x FROM session_summaries)""")
def clipped(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("summary")
    return table(spark, d, "session_summaries").select("summary_id", transcripts.clip(s, 50).alias("clipped"), transcripts.clip_middle(s, 60).alias("middle"))


@query("""WITH b AS (SELECT obs_id, title, list_filter(coalesce(facts, []), lambda x: x <> '') AS f FROM observations WHERE title IS NOT NULL)
SELECT obs_id, title || CASE WHEN len(f) > 0 THEN chr(10) || array_to_string(f, chr(10)) ELSE '' END || chr(10) || '[圖片]' || chr(10) || '[工具參照 Bash]' AS flat FROM b""")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    """Content blocks in blocks: texts, a list of texts, an image, a reference to a tool."""
    o = table(spark, d, "observations").where("title is not null")
    q = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text")))
    inner = F.concat(F.lit('{"type":"tool_result","content":'), F.to_json(F.coalesce("facts", F.expr("cast(array() as array<string>)"))), F.lit("}"))
    doc = F.concat(F.lit("["), q(F.col("title")), F.lit(","), inner, F.lit(',{"type":"image"},{"type":"tool_reference","tool_name":"Bash"}]'))
    return o.select("obs_id", transcripts.flatten(doc).alias("flat"))


@query("""SELECT summary_id, true AS fits, coalesce(summary <> '', false) AND true AS parsed FROM session_summaries WHERE summary IS NOT NULL AND summary <> ''""")
def prior_clamp(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_summaries").where("summary <> ''")
    b = capture.clamp_prior(s, "summary_id", "summary", "decisions", "next_steps", 400)
    text = F.try_variant_get(F.try_parse_json("block"), "$.summary", "string")
    return b.select("summary_id", (F.octet_length("block") <= 400).alias("fits"), (text != "").alias("parsed"))


@query("""SELECT event_id, '[L' || event_id || ' 2025-01-08T06:19:34Z user] ' || tool_name AS a, '[L' || event_id || ' 2025-01-08T06:19:34Z tool_use] Bash {\"x\":1}' AS b FROM thin_events WHERE trim(tool_name) <> '' AND regexp_full_match(tool_name, '[A-Za-z0-9_.:/-]+')""")
def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Two lines of a transcript as text: a message and the use of a tool, each under its head."""
    line = F.concat(
        F.lit('{"type":"user","timestamp":"2025-01-08T06:19:34.053Z","message":{"content":[{"type":"thinking","thinking":"no"},{"type":"text","text":'), F.regexp_replace(F.to_json(F.array("tool_name")), r"^\[|\]$", ""),
        F.lit('},{"type":"tool_use","name":"Bash","input":{"x":1}}]}}'),
    )
    e = table(spark, d, "thin_events").where(F.col("tool_name").rlike("^[A-Za-z0-9_.:/-]+$")).select("event_id", line.alias("value"))
    r = transcripts.render(e, "value", "event_id")
    return r.groupBy("event_id").agg(F.max(F.when(F.col("part") == 1, F.col("shown"))).alias("a"), F.max(F.when(F.col("part") == 2, F.col("shown"))).alias("b"))

