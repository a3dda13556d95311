"""Queries of the training-data operators; every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.timeparse import with_interpretations
from weftline.llm import mixing, neardup, packing, pii, runs, spam, splitting, tokens, truncation
from weftline.plans.time_queries import P4_FOUND_SQL
from weftline.session import cut, table


def _runs(spark: SparkSession, sf_dir: str, timed: bool) -> DataFrame:
    events = table(spark, sf_dir, "thin_events")
    if not timed:
        return runs.collapse_runs(events)
    zones = table(spark, sf_dir, "host_zones").groupBy("writer_host").agg(F.min("zone_id").alias("host_zone"))
    events = with_interpretations(events.join(zones, "writer_host", "left"), "timestamp_text", "host_zone")
    return runs.collapse_runs(events, time_millis=F.get("readings", F.lit(0))["millis"], firsts=True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, False).where("n_events >= 3").select("session_id", "first_offset", "last_offset")


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, True)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("session_summaries", "summary_id"), ("pending_summaries", "pending_id")]
    a, b = (
        table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(k).alias("record_id"), F.col("writer_host").alias("source"), F.col("summary").alias("text"))
        for n, k in parts
    )
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_summaries(spark, sf_dir)).where("is_cut").select("table_name", "record_id")


def p2_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of every summary under the encodings and escapings that storage applies."""
    t = _summaries(spark, sf_dir).where("text is not null")
    return t.select("table_name", "record_id", *[v.cast("long").alias(f"len_{k}") for k, v in truncation.measures(F.col("text")).items()])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(truncation.truncated(_summaries(spark, sf_dir)))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "transcript_chunks"), table(spark, sf_dir, "chunk_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 0 and n_pieces > 1").select("chunk_id")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized chunk: bytes and digest of the text that its pieces give when their overlaps are taken off again, and
    whether all pieces are within the limit, overlap by no more than they may and leave no gap."""
    lim = table(spark, sf_dir, "chunk_limits").groupBy("provider").agg(F.min(F.struct("max_bytes", "overlap_bytes")).alias("l"))
    of = table(spark, sf_dir, "transcript_chunks").join(lim, "provider").select("chunk_id", "l.*")
    w = Window.partitionBy("chunk_id").orderBy("piece_no")  # the pieces of one item
    p = p3_pieces(spark, sf_dir).join(of, "chunk_id").withColumn("prev", F.lag("end_byte", 1, 0).over(w))
    new = F.expr("substring(encode(text, 'UTF-8'), int(prev - start_byte + 1), length(encode(text, 'UTF-8')))")
    p = p.select("*", F.hex(new).alias("new"), (F.octet_length("text") == F.col("end_byte") - F.col("start_byte")).alias("whole"))
    good = (F.col("end_byte") - F.col("start_byte") <= F.col("max_bytes")) & F.col("whole")
    joined = (F.col("prev") >= F.col("start_byte")) & (F.col("prev") - F.col("start_byte") <= F.col("overlap_bytes")) & (F.col("end_byte") > F.col("prev"))
    text = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), ""))
    return p.groupBy("chunk_id").agg(F.max("end_byte").alias("bytes"), F.md5(text).alias("digest"), F.every(good).alias("within"), F.every(joined).alias("joined"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = neardup.near_duplicates(table(spark, sf_dir, "observations"))
    pairs = neardup.near_duplicate_pairs(links, members)
    return pairs.select(F.col("id_a").alias("obs_id_a"), F.col("id_b").alias("obs_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = neardup.near_duplicates(table(spark, sf_dir, "observations"))
    return neardup.near_duplicate_groups(links, members).withColumnRenamed("id", "obs_id")


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, record_id, field_name, item_no, text) of all free texts that may hold personal data."""
    obs = table(spark, sf_dir, "observations")
    one = lambda df, name, key, field: df.select(
        F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.lit(field).alias("field_name"), F.lit(0).alias("item_no"), F.col(field).alias("text")
    )
    facts = obs.select(
        F.lit("observations").alias("table_name"), F.col("obs_id").alias("record_id"), F.lit("facts").alias("field_name"), F.posexplode("facts").alias("item_no", "text")
    )
    sums = one(table(spark, sf_dir, "session_summaries"), "session_summaries", "summary_id", "summary")
    return one(obs, "observations", "obs_id", "narrative").unionByName(facts).unionByName(sums)


def _given(spark: SparkSession, sf_dir: str) -> list[str]:
    # a fixed vocabulary
    return sorted({r[0] for r in table(spark, sf_dir, "given_names").where("given_name is not null").collect()})


#: The key of the reports over invented tables; real texts need a secret one.
TABLES_KEY = "key of the test tables"


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(personal_texts(spark, sf_dir), _given(spark, sf_dir), TABLES_KEY).drop("linked")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = p6_items(spark, sf_dir).where("pii_type <> 'birth_date'")  # a type that the problem does not list
    return items.select("table_name", "record_id", "field_name", "item_no", "pii_type", "char_start")


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_pii(personal_texts(spark, sf_dir), _given(spark, sf_dir), TABLES_KEY).drop("text")


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, violations): equal values have one pseudonym, different ones two, and what is masked is what is found."""
    texts, given = personal_texts(spark, sf_dir), _given(spark, sf_dir)
    items = cut(pii.find_pii(texts, given, TABLES_KEY))
    bare = items.select("pii_type", "linked", F.regexp_replace("pseudonym", "[^0-9A-Za-z]", "").alias("p")).distinct()
    clash = lambda by, rule: bare.groupBy("pii_type", by).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    key = ["table_name", "record_id", "field_name", "item_no"]
    found = items.groupBy(*key).agg(F.count("*").alias("found"))
    left = pii.mask_pii(texts, given, TABLES_KEY).select(*key, F.regexp_count("masked", F.lit("<(?:email|phone|identity_number|birth_date|street_address|person_name):")).alias("left")).where("left > 0")
    same = left.groupBy(*key).agg(F.sum("left").alias("left")).join(found, key, "full_outer").where("not left <=> found")
    return clash("linked", "one value, two pseudonyms").unionByName(clash("p", "two values, one pseudonym")).unionByName(same.agg(F.count("*").alias("violations")).select(F.lit("found, not masked").alias("rule"), "violations"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.score_pages(table(spark, sf_dir, "documents"))


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", packing.duplicate_cluster(F.col("text")).alias("cluster"), F.col("mean_conf").alias("weight")
    )
    return cut(tokens.with_token_counts(docs, "text", ["doc_id", "source", "cluster", "weight"]))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_document_tokens(spark, sf_dir), table(spark, sf_dir, "pack_capacity"), spread=packing.SOURCE_SPREAD)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(p7_pack(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack: documents that have a place, and how often a rule is broken: containers over their capacity, documents
    divided though they fit, tokens lost or doubled, pieces that leave room though they are not the last."""
    docs = _document_tokens(spark, sf_dir)
    caps = table(spark, sf_dir, "pack_capacity")
    packed = cut(packing.pack(docs, caps, spread=packing.SOURCE_SPREAD))
    size = F.col("end_token") - F.col("start_token")
    full = packed.where("container_id is not null").groupBy("pack_name", "container_id").agg(F.sum(size).alias("load")).join(caps, "pack_name")
    d = packed.groupBy("pack_name", "doc_id").agg(F.sum(size).alias("used"), F.count("*").alias("pieces"), F.max("end_token").alias("end")).join(docs.select("doc_id", "n_tokens"), "doc_id").join(caps, "pack_name")
    d = d.groupBy("pack_name").agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("divided"),
        F.count_if((F.col("used") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("lost"),
        F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))).alias("loose"),
    )
    return d.join(full.groupBy("pack_name").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull")), "pack_name")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(mixing.mix(docs, targets), docs, targets)


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the targets: usable documents, and how often a rule is broken: documents used too often, unevenly (by
    more than one), twice in the result, and sources over their budget."""
    docs, targets = _document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen = cut(mixing.mix(docs, targets))
    p = mixing.plan_mix(docs.where("n_tokens > 0"), targets).select("source", "documents", "max_repeats", "budget", "epochs")
    c = chosen.join(p, "source").groupBy("source").agg(
        F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"), F.count_if(~F.col("repeats").between(F.col("epochs"), F.col("epochs") + 1)).alias("uneven"),
        (F.count("*") - F.count_distinct("doc_id")).alias("twice"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.max("budget").alias("b"),
    )
    broken = [F.coalesce(c[k], F.lit(0)).cast("long").alias(k) for k in ("too_often", "uneven", "twice")]
    return p.join(c, "source", "left").select("source", "documents", *broken, F.coalesce((F.col("used") > F.col("b")).cast("long"), F.lit(0).cast("long")).alias("over_budget"))


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pages(spark, sf_dir).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_spam") <= F.col("n_lines")).alias("bounded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_lengths": p2_lengths,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rejoined": p3_rejoined,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_masked": p6_masked,
    "p6_rules": p6_rules,
    "p7_pack": p7_pack,
    "p7_report": p7_report,
    "p7_rules": p7_rules,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p8_rules": p8_rules,
    "p9_found": p9_found,
    "p9_pages": p9_pages,
    "p9_lines": p9_lines,
}

# Written from the problem's words, not from the operator: case and blanks around a name, names of wrappers before it and a
# number behind it make no other tool; neither do blanks, hyphens and single underscores within it.
_TOOL = r"regexp_replace(regexp_replace(lower(regexp_replace(tool_name, '^\s+|\s+$', '', 'g')), '^((functions?|default_api|tools?|api|multi_tool_use)(\.|/|::|:))+', ''), '\s*(#\s*[0-9]+|\(\s*[0-9]+\s*\)|\[\s*[0-9]+\s*\])$', '')"
_RUNS = f"""WITH e AS (SELECT session_id, transcript_offset AS o, event_id, nullif(regexp_replace(replace({_TOOL}, '__', '|'), '[\\s_\\-]+', '', 'g'), '') AS tool FROM thin_events),
f AS (SELECT session_id, o, min_by(tool, event_id) AS tool FROM e WHERE session_id IS NOT NULL AND o IS NOT NULL AND tool IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) - row_number() OVER (PARTITION BY session_id, tool ORDER BY o) AS i FROM f)
SELECT session_id, min(o) AS first_offset, max(o) AS last_offset FROM g GROUP BY session_id, tool, i HAVING count(*) >= 3"""

_COLLAPSED = f"""WITH i AS (SELECT record_id, utc_millis FROM ({P4_FOUND_SQL}) WHERE table_name = 'thin_events' UNION ALL
SELECT event_id, epoch_ms(timestamp_text::TIMESTAMPTZ) FROM thin_events WHERE regexp_full_match(timestamp_text, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z')),
e AS (SELECT session_id, transcript_offset AS o, event_id, tool_name, nullif(regexp_replace(replace({_TOOL}, '__', '|'), '[\\s_\\-]+', '', 'g'), '') AS tool, utc_millis AS t FROM thin_events LEFT JOIN i ON record_id = event_id),
d AS (SELECT session_id, o, tool, min(event_id) AS id, min_by(tool_name, event_id) AS name, min(t) AS t FROM e WHERE session_id IS NOT NULL AND o IS NOT NULL AND tool IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT session_id, o, min_by(tool, id) AS tool, min(id) AS id, min_by(name, id) AS name, arg_min_null(t, id) AS t FROM d GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) - row_number() OVER (PARTITION BY session_id, tool ORDER BY o) AS i FROM f)
SELECT session_id, tool, min(o) AS first_offset, max(o) AS last_offset, count(*) AS n_events, max(t) - min(t) AS duration_ms, min_by(id, o) AS event_id, min_by(name, o) AS tool_name FROM g GROUP BY session_id, tool, i
UNION ALL SELECT session_id, NULL, o, o, 1, NULL, event_id, tool_name FROM e WHERE session_id IS NULL OR o IS NULL OR tool IS NULL"""

_LEN = {
    "chars": "length(x)", "utf8": "strlen(x)", "utf16": "length(x) + length(regexp_replace(x, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))",
    "entities": "length(replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;'))",
    "json": "length(replace(replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), '..'), chr(9), '..'), chr(13), '..'))",
    "json_ascii": "length(replace(replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), '..'), chr(9), '..'), chr(13), '..')) + 5 * length(regexp_replace(x, '[\\x00-\\x7F]', '', 'g')) + 6 * length(regexp_replace(x, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))",
    "crlf": "length(replace(x, chr(10), chr(13) || chr(10)))", "crlf_utf8": "strlen(replace(x, chr(10), chr(13) || chr(10)))",
}
_LENGTHS = f"""WITH s AS (SELECT 'session_summaries' AS table_name, summary_id AS record_id, summary AS x FROM session_summaries UNION ALL SELECT 'pending_summaries', pending_id, summary FROM pending_summaries)
SELECT table_name, record_id, {', '.join(f'({v})::BIGINT AS len_{k}' for k, v in _LEN.items())} FROM s WHERE x IS NOT NULL"""

_SETS = r"""w AS (SELECT obs_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(title, ''), coalesce(narrative, ''), coalesce(array_to_string(facts, ' '), ''))), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS ws FROM observations WHERE obs_id IS NOT NULL),
u AS (SELECT obs_id, unnest(ws) AS t FROM w), c AS (SELECT a.obs_id AS a, b.obs_id AS b, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.obs_id < b.obs_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM c JOIN w x ON x.obs_id = a JOIN w y ON y.obs_id = b WHERE k >= 0.7 * (len(x.ws) + len(y.ws) - k))"""
_GROUPS = f"""WITH RECURSIVE {_SETS},
m AS (SELECT obs_id, min(obs_id) OVER (PARTITION BY ws) AS class_id FROM w WHERE len(ws) > 0),
e AS (SELECT a, b FROM pairs JOIN m x ON x.obs_id = a AND x.class_id = a JOIN m y ON y.obs_id = b AND y.class_id = b), s AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT x, y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x), g AS (SELECT x, least(x, min(y)) AS group_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS n FROM s GROUP BY x)
SELECT obs_id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(n, 0)::BIGINT AS n_links FROM m LEFT JOIN g ON g.x = class_id LEFT JOIN d ON d.x = class_id"""

#: Equivalent SQL where it is quick enough on whole tables; the rest is tested by brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "p1_found": _RUNS,
    "p1_collapsed": _COLLAPSED,
    "p2_lengths": _LENGTHS,
    "p3_rejoined": """SELECT chunk_id, strlen(raw)::BIGINT AS bytes, md5(raw) AS digest, true AS within, true AS joined FROM transcript_chunks JOIN (SELECT provider, min(max_bytes) AS m FROM chunk_limits GROUP BY 1) USING (provider) WHERE strlen(raw) > m""",
    "p7_rules": """SELECT pack_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS divided, 0::BIGINT AS lost, 0::BIGINT AS loose, 0::BIGINT AS overfull FROM pack_capacity""",
    "p8_rules": """SELECT t.source, count(d.doc_id) AS documents, 0::BIGINT AS too_often, 0::BIGINT AS uneven, 0::BIGINT AS twice, 0::BIGINT AS over_budget FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY 1""",
    "p9_lines": """SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S')))::BIGINT AS n_lines, true AS bounded FROM documents""",
    "p5_found": f"WITH {_SETS} SELECT a AS obs_id_a, b AS obs_id_b FROM pairs",
    "p5_groups": _GROUPS,
    "p6_rules": "SELECT rule, 0::BIGINT AS violations FROM (VALUES ('one value, two pseudonyms'), ('two values, one pseudonym'), ('found, not masked')) t(rule)",
    "p3_found": """SELECT chunk_id FROM transcript_chunks JOIN (SELECT provider, min(max_bytes) AS m FROM chunk_limits GROUP BY 1) USING (provider) WHERE octet_length(encode(raw)) > m""",
}
