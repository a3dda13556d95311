"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.timeparse import ABBREVIATIONS
from weftline.operators.timestamps import normalise_timestamps
from weftline.session import table


def timed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, record_id, time_text, source) of the three tables with timestamp texts."""
    parts = [("thin_events", "event_id", "timestamp_text"), ("stop_sentinels", "sentinel_id", "timestamp_text"), ("sealed_manifest", "entry_id", "moved_at")]
    out = None
    for name, key, text in parts:
        df = table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.col(text).alias("time_text"), F.col("writer_host").alias("source")
        )
        out = df if out is None else out.unionByName(df)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a text in the normal form needs no case; its record still stands in its source's order as an anchor
    records = timed_records(spark, sf_dir)
    done = normalise_timestamps(records, table(spark, sf_dir, "host_zones"), keep_normal=False)
    return done.where("utc_millis is not null").select("table_name", "record_id", "utc_millis")


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(timed_records(spark, sf_dir), table(spark, sf_dir, "host_zones"))


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every record, those in the normal form included."""
    return p4_normalised(spark, sf_dir).select("table_name", "record_id", "utc_millis")


def p4_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table how many records have more than one reading, among which the Viterbi pass chooses."""
    r = p4_normalised(spark, sf_dir).groupBy("table_name")
    return r.agg(F.count("*").alias("records"), F.count_if(F.col("n_readings") > 1).alias("with_choice"), F.count_if(F.col("n_readings") == 0).alias("without"))


def p4_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the rules for day and month and for local times that occur twice: Viterbi decides."""
    records = timed_records(spark, sf_dir)
    return normalise_timestamps(records, table(spark, sf_dir, "host_zones"), day_first=None, fold="both")


_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm])?"
_Z = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{2}|[A-Za-z]{2,5}|\[?[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+\]?|\[[A-Za-z]{2,5}\])?(?:\[[A-Za-z_/+\-0-9]+\])?"
_MON = r"([A-Z][a-z]{2})[a-z]*\.?"
_FORMS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|\s+){_T}{_Z}$", "y mo d h mi s f ap z"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(){_Z}$", "y mo d h mi s f ap z"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?(?:[Tt]|\s+){_T}{_Z}$", "d mo y h mi s f ap z"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),?\s+{_T}{_Z}$", "d mo y h mi s f ap z"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_T}{_Z}$", "mo d y h mi s f ap z"),
]


def _extract(k: int) -> str:
    pattern, names = _FORMS[k]
    return f"regexp_extract(x, '{pattern}', [{', '.join(repr(n) for n in names.split())}])"


_PICK = " ".join(f"WHEN regexp_matches(x, '{_FORMS[k][0]}') THEN " + "struct_pack(" + ", ".join(f"{n} := e{k}.{n}" for n in "y mo d h mi s f ap z".split()) + ")" for k in range(5))
_OFFSETS = ", ".join(f"('{k}', {(1 if v[0] == '+' else -1) * (int(v[1:3]) * 60 + int(v[4:]))})" for k, v in ABBREVIATIONS.items())

#: The same by regular expressions and the database's own zone rules; the earlier of two equal local times, and the offset
#: before a change for skipped ones, are derived from the readings of the clock three hours before.
P4_FOUND_SQL = rf"""WITH rec AS (SELECT 'thin_events' AS table_name, event_id AS record_id, timestamp_text AS raw, writer_host FROM thin_events
UNION ALL SELECT 'stop_sentinels', sentinel_id, timestamp_text, writer_host FROM stop_sentinels UNION ALL SELECT 'sealed_manifest', entry_id, moved_at, writer_host FROM sealed_manifest),
t AS (SELECT table_name, record_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x, zone_id FROM rec LEFT JOIN host_zones USING (writer_host)
WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z$')),
e AS (SELECT *, {', '.join(f'{_extract(k)} AS e{k}' for k in range(5))} FROM t),
p AS (SELECT table_name, record_id, x, zone_id, CASE {_PICK} END AS g FROM e),
q AS (SELECT table_name, record_id, x, zone_id, g.ap AS ap, rpad(substr(g.f, 1, 3), 3, '0') AS ms, regexp_replace(g.z, '[\[\]]', '', 'g') AS z, TRY_CAST(g.h AS INT) AS h0,
CASE WHEN regexp_matches(g.mo, '^[A-Z]') THEN (strpos('JanFebMarAprMayJunJulAugSepOctNovDec', g.mo) + 2) // 3 ELSE TRY_CAST(g.mo AS INT) END AS mo, TRY_CAST(g.y AS INT) AS y, TRY_CAST(g.d AS INT) AS d, TRY_CAST(g.mi AS INT) AS mi,
CASE WHEN g.s = '' THEN 0 ELSE TRY_CAST(g.s AS INT) END AS s FROM p WHERE g IS NOT NULL),
w AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, CASE WHEN ap = '' THEN h0 ELSE h0 % 12 + CASE WHEN lower(ap) = 'pm' THEN 12 ELSE 0 END END, mi, s) AS TIMESTAMP) AS wall FROM q),
o AS (SELECT w.*, regexp_replace(z, '^(UTC|GMT)([+-])', '\2') AS zz, m FROM w LEFT JOIN (VALUES {_OFFSETS}) a(k, m) ON a.k = upper(w.z)),
r AS (SELECT *, CASE WHEN m IS NOT NULL THEN m WHEN regexp_matches(zz, '^[+-]\d') THEN (CASE WHEN zz[1] = '-' THEN -1 ELSE 1 END) *
(TRY_CAST(substr(zz, 2, 2) AS INT) * 60 + CASE WHEN length(zz) > 3 THEN TRY_CAST(right(zz, 2) AS INT) ELSE 0 END) END AS minutes, CASE WHEN z = '' THEN zone_id WHEN contains(z, '/') THEN z END AS named FROM o WHERE wall IS NOT NULL),
n AS (SELECT *, timezone(named, wall) AS c, timezone(named, wall - INTERVAL 3 HOUR) + INTERVAL 3 HOUR AS i FROM r WHERE minutes IS NULL AND named IN (SELECT name FROM pg_timezone_names())),
u AS (SELECT table_name, record_id, epoch_us(wall) // 1000 - minutes * 60000 + CASE WHEN ms = '000' OR ms = '' THEN 0 ELSE TRY_CAST(ms AS INT) END AS utc_millis FROM r WHERE minutes IS NOT NULL
UNION ALL SELECT table_name, record_id, epoch_us(CASE WHEN timezone(named, i) = wall THEN least(i, c) WHEN timezone(named, c) = wall THEN c ELSE i END) // 1000 + CASE WHEN ms = '000' OR ms = '' THEN 0 ELSE TRY_CAST(ms AS INT) END FROM n
UNION ALL SELECT table_name, record_id, CASE length(x) WHEN 10 THEN TRY_CAST(x AS BIGINT) * 1000 ELSE TRY_CAST(substr(x, 1, 13) AS BIGINT) END FROM p WHERE regexp_matches(x, '^(\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}})$'))
SELECT table_name, record_id::BIGINT AS record_id, utc_millis::BIGINT AS utc_millis FROM u WHERE utc_millis IS NOT NULL"""

_ALL = """SELECT 'thin_events' AS table_name, event_id AS record_id, timestamp_text AS x FROM thin_events UNION ALL SELECT 'stop_sentinels', sentinel_id, timestamp_text FROM stop_sentinels
UNION ALL SELECT 'sealed_manifest', entry_id, moved_at FROM sealed_manifest"""
P4_INSTANTS_SQL = rf"""SELECT a.table_name, a.record_id, coalesce(f.utc_millis, CASE WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z') THEN epoch_ms(TRY_CAST(x AS TIMESTAMPTZ)) END) AS utc_millis
FROM ({_ALL}) a LEFT JOIN ({P4_FOUND_SQL}) f ON f.table_name = a.table_name AND f.record_id = a.record_id"""
