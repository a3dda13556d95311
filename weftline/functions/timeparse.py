"""Instants out of timestamp texts of many forms, as JVM expressions.

Every text gives an array of valid interpretations, most preferred first; texts that name no instant give
an empty one. A text has several interpretations only where its form leaves a choice open: day and month
both possible (``day_first=None``), or a local time that occurs twice (``fold="both"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and zone abbreviations with their offsets.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "Z": "+00:00", "WET": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
    "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "MSK": "+03:00", "IST": "+05:30", "SGT": "+08:00", "HKT": "+08:00", "JST": "+09:00", "KST": "+09:00",
    "AWST": "+08:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00",
    "NZDT": "+13:00",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm])?"
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{2}|[A-Za-z]{2,5}|\[?[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+\]?|\[[A-Za-z]{2,5}\])?(?:\[[A-Za-z_/+\-0-9]+\])?"
_MONTH = r"([A-Z][a-z]{2})[a-z]*\.?"
_DAY = r"(?:[A-Za-z]{3,9},?\s+)?"

#: label -> (pattern, replacement): year|month|day|hour|minute|second|fraction|am/pm|zone
FORMS = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|\s+){_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "compact": (
        rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$",
        "$1|$2|$3|$4|$5|$6|$7||$8",
    ),
    "dmy": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?(?:[Tt]|\s+){_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "day_name": (rf"^{_DAY}(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}),?\s+{_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "name_day": (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}
EPOCH = r"^\d{10}(?:\d{3}){0,3}(?:\.\d+)?$"
#: The usual form with its zone, which a plain cast reads.
PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)$"
#: The exact normal form.
NORMAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"

INTERPRETATIONS = "array<struct<form:string,millis:long>>"


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that the JVM's time zone rules know."""
    names = spark._jvm.java.lang.String.join("\n", spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(z for z in names.split("\n") if "/" in z or z in ("UTC", "GMT"))


def _zone(named: Column, host_zone: Column, known: list[str]) -> Column:
    """The zone a text names, else that of its host; null for names and offsets that no zone has."""
    z = F.regexp_replace(named, r"[\[\]]", "")
    bare = F.regexp_replace(z, r"^(?:UTC|GMT)(?=[+-])", "")
    minutes = F.regexp_extract(bare, r"(\d{2})$", 1)
    offset = F.concat(F.substring(bare, 1, 3), F.lit(":"), F.when(F.length(bare) > 3, minutes).otherwise("00"))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    zone = (
        F.when(z == "", host_zone)
        .when(bare.rlike(r"^[+-]\d"), offset)
        .when(z.contains("/"), z)
        .otherwise(F.try_element_at(table, F.upper(z)))
    )
    return F.when(zone.isin(known) | zone.rlike(r"^[+-](?:0\d|1[0-7]):[0-5]\d$"), zone)


def _parts(x: Column) -> Column:
    """[form, year, month, day, hour, minute, second, fraction, am/pm, zone], or null."""
    chain = None
    for form, (pattern, order) in FORMS.items():
        hit = F.split(F.regexp_replace(x, pattern, f"{form}|{order}"), r"\|")
        chain = F.when(x.rlike(pattern), hit) if chain is None else chain.when(x.rlike(pattern), hit)
    return chain


def _epoch(x: Column) -> Column:
    whole = F.regexp_extract(x, r"^(\d+)", 1)
    millis = F.rpad(F.regexp_extract(x, r"\.(\d{1,3})", 1), 3, "0")
    return F.when(x.rlike(EPOCH), F.when(F.length(whole) == 10, F.concat(whole, millis)).otherwise(F.substring(whole, 1, 13)).cast("long"))


def with_interpretations(
    df: DataFrame, text: str, host_zone: str, out: str = "readings", day_first: bool | None = True, fold: str = "earlier"
) -> DataFrame:
    """``df`` with a column of all valid instants of a text: array of (form, millis since 1970 UTC),
    most preferred first.

    A text without a zone is read in the zone in column ``host_zone``; where that is null it has no
    interpretation. Finer digits than milliseconds are dropped, missing seconds are zero. Local times that
    occur twice mean the earlier instant (``fold="both"``: either), skipped ones use the offset before the
    change. With ``day_first=None`` numbers before a final year are read both ways where both are dates.
    Null, empty and useless texts give an empty array; columns of ``df`` whose names start with ``_t_`` are lost.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    g = lambda k: F.get(F.col("_t_p"), F.lit(k))
    hour = g(4).try_cast("int")
    half = F.lower(g(8))
    named = F.instr(F.lit(MONTHS), g(2))
    d = df.withColumn("_t_x", F.regexp_replace(F.col(text), r"^[\s\u00a0\u3000\ufeff]+|[\s\u00a0\u3000\ufeff]+$", ""))
    d = d.withColumn("_t_plain", F.col("_t_x").rlike(PLAIN))
    d = d.withColumn("_t_p", F.when(~F.col("_t_plain"), _parts(F.col("_t_x")))).withColumn("_t_e", F.when(~F.col("_t_plain"), _epoch(F.col("_t_x"))))
    month = F.when(g(2).rlike("^[A-Z]"), F.when(named % 3 == 1, ((named + 2) / 3).cast("int"))).otherwise(g(2).try_cast("int"))
    d = d.select(
        *own,
        "_t_x",
        "_t_e",
        F.when(F.col("_t_plain"), F.unix_millis(F.col("_t_x").try_cast("timestamp"))).alias("_t_cast"),
        g(0).alias("_t_form"),
        g(1).try_cast("int").alias("_t_y"),
        month.alias("_t_mo"),
        g(3).try_cast("int").alias("_t_d"),
        F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).alias("_t_h"),
        g(5).try_cast("int").alias("_t_mi"),
        F.coalesce(g(6).try_cast("int"), F.lit(0)).cast("decimal(16,6)").alias("_t_s"),
        F.when(g(7) == "", 0).otherwise(F.rpad(F.substring(g(7), 1, 3), 3, "0").try_cast("int")).alias("_t_ms"),
        _zone(g(9), F.col(host_zone), known_zones(df.sparkSession)).alias("_t_zone"),
        F.when(g(9) == "", "/host").otherwise("/zone").alias("_t_kind"),
    )
    zone = F.col("_t_zone")

    def reading(month: str, day: str, label: str) -> list[Column]:
        form = F.concat("_t_form", F.lit(label), "_t_kind")
        at = F.try_make_timestamp("_t_y", month, day, "_t_h", "_t_mi", "_t_s", zone)
        early = F.unix_millis(at) + F.col("_t_ms")
        found = [F.struct(form.alias("form"), early.alias("millis"))]
        if fold == "both":  # three hours on, the offset after the change holds
            wall = F.expr(f"try_make_timestamp_ntz(_t_y, {month}, {day}, _t_h, _t_mi, _t_s)")
            later = F.to_utc_timestamp((wall + F.expr("interval 3 hours")).cast("timestamp"), zone)
            after = F.unix_millis(later) - 3 * 3600_000
            same = F.from_utc_timestamp(F.timestamp_millis(after), zone) == wall.cast("timestamp")
            twice = (after > F.unix_millis(at)) & same
            twice = F.when(zone.contains("/"), twice)  # an offset has no hour that comes again
            found.append(F.when(twice, F.struct(F.concat(form, F.lit("/later")).alias("form"), (after + F.col("_t_ms")).alias("millis"))))
        return found

    swapped = F.col("_t_form") == "dmy"
    plain, other = reading("_t_mo", "_t_d", ""), reading("_t_d", "_t_mo", "/mdy")
    none = F.expr(f"cast(array() as {INTERPRETATIONS})")
    if day_first is True:
        read = F.array(*plain)
    elif day_first is False:
        read = F.when(swapped, F.array(*other)).otherwise(F.array(*plain))
    else:
        read = F.when(swapped & (F.col("_t_mo") != F.col("_t_d")), F.array(*plain, *other)).otherwise(F.array(*plain))
    valid = F.filter(read, lambda r: r["millis"].isNotNull())
    value = (
        F.when(F.col("_t_cast").isNotNull(), F.array(F.struct(F.lit("ymd/zone").alias("form"), F.col("_t_cast").alias("millis"))))
        .when(F.col("_t_e").isNotNull(), F.array(F.struct(F.concat(F.lit("epoch"), F.length("_t_x")).alias("form"), F.col("_t_e").alias("millis"))))
        .when(F.col("_t_form").isNotNull(), valid)
        .otherwise(none)
    )
    return d.select(*own, value.cast(INTERPRETATIONS).alias(out))


def is_normal(text: Column) -> Column:
    return F.coalesce(text.rlike(NORMAL), F.lit(False))
