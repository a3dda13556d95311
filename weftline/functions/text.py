"""Text functions as JVM expressions (Column -> Column); the few order-dependent ones are Arrow UDFs at the end."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_TERMS = 8

# Patterns of secrets, in the order in which they apply.
SECRET_RULES = {
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "google_api_key": r"AIza[0-9A-Za-z_-]{30,}",
    "openai_api_key": r"sk-[0-9A-Za-z_-]{20,}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
}
# Fixed value: labels behind which a secret follows.
LABELED_SECRET = (
    r"(?i)\b((?:[A-Za-z0-9]+[_-])*(?:password|passwd|api[_ -]?key|secret[_ -]?key|access[_ -]?token))"
    r"([\"']?\s*[:=]\s*[\"'`]?)(?!\[REDACTED:)([^\s\"'`]{8,})"
)
# Character classes of the estimators.
CJK = r"㐀-鿿豈-﫿"
PUNCT = r"!-/:-@\[-`{-~"
WIDE = r"　-〿぀-ヿ㄀-ㄯ㐀-䶿一-鿿가-힯豈-﫿＀-￯"
EXAM_CJK = r"⺀-鿿가-힯豈-﫿＀-￯"
# Labels of the parts of an embedded text, tags of prompt blocks.
KEYWORDS_LABEL, DECISIONS_LABEL = "關鍵字: ", "決策: "
PROMPT_TAGS = r"(?i)<(/?)(prior_summary|transcript|observations)\s*>"


def keyword_terms(query: str) -> list[str]:
    """Blank-separated terms in order, repeats dropped with regard to case, at most eight."""
    return list(dict.fromkeys(query.split()))[:MAX_TERMS]


def keyword_hits(haystack: Column, terms: list[str]) -> Column:
    """How many of the terms occur in a lower-case haystack."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.when(haystack.contains(t.lower()), 1).otherwise(0)
    return hits


def joined(*parts: Column) -> Column:
    """Lower-case search text of string and array parts, nulls as empty."""
    return F.lower(F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(" ")] if k else []) + [F.coalesce(p, F.lit(""))]]))


def redact(text: Column) -> Column:
    """Secrets replaced by ``[REDACTED:rule]``; a second pass changes nothing."""
    for rule, pattern in SECRET_RULES.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED:{rule}]")
    return F.regexp_replace(text, LABELED_SECRET, "$1$2[REDACTED:labeled_secret]")


def redaction_counts(text: Column) -> Column:
    """Struct of the number of replacements per rule, each counted on the text that its rule sees."""
    out = []
    for rule, pattern in SECRET_RULES.items():
        out.append(F.regexp_count(text, F.lit(pattern)).alias(rule))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{rule}]")
    out.append(F.regexp_count(text, F.lit(LABELED_SECRET)).alias("labeled_secret"))
    return F.struct(*out)


def token_estimate(text: Column) -> Column:
    """Estimated tokens: Chinese characters 1, ASCII words 1.3, ASCII marks and line ends 0.3, other signs 1, plus 12."""
    n = lambda t, p: F.regexp_count(t, F.lit(p))
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    cjk, words = n(text, f"[{CJK}]"), n(split, "[A-Za-z0-9]+")
    marks = n(text, f"[{PUNCT}\r\n]")
    other = n(text, rf"[^\s 　﻿A-Za-z0-9{CJK}{PUNCT}]")
    # whole tenths, so that no rounding error moves the ceiling
    tenths = cjk * 10 + words * 13 + marks * 3 + other * 10 + 120
    return F.expr("bigint(0)") + F.ceil(tenths / 10)


def exam_token_estimate(text: Column) -> Column:
    """The rougher estimate: Chinese 1.3, the rest 0.4 a character, plus 1."""
    cjk = F.regexp_count(text, F.lit(f"[{EXAM_CJK}]"))
    return F.floor((cjk * 13 + (F.char_length(text) - cjk) * 4) / 10) + 1


def content_length(text: Column) -> Column:
    """Characters, wide ones counted twice."""
    return F.char_length(text) + F.regexp_count(text, F.lit(f"[{WIDE}]"))


def is_degraded(prior: Column, following: Column, max_chars: int | None = None) -> Column:
    """A summary that shrank below 0.4 of one of at least 200."""
    clamped = F.substring(prior, 1, max_chars) if max_chars is not None else prior
    enough = (content_length(prior) >= 200) & (content_length(clamped) >= 200)
    return F.coalesce(enough & (content_length(following) < content_length(clamped) * 0.4), F.lit(False))


def merge_pending_text(older: Column, newer: Column, max_chars: int) -> Column:
    """The newer text whole (cut at the limit), before it as much of the end of the older one as there is room for."""
    new = F.substring(newer, 1, max_chars)
    room = F.lit(max_chars) - F.char_length(new) - 2
    kept = F.when(F.char_length(older) > room, F.right(older, room)).otherwise(older)
    use = F.coalesce((older != "") & (older != new) & (room > 0), F.lit(False))
    return F.when(use, F.concat(kept, F.lit("\n\n"), new)).otherwise(new)


def merge_items(older: Column, newer: Column, max_items: int, max_chars: int) -> Column:
    """Both lists, entries cut, empties and repeats dropped, the last ``max_items`` kept."""
    none = F.expr("cast(array() as array<string>)")
    both = F.concat(F.coalesce(older, none), F.coalesce(newer, none))
    items = F.array_distinct(F.filter(F.transform(both, lambda x: F.substring(x, 1, max_chars)), lambda x: x != ""))
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - max_items + 1), F.lit(max_items))


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def index_title(text: Column, limit: int = 180) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def neutralise_prompt(text: Column) -> Column:
    """Tags that would open or close a block of a prompt get a full-width bracket."""
    return F.regexp_replace(text, PROMPT_TAGS, "＜$1$2>")


def strip_lines_with(text: Column, marker: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.contains(marker)), "\n")


def json_candidate(text: Column) -> Column:
    """From the first brace to the last, code fences aside; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def path_basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def summary_field(line: Column, field: str) -> Column:
    return F.coalesce(F.regexp_extract(line, rf"(?:^|\s){field}=(\d+)", 1).try_cast("long"), F.lit(0))


def embedding_text(summary: Column, keywords: Column, decisions: Column) -> Column:
    """Summary, then labelled lists, empty ones left out."""
    part = lambda label, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, sep)))
    return F.concat_ws("\n", summary, part(KEYWORDS_LABEL, keywords, ", "), part(DECISIONS_LABEL, decisions, "; "))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def memory_hash(project: Column, kind: Column, summary: Column, keywords: Column, decisions: Column, next_steps: Column) -> Column:
    """SHA-256 of a memory: its texts and the JSON of its lists, one a line; null lists count as empty."""
    none = F.expr("cast(array() as array<string>)")
    z = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\n", z(project), z(kind), z(summary), *[F.to_json(F.coalesce(c, none)) for c in (keywords, decisions, next_steps)]), 256)


def json_list(*parts: Column) -> Column:
    """The JSON of a list whose parts have different types: texts quoted, lists as they are, nulls as null."""
    one = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    each = [F.when(c.isNull(), "null").otherwise(one(c)) for c in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]"))


def json_hash(*parts: Column) -> Column:
    return F.sha2(json_list(*parts), 256)


def rollup_key(project: Column, session: Column) -> Column:
    return F.concat(F.lit("capture:v05:"), project, F.lit(":"), session)


def rollup_key_session(key: Column) -> Column:
    """The session of a rollup's key; null for keys of another form."""
    return F.nullif(F.regexp_extract(key, "^capture:v05:[^:]*:(.+)$", 1), F.lit(""))


def observation_text(title: Column, facts: Column, narrative: Column) -> Column:
    """The text of an observation that is embedded: title, facts one a line, narrative; what is empty is left out."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", part(title), part(F.array_join(facts, "\n")), part(narrative))


# Words that tell which kind of system an answer came from; names of systems are the caller's.
LEAKS = (r"mcp__[a-z_\-]+__", r"mcp-search", r"chroma[\-_a-z]*", r"smart_(search|outline|unfold)", r"get_observations", r"rollup", r"spool", r"observation[s]?\b")
LEAK_MARK = "[工具]"


def redact_leaks(text: Column, systems: tuple[str, ...] = ()) -> Column:
    """Names of tools and of the given systems replaced by a mark; a system's words may be joined by a hyphen, an underscore or
    a blank, and what is attached to its name goes with it."""
    named = [r"[ _\-]?".join(re.escape(w) for w in s.split()) + r"[a-z_\-]*" for s in systems if s.strip()]
    for p in (LEAKS[0], *named, *LEAKS[1:]):
        text = F.regexp_replace(text, f"(?i){p}", LEAK_MARK)
    return text


def merge_metadata(metadata: Column, key: str, value: Column) -> Column:
    """JSON metadata with one key set to a JSON value, the others as they are, the new one last; null or malformed metadata
    count as empty."""
    whole = F.when(F.try_parse_json(metadata).isNotNull(), metadata)
    entries = F.map_entries(F.coalesce(F.from_json(whole, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")))
    named = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    parts = F.transform(F.filter(entries, lambda e: e["key"] != key), lambda e: F.concat(named(e["key"]), F.lit(":"), F.to_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(F.concat(F.lit(f'"{key}":'), value))), ","), F.lit("}"))


def iso_instant(text: Column) -> Column:
    """Milliseconds of a strict ISO-8601 text: a date alone is midnight UTC and must exist in the calendar, a time needs a
    zone; all else is null."""
    day = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
    timed = rf"^{day}T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{{1,9}})?)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)$"
    zone = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(T\d{2}:\d{2})(?=[Z+-])", "$1:00")
    return F.when(text.rlike(f"^{day}$"), F.unix_millis(F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))).when(text.rlike(timed), F.unix_millis(zone.try_cast("timestamp")))


def project_id(explicit: Column, env: Column, marker: Column, root: Column, folder: Column) -> Column:
    """The first of an explicit id, one of the environment, a marker's, the name of the repository's root and that of the
    folder that is not blank."""
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(named(explicit), named(env), named(marker), named(path_basename(root)), named(path_basename(folder)))


def recurrence_next(anchor: Column, now: Column, step: Column) -> Column:
    """The first of anchor + k * step, k >= 1, after now (all in one integer unit)."""
    return anchor + F.greatest(F.lit(1), F.floor((now - anchor) / step) + 1) * step


def encode_segment(name: Column) -> Column:
    """A name as a safe path segment: what is no letter, digit, dot, hyphen or underscore becomes ``_u`` and four
    hexadecimal digits for each half of it, and so do a leading dot and an underscore that would begin such a group; '' becomes 'unknown'."""
    x = F.regexp_replace(F.regexp_replace(name, "_(?=u)", "_u005f"), r"^\.", "_u002e")
    code = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", "_u$1")
    spelled = F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike("[A-Za-z0-9._-]"), c).otherwise(code(c))), "")
    return F.when(name == "", "unknown").otherwise(F.when(x.rlike("[^A-Za-z0-9._-]"), spelled).otherwise(x))


def decode_segment(segment: Column) -> Column:
    """The name of a segment; groups that stand for half a character stay as they are."""
    parts = F.split(segment, "_u(?=[0-9a-f]{4})")
    whole = lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 2**30))
    rest = F.transform(F.slice(parts, 2, 2**30), lambda p: F.when(p.rlike("^d[89a-f]"), F.concat(F.lit("_u"), p)).otherwise(whole(p)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


HIDDEN, TRANSCRIPT_TAG, LINE_HEAD = "[\u200b-\u200f\u2060\ufeff]", r"(?i)(?:<|&lt;)(\s*/?\s*transcript)", r"(^|\n)\s*\[(?=L\d)"


def neutralise_transcript(text: Column) -> Column:
    """Zero-width signs dropped, transcript tags and forged line heads made harmless. Compatibility forms are folded only
    where that uncovers a tag: texts with such a sign beside the word are the only ones that leave the JVM."""
    seen = F.regexp_replace(text, HIDDEN, "")
    folded = _compatible(F.when(seen.rlike("[^\\x00-\\x7F]"), seen))
    chosen = F.when(folded.rlike(TRANSCRIPT_TAG), folded).otherwise(seen)
    return F.regexp_replace(F.regexp_replace(chosen, TRANSCRIPT_TAG, "‹$1"), LINE_HEAD, "$1［")
