"""Transcripts: files that may be compressed, their working folder, complete lines, readable lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import neutralise_transcript

#: Sizes beyond which a transcript is refused, stored and inflated.
MAX_STORED, MAX_INFLATED, HEAD_BYTES = 64 << 20, 128 << 20, 256 << 10


def _files(spark: SparkSession, folder: str, max_stored: int, max_inflated: int) -> DataFrame:
    """(name, path, refused) of the transcripts of a folder, one row a file; refused is the reason or null. A plain file
    hides a compressed one of the same name."""

    @F.pandas_udf("long")
    def inflated(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else _inflated(c, max_inflated))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").load(folder)
    packed = F.col("path").endswith(".zst")
    stored = files.select("path", "length", F.when(packed & (F.col("length") <= max_stored), F.col("content")).alias("content"))
    size = F.when(F.col("content").isNotNull(), inflated("content"))
    why = F.when(F.col("length") > max_stored, "stored size").when(size < 0, "not readable").when(size > max_inflated, "inflated size")
    whole = stored.select(F.regexp_replace("path", r"\.zst$", "").alias("name"), "path", why.alias("refused"))
    return whole.groupBy("name").agg(F.min(F.struct("path", "refused")).alias("f")).select("name", "f.*")  # the plain name sorts first


def _inflated(content: bytes, most: int) -> int:
    """Bytes of a compressed file, counted up to just beyond ``most``; -1 if it is damaged."""
    import zstandard

    total = 0
    try:
        with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as r:
            while total <= most and (part := r.read(1 << 20)):
                total += len(part)
    except zstandard.ZstdError:
        return -1
    return total


def _bare(c: str) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def refused_transcripts(spark: SparkSession, folder: str, max_stored: int = MAX_STORED, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """(path, reason) of the files that :func:`read_transcripts` leaves out, so that none goes missing unseen."""
    f = _files(spark, folder, max_stored, max_inflated)
    return f.where("refused is not null").select(_bare("path").alias("path"), F.col("refused").alias("reason"))


def read_transcripts(spark: SparkSession, folder: str, max_stored: int = MAX_STORED, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """(path, line_no, value) of all JSONL transcripts under a folder, plain or ``.zst`` (read by the extension), lines
    counted from 0 within a file. A plain file hides a compressed one of the same name; files above a size are left out
    here and listed by :func:`refused_transcripts`."""
    keep = _files(spark, folder, max_stored, max_inflated).where("refused is null").select(_bare("path").alias("file_key"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    own = lines.join(keep, _bare("file") == F.col("file_key"), "left_semi")
    place = F.row_number().over(Window.partitionBy("file").orderBy("_b", "_i")) - 1  # files are bounded by the sizes above
    return own.select(F.regexp_replace(_bare("file"), r"\.zst$", "").alias("path"), place.cast("long").alias("line_no"), "value")


def complete_lines(text: Column) -> Column:
    """The part of a read up to its last line end; empty if no line is complete."""
    return F.regexp_extract(text, r"(?s)^(.*\n)", 1)


def first_cwd(lines: DataFrame, keys: list[str], line_no: str, text: str, start: str, limit: int = HEAD_BYTES) -> DataFrame:
    """(keys, cwd): the first working folder named in the first ``limit`` bytes of each transcript, at the top level or in
    the payload. Lines that are no JSON name none; a line that ends behind the limit does not count."""
    v = F.try_parse_json(F.col(text))
    cwd = F.coalesce(F.try_variant_get(v, "$.cwd", "string"), F.try_variant_get(v, "$.payload.cwd", "string"))
    head = lines.where(F.col(start) + F.octet_length(text) <= limit).select(*keys, line_no, F.nullif(cwd, F.lit("")).alias("cwd")).where("cwd is not null")
    return head.groupBy(*keys).agg(F.min_by("cwd", line_no).alias("cwd"))


# The notes of what is left out.
CUT_END, CUT_MIDDLE, CUT_UNIT = "…〔後略 ", "\n…〔中略 ", " 字元〕"


def clip(text: Column, limit: int) -> Column:
    """Trimmed, cut at the limit with a note of how much is missing."""
    t = F.trim(text)
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(CUT_END), F.char_length(t) - limit, F.lit(CUT_UNIT))).otherwise(t)


def clip_middle(text: Column, limit: int) -> Column:
    """Trimmed, the middle left out: conclusions tend to stand at the end."""
    t, half = F.trim(text), limit // 2
    return F.when(
        F.char_length(t) > limit, F.concat(F.substring(t, 1, half), F.lit(CUT_MIDDLE), F.char_length(t) - limit, F.lit(CUT_UNIT + "…\n"), F.right(t, F.lit(half)))
    ).otherwise(t)


# Longest shown text, arguments and results of tools, and the marks of what is not text.
TEXT_CHARS, INPUT_CHARS, RESULT_CHARS = 8000, 300, 600
IMAGE, REFERENCE, SUMMARY_ROLE, FAILED = "[圖片]", "[工具參照 ", "對話摘要", " 錯誤"


def _flat(doc: object) -> str:
    """The text of content blocks nested to any depth, walked with a stack: texts in order, one a line."""
    out, todo = [], [doc]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict) and v.get("type") == "image":
            out.append(IMAGE)
        elif isinstance(v, dict) and v.get("type") == "tool_reference":
            out.append(f"{REFERENCE}{v.get('tool_name', '')}]")
        elif isinstance(v, dict) and isinstance(v.get("text"), str):
            out.append(v["text"])
        elif isinstance(v, dict) and "content" in v:
            todo.append(v["content"])
        elif isinstance(v, dict):
            out.append(json.dumps(v, ensure_ascii=False)[:RESULT_CHARS])
        elif v is not None:
            out.append(v if isinstance(v, str) else str(v))
    return "\n".join(x for x in out if x)


def flatten(doc: Column) -> Column:
    """The text of a JSON content of any depth; a text that is no JSON is its own. Only nested contents leave the JVM."""

    @F.pandas_udf("string")
    def flat(s: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else _flat(json.loads(v))
            except ValueError:
                return v

        return s.map(one)

    return F.when(doc.rlike(r"^\s*[\[{\"]"), flat(doc)).otherwise(doc)


def render(lines: DataFrame, text: str, line_no: str) -> DataFrame:
    """The turns of a transcript as text, one row a content block: the columns of ``lines``, part (its place) and shown.
    Messages of user and assistant, uses and results of tools and images are shown under a head with line and time;
    thinking, meta lines and all else is not."""
    schema = "type string, timestamp string, isMeta boolean, isCompactSummary boolean, message struct<content:string>"
    block = "array<struct<type:string,text:string,name:string,input:string,content:string,is_error:boolean>>"
    d = lines.withColumn("_v", F.from_json(text, schema)).where("_v.type in ('user', 'assistant') and not coalesce(_v.isMeta, false)")
    content = F.col("_v.message.content")
    blocks = F.when(content.rlike(r"^\s*\["), F.from_json(content, block)).otherwise(
        F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "content")], F.lit(None).cast("boolean").alias("is_error")))
    )
    d = d.select(*lines.columns, "_v", F.posexplode(blocks).alias("part", "_b"))
    at = F.coalesce("_v.timestamp", F.lit(""))
    time = F.when(at.endswith("Z"), F.concat(F.substring(at, 1, 19), F.lit("Z"))).otherwise(F.substring(at, 1, 25))
    head = lambda label: F.concat(F.rtrim(F.concat(F.lit("[L"), F.col(line_no).cast("string"), F.lit(" "), time)), F.lit(" "), label, F.lit("] "))
    role = F.when(F.col("_v.isCompactSummary"), SUMMARY_ROLE).otherwise(F.col("_v.type"))
    kind, b = F.coalesce("_b.type", F.lit("")), lambda c: F.coalesce(f"_b.{c}", F.lit(""))
    safe = neutralise_transcript
    failed = F.when(F.col("_b.is_error"), FAILED).otherwise("")
    shown = (
        F.when((kind == "text") & (F.trim(b("text")) != ""), F.concat(head(role), safe(clip_middle(b("text"), TEXT_CHARS))))
        .when(kind.isin("tool_use", "server_tool_use"), F.concat(head(F.lit("tool_use")), safe(F.coalesce("_b.name", F.lit("?"))), F.lit(" "), safe(clip(F.coalesce("_b.input", F.lit("{}")), INPUT_CHARS))))
        .when(kind.endswith("tool_result"), F.concat(head(F.concat(F.lit("tool_result"), failed)), safe(clip(flatten(b("content")), RESULT_CHARS))))
        .when(kind == "image", F.concat(head(role), F.lit(IMAGE)))
    )
    return d.withColumn("shown", shown).where("shown is not null").drop("_v", "_b")


def readable_lines(lines: DataFrame, text: str, limit: int = 2000) -> DataFrame:
    """The turns of user and assistant as text: adds role and shown. String contents stand as they are, of content blocks
    the texts are joined, tools and images leave a mark; thinking and meta lines are dropped."""
    v = F.try_parse_json(F.col(text))
    s = lambda path: F.try_variant_get(v, path, "string")
    block = "array<struct<type:string,text:string,name:string,thinking:string>>"
    d = lines.select("*", F.coalesce(s("$.type"), s("$.role")).alias("role"), F.coalesce(s("$.isMeta"), F.lit("false")).alias("_meta"), s("$.message.content").alias("_s"), s("$.text").alias("_t"))
    d = d.withColumn("_b", F.from_json("_s", block))
    shown = F.when(
        F.col("_s").startswith("["),
        F.array_join(
            F.filter(
                F.transform("_b", lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool "), F.coalesce(b["name"], F.lit("")), F.lit("]"))).when(b["type"] == "image", F.lit("[image]"))),
                lambda x: x.isNotNull(),
            ),
            "\n",
        ),
    ).otherwise(F.coalesce("_s", "_t"))
    d = d.withColumn("shown", clip(shown, limit)).where(F.col("role").isin("user", "assistant") & (F.col("_meta") != "true") & (F.col("shown") != ""))
    return d.drop("_meta", "_s", "_t", "_b")
