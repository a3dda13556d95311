import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import runs
from weftline.llm.runs import canonical_tool, collapse_runs
from weftline.llm.splitting import split_bytes, split_oversized

EVENTS = "event_id long, session_id string, tool_name string, transcript_offset long, tool string, chunk int, t long"


def model(rows):
    """Plain loop: runs of consecutive equal tools of a session, copies of an offset once."""
    best = {}
    for e, s, tool, off in rows:
        if s is not None and off is not None and tool:
            best[s, off] = min(best.get((s, off), (e, tool)), (e, tool))
    out = []
    for (s, off), (_, tool) in sorted(best.items()):
        if out and out[-1][0] == s and out[-1][1] == tool:
            out[-1][3], out[-1][4] = off, out[-1][4] + 1
        else:
            out.append([s, tool, off, off, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_runs_equal_the_plain_loop(spark, partitions):
    rnd = random.Random(5)
    rows = []
    for e in range(4000):  # one session holds most rows, one tool fills whole chunks
        s = rnd.choice(["hot"] * 8 + ["a", "b", None])
        off = rnd.choice([None] + [rnd.randrange(3000)] * 20)
        tool = "read" if off is not None and 500 < off < 2200 else rnd.choice(["read", "edit", "grep", None])
        rows.append((e, s, tool, off))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*r, "clash", 3, r[0] * 10) for r in [(a, b, c, d) for a, b, c, d in rows]], EVENTS)
        got = collapse_runs(df, time_millis=F.col("t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r.session_id, r.tool, r.first_offset, r.last_offset, r.n_events) for r in got) == model(rows)
    assert all(r.duration_ms >= 0 for r in got)


def test_spellings_of_a_tool(spark):
    same = ["exec_command", "ExecCommand", " exec-command\t", "functions.exec_command", "default_api/exec_command", "EXEC_COMMAND (3)", "exec_command#11"]
    other = ["mcp__notes__search", "mcp__issues__search", "mcp__notes__read", "MCP__NOTES__READ", "", "  "]
    df = spark.createDataFrame([(x,) for x in same + other], "x string").select(canonical_tool(F.col("x")).alias("c"))
    got = [r.c for r in df.collect()]
    assert set(got[: len(same)]) == {"execcommand"}
    assert got[len(same) :] == ["mcp|notes|search", "mcp|issues|search", "mcp|notes|read", "mcp|notes|read", None, None]


def test_runs_of_nothing(spark):
    assert collapse_runs(spark.createDataFrame([], EVENTS)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "s", "read", None, None, None, None)], EVENTS)
    assert collapse_runs(nulls).count() == 0
    one = collapse_runs(spark.createDataFrame([(None, "s", "read", 4, None, None, None)] * 3, EVENTS)).collect()
    assert [(r.n_events, r.duration_ms) for r in one] == [(1, None)]


TEXTS = [
    "One sentence here. Another one there! " * 30,
    "a line\n" * 200,
    "摘要檔案還原了尚未送出的訊息。權限檢查還原了預設上限，速度明顯變快。" * 20,
    "x" * 1000,
    "🧪" * 300,
    "👩‍👩‍👧‍👦" * 40,
    "para one\n\npara two\r\n" * 60,
    "é" * 400,
    " " * 700,
]


@pytest.mark.parametrize("limit,overlap", [(100, 10), (64, 0), (37, 18), (200, 500)])
def test_pieces_cover_and_stay_within_the_limit(limit, overlap):
    for text in TEXTS:
        raw = text.encode()
        parts = split_bytes(raw, limit, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == len(raw)
        for a, z in parts:
            assert 0 < z - a <= limit
            raw[a:z].decode()  # never inside a character
        for (a, b), (c, d) in zip(parts, parts[1:]):
            assert a < c <= b < d
            assert b - c <= min(overlap, limit // 2)


def test_cuts_are_at_natural_boundaries():
    raw = ("alpha beta gamma delta. " * 40).encode()
    assert all(raw[:z].endswith(b". ") for _, z in split_bytes(raw, 200, 0)[:-1])
    raw = ("some words in a line\n" * 40).encode()
    assert all(raw[:z].endswith(b"\n") for _, z in split_bytes(raw, 200, 20)[:-1])
    assert split_bytes(b"short", 10, 2) == [(0, 5)]
    assert split_bytes(b"", 10, 2) == [(0, 0)]


def test_split_oversized_table(spark):
    items = spark.createDataFrame(
        [(1, "p", "word " * 50, 9), (2, "p", "tiny", 9), (3, None, "word " * 50, 9), (4, "q", "word " * 50, 9), (5, "p", None, 9), (6, "p", "", 9), (1, "p", "word " * 50, 9)],
        "chunk_id long, provider string, raw string, max_bytes int",
    )
    limits = spark.createDataFrame([("p", 100, 10), ("p", 120, None), (None, 5, 1)], "provider string, max_bytes int, overlap_bytes int")
    got = split_oversized(items, limits).collect()
    assert {r.chunk_id for r in got} == {1}
    assert len(got) == 2 * got[0].n_pieces
    text = "word " * 50
    assert all(text.encode()[r.start_byte : r.end_byte].decode() == r.text for r in got)
    assert split_oversized(items.limit(0), limits).count() == 0


def test_single_events_and_ignored_rows_stand_as_they_are(spark):
    rows = [("s", 0, "Bash", 7), ("s", 5, "bash #2", 8), ("s", 5, "bash", 3), ("s", 9, "Read", 4), (None, 9, "Read", 5), ("s", None, "Read", 6), ("s", 11, None, 9), ("s", 12, "  ", None), ("s", 20, "Edit", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "session_id string, transcript_offset long, tool_name string, event_id long, tool string")
    got = {tuple(r) for r in runs.collapse_runs(df, firsts=True).collect()}
    assert got == {
        ("s", "bash", 0, 5, 2, None, 7, "Bash"), ("s", "read", 9, 9, 1, None, 4, "Read"), ("s", "edit", 20, 20, 1, None, None, "Edit"),
        (None, None, 9, 9, 1, None, 5, "Read"), ("s", None, None, None, 1, None, 6, "Read"), ("s", None, 11, 11, 1, None, 9, None), ("s", None, 12, 12, 1, None, None, "  "),
    }
    assert runs.collapse_runs(df.limit(0), firsts=True).count() == 0
