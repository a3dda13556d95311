import json
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.operators import state
from weftline.sources import jsonl, markdown, paged, transcripts


def test_transcripts_plain_and_compressed(spark, tmp_path):
    a = "\n".join(json.dumps({"type": t, "cwd": c, "message": {"role": t, "content": m}}) for t, c, m in (("system", None, "x"), ("user", "/w", "hello"), ("assistant", "/z", [{"type": "text", "text": "t1"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_use", "name": "Bash"}]))) + "\n"
    Path(tmp_path, "a.jsonl").write_text(a)
    Path(tmp_path, "a.jsonl.zst").write_bytes(zstandard.compress(b'{"stale": 1}\n'))
    Path(tmp_path, "b.jsonl.zst").write_bytes(zstandard.compress(b'{"payload": {"cwd": "/p"}}\nbroken\n'))
    Path(tmp_path, "big.jsonl").write_text("x" * 5000)
    df = transcripts.read_transcripts(spark, str(tmp_path), max_stored=4000)
    got = {k: [r.value for r in sorted(v, key=lambda r: r.line_no)] for k, v in _by(df.collect(), "path").items()}
    assert {k.rsplit("/", 1)[1]: len(v) for k, v in got.items()} == {"a.jsonl": 3, "b.jsonl": 2}
    assert sorted(r.line_no for r in df.collect() if r.path.endswith("a.jsonl")) == [0, 1, 2]
    Path(tmp_path, "damaged.jsonl.zst").write_bytes(b"no zstd at all")
    Path(tmp_path, "bomb.jsonl.zst").write_bytes(zstandard.compress(b"0" * 100_000))
    refused = {r.path.rsplit("/", 1)[1]: r.reason for r in transcripts.refused_transcripts(spark, str(tmp_path), 4000, 50_000).collect()}
    assert refused == {"big.jsonl": "stored size", "damaged.jsonl.zst": "not readable", "bomb.jsonl.zst": "inflated size"}
    off = jsonl.with_offsets(df, ["path"], "line_no", "value")
    cwd = {r.path.rsplit("/", 1)[1]: r.cwd for r in transcripts.first_cwd(off, ["path"], "line_no", "value", "start").collect()}
    assert cwd == {"a.jsonl": "/w", "b.jsonl": "/p"}
    assert transcripts.first_cwd(off, ["path"], "line_no", "value", "start", limit=10).count() == 0
    shown = [(r.role, r.shown) for r in transcripts.readable_lines(df, "value").orderBy("line_no").collect()]
    assert shown == [("user", "hello"), ("assistant", "t1\n[tool Bash]")]


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_clips_and_complete_lines(spark):
    r = spark.createDataFrame([(" abcdefghij ",)], "x string").select(transcripts.clip(F.col("x"), 4).alias("a"), transcripts.clip_middle(F.col("x"), 4).alias("b"), transcripts.clip(F.col("x"), 10).alias("c")).first()
    assert r.a == "abcd…〔後略 6 字元〕" and r.b == "ab\n…〔中略 6 字元〕…\nij" and r.c == "abcdefghij"
    got = spark.createDataFrame([("a\nb\npart",), ("part",), ("",), (None,)], "x string").select(transcripts.complete_lines(F.col("x")).alias("r")).collect()
    assert [x.r for x in got] == ["a\nb\n", "", "", None]


def test_pages_and_deltas(spark):
    def fetch(cursor, n):
        at = int(cursor or 0)
        return [{"id": str(k), "tags": [k]} for k in range(at, min(at + n, 450))], str(at + n) if at + n < 450 else None

    assert len(list(paged.all_pages(fetch))) == 450 and len(list(paged.all_pages(fetch, cap=300))) == 450
    rows, cursor = paged.read_some(fetch, cap=300)
    more, end = paged.read_some(fetch, cursor, cap=300)
    assert len(rows) == 300 and [r["id"] for r in rows + more] == [str(k) for k in range(450)] and end is None
    assert len(list(paged.all_pages(lambda c, n: ([{"id": 1}], "same"), cap=1000))) == 2
    assert len(list(paged.all_pages(lambda c, n: ([{"id": 1}], "same"), cap=1))) == 2
    df = paged.read_paged(spark, "pages_for_test", "id string, tags string", fetch)
    assert df.count() == 450 and df.where("id = '7'").first().tags == "[7]"
    assert paged.delta(lambda t: ([t], "n1"), None) == (["*"], "n1", True)
    assert paged.delta(lambda t: ([t], "n2"), "n1") == (["n1"], "n2", False)


def test_markdown_tables(spark):
    text = "# t\n\n| a | b |\n|---|:--|\n| 1 | x \\| y |\n| 2 |  |\n"
    df = markdown.read_table(spark, text, ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [("1", "x | y"), ("2", "")]
    assert markdown.parse_table(markdown.to_markdown(df)) == markdown.parse_table(text)
    assert markdown.parse_table("no table") == []
    with pytest.raises(ValueError):
        markdown.parse_table("| a |\n|---|\n| 1 | 2 |")
    with pytest.raises(ValueError):
        markdown.to_markdown(spark.range(300))


def test_first_sighting_captures_nothing(spark):
    s = spark.createDataFrame([("a", 10), ("b", 50)], "path string, checkpoint long")
    b = spark.createDataFrame([("a", 5), ("a", 30), ("b", 50), ("c", 70), (None, 3), ("d", None)], "path string, boundary long")
    got = sorted(tuple(r) for r in state.advance_checkpoints(s, b).collect())
    assert got == [("a", 10, 30, False), ("c", 70, 70, True)]


def test_holds_and_finalising(spark):
    df = spark.sql("select * from values (0, timestamp'2025-01-01 00:00:00'), (1, timestamp'2025-01-01 00:50:00'), (2, timestamp'2025-01-01 00:10:00'), (1, timestamp'2025-01-01 02:00:00'), (1, null) as t(n, at)")
    now = F.lit("2025-01-01 01:00:00").cast("timestamp")
    assert [r.h for r in df.select(state.held(F.col("n"), F.col("at"), now).alias("h")).collect()] == [False, True, False, False, False]
    s = spark.sql("""select * from values ('a', 0L, true, false, timestamp'2025-01-01 00:59:00'), ('b', 0L, false, false, timestamp'2025-01-01 00:59:00'), ('c', 1L, true, true, timestamp'2020-01-01 00:00:00'),
    ('d', null, null, null, timestamp'2024-12-31 19:00:00'), ('e', 0L, false, true, timestamp'2025-01-01 00:59:00'), ('f', 0L, null, null, null) as t(session, pending, closed, backfill, last_event)""")
    assert sorted(r.session for r in state.finalise_due(s, now).collect()) == ["a", "d", "e"]


def test_dead_letters_and_cleanup(spark):
    schema = "session string, path string, start long, end long, attempts int"
    f = spark.createDataFrame([("s", "p", 0, 5, 5), ("s", "p", 0, 5, 6), ("s", "p", 5, 9, 4), ("t", "p", 0, 5, 7)], schema)
    new = state.dead_letters(f, spark.createDataFrame([], "content_hash string"))
    assert sorted((r.session, r.attempts) for r in new.collect()) == [("s", 6), ("t", 7)]
    assert state.dead_letters(f, new.select("content_hash")).count() == 0
    left = state.drop_covered(f, spark.createDataFrame([("p", 5), ("q", 99)], "path string, checkpoint long"))
    assert [(r.start, r.end) for r in left.collect()] == [(5, 9)]


def test_fold_rollups(spark):
    schema = "session string, summary string, summarize_count long, discovery_tokens long, observation_ids array<bigint>"
    cur = spark.createDataFrame([("a", "old", 2, 10, [1, 2]), ("k", "kept", 1, 1, None)], schema)
    win = spark.createDataFrame([("a", "w2", 1, 5, [3, 2], 20), ("a", "w1", 1, 4, [4], 10), ("n", "new", 1, 7, [9], 1)], schema + ", end long")
    got = {r.session: tuple(r)[1:] for r in state.fold_rollups(cur, win).collect()}
    assert got == {"a": ("w2", 4, 19, [1, 2, 4, 3]), "k": ("kept", 1, 1, []), "n": ("new", 1, 7, [9])}


def test_extractions_and_metadata(spark):
    texts = ['{"summary": "s", "observations": [{"type": "change", "title": "t"}]}', '{"summary": "s", "observations": [{"type": "odd", "title": "t"}]}', '{"summary": " "}', "no json", None, '{"summary": "s"}']
    got = [r.v for r in spark.createDataFrame([(x,) for x in texts], "x string").select(state.parse_extraction(F.col("x"), ("change", "bugfix")).alias("v")).collect()]
    assert [v.valid for v in got] == [True, False, False, False, False, True] and got[0].fields.observations[0].title == "t" and got[1].fields is None
    metas = ['{"capture": {"session_id": "s", "summarize_count": 3, "observation_ids": ["a"]}}', '{"capture": {"summarize_count": "x", "discovery_tokens": []}}', json.dumps('{"capture": {"session_id": "in"}}'), "{}", None, "broken"]
    m = [r.m for r in spark.createDataFrame([(x,) for x in metas], "x string").select(state.capture_metadata(F.col("x")).alias("m")).collect()]
    assert (m[0].session_id, m[0].summarize_count, m[0].observation_ids) == ("s", 3, ["a"])
    assert (m[1].summarize_count, m[1].discovery_tokens, m[1].present) == (0, 0, True)
    assert m[2].session_id == "in" and [x.present for x in m] == [True, True, True, False, False, False]


def test_verdicts_and_invariants(spark):
    scores = {"good": 2, "fair": 1, "bad": 0}
    g = [(1, 1, "a", "good"), (1, 1, "b", "bad"), (1, 2, "a", "fair"), (1, 2, "b", "bad"), (2, 1, "a", "good"), (2, 1, "b", "bad"), (2, 2, "a", "bad"), (2, 2, "b", "good"), (3, 1, "a", "odd"), (3, 1, "b", "bad"), (3, 2, "a", "bad"), (3, 2, "b", "bad"), (4, 1, "a", "bad"), (4, 1, "b", "bad"), (4, 2, "a", "fair"), (4, 2, "b", "fair")]
    df = spark.createDataFrame(g, "question int, grader int, system string, verdict string")
    got = {r.question: tuple(r)[1:] for r in state.resolve_verdicts(df, scores, ("a", "b")).collect()}
    assert got == {1: ("a", "fair", "bad"), 2: ("undecided", "DISAGREE", "DISAGREE"), 3: ("undecided", "DISAGREE", "bad"), 4: ("tie", "bad", "bad")}
    obs = spark.createDataFrame([("p", "r1"), ("q", "r1"), ("p", "gone"), ("p", None)], "project string, rollup_id string")
    roll = spark.createDataFrame([("r1", "p", "k", "active"), ("r2", "p", "k", "active"), ("r3", "p", "k", "archived"), ("r4", "p", None, "active")], "id string, project string, key string, status string")
    assert {r.rule: r.violations for r in state.invariants(obs, roll).collect()} == {"orphan": 1, "cross_project": 1, "duplicate_key": 1}
    d = spark.createDataFrame([(2, ["a"]), (0, []), (0, ["a"]), (0, None)], "n int, ids array<string>").select(state.drill_down(F.col("n"), F.col("ids")).alias("r"))
    assert [r.r for r in d.collect()] == ["available", "legal-empty", "inconsistent", "inconsistent"]
