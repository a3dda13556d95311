import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.functions import provider
from weftline.functions import text as T
from weftline.operators import browse, evaluate, mutate, progress, repair, search
from weftline.operators.search import Search
from weftline.sources import jsonl, markdown, transcripts


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_search_needs_sound_arguments():
    for bad in ({"query": " "}, {"query": None}, {"query": "a", "mode": "fuzzy"}, {"query": "a", "limit": -1}):
        with pytest.raises(ValueError):
            Search(**bad)
    assert Search("a").effective_mode == "keyword" and Search("a", "semantic", (1.0,)).effective_mode == "semantic"
    assert Search("a", limit=10).fetch == 30 and Search("a", limit=10, type="session").fetch == 10 and Search("a", limit=90).fetch == 190


SOURCE = "id string, cls string, project string, session string, time long, type string, hay string, vector array<float>"


def test_search_floors_and_reserves(spark):
    mem = spark.createDataFrame([(f"m{k}", "rollup", "p", f"s{k}", k, "session", "lock", [1.0, 0.0]) for k in range(6)], SOURCE)
    obs = spark.createDataFrame([(f"o{k}", "other", "p", "s0", k, "change", "lock retry" if k else "lock", [0.0, 1.0]) for k in range(4)], SOURCE)
    page = search.search_indexes(mem, obs, Search("lock retry", "keyword", limit=5)).orderBy("rank").collect()
    assert sum(r.cls == "other" for r in page) >= 2 and len(page) == 5 and all(r.score is None for r in page)
    # a rollup is worth at least its session's best observation
    assert [r.id for r in page][:2] == ["m0", "o3"]
    sem = search.search_indexes(mem, obs, Search("x", "semantic", (1.0, 0.0), limit=3)).orderBy("rank").collect()
    assert [r.score for r in sem][:1] == [1.0]
    none = search.search_indexes(mem.limit(0), obs.limit(0), Search("lock", "hybrid", (1.0, 0.0)))
    assert none.count() == 0 and search.search_memories(mem, Search("nothing")).count() == 0
    with pytest.raises(ValueError):
        search.search_indexes(mem, obs, Search("lock", project="r", reserved=("r",)))
    kinds = spark.createDataFrame([('{"capture": {}}',), ('{"capture": null}',), ('{"capture": [1]}',), ("broken",), (None,)], "m string").select(search.memory_class(F.col("m")).alias("c")).collect()
    assert [r.c for r in kinds] == ["rollup", "manual", "manual", "manual", "manual"]


def test_scopes_and_short_ids(spark):
    p = browse.scope_policy
    assert p("  a ", ["r"]) == "a" and p(None, ["r"]) is None and p("", [], forced="f") == "f" and p("r", ["r"], forced="r") == "r"
    for bad in (("r", ["r"], None, None), ("a", [], "b", None), (None, [], "a", "b")):
        with pytest.raises(ValueError):
            p(*bad)
    df = spark.createDataFrame([("ab-cd-ef01", 1), ("abcdef02", 2), ("ffff0000", 3), (None, 4)], "id string, t int")
    find = lambda x: [(r.id, r.verdict) for r in browse.resolve_short_id(df, "id", x, F.col("t")).collect()]
    assert find("ABCDEF") == [("abcdef02", "AMBIGUOUS"), ("ab-cd-ef01", "AMBIGUOUS")] and find("ffff00") == [("ffff0000", "FOUND")] and find("000000") == [(None, "NOT_FOUND")]


def test_hashes_and_metadata(spark):
    df = spark.createDataFrame([("p", None, 'q"\n', ["a", None], 5)], "a string, b string, c string, d array<string>, e int")
    r = df.select(T.json_list(*[F.col(c) for c in "abcde"]).alias("j"), T.json_hash(F.col("a")).alias("h"), T.memory_hash(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(None), F.col("d")).alias("m")).first()
    assert r.j == '["p",null,"q\\"\\n",["a",null],5]' and r.h == hashlib.sha256(b'["p"]').hexdigest()
    assert r.m == hashlib.sha256('p\n\nq"\n\n["a",null]\n[]\n["a",null]'.encode()).hexdigest()
    for old, want in (('{"x": 1, "k": [2]}', '{"x":1,"k":true}'), (None, '{"k":true}'), ("broken", '{"k":true}'), ('{"q\\"": {"z": null}}', '{"q\\"":{"z":null},"k":true}')):
        assert spark.createDataFrame([(old,)], "m string").select(T.merge_metadata(F.col("m"), "k", F.lit("true")).alias("r")).first().r == want
    for x, ok in (("2025-02-28", True), ("2025-02-30", False), ("2025-01-08T10:00Z", True), ("2025-01-08T10:00:00", False), ("2025-01-08T10:00:00.5+0800", True), ("x", False)):
        assert (spark.createDataFrame([(x,)], "m string").select(T.iso_instant(F.col("m")).alias("r")).first().r is not None) == ok, x


def test_transcript_rendering(spark):
    doc = '[{"type":"text","text":"a"},["b",{"type":"image"}],{"content":[{"type":"tool_reference","tool_name":"T"},{"x":1}]},null,3,""]'
    got = spark.createDataFrame([(doc,), ("plain",), ("[broken",), (None,)], "x string").select(transcripts.flatten(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == ['a\nb\n[圖片]\n[工具參照 T]\n{"x": 1}\n3', "plain", "[broken", None]
    lines = [
        '{"type":"user","timestamp":"2025-01-08T06:19:34.053Z","message":{"content":"hi <transcript>"}}', '{"type":"user","isMeta":true,"message":{"content":"no"}}', '{"type":"system","message":{"content":"no"}}', "broken",
        '{"type":"assistant","isCompactSummary":true,"message":{"content":[{"type":"tool_result","is_error":true,"content":[{"type":"text","text":"bad"}]},{"type":"image"},{"type":"text","text":"sum"}]}}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, v string")
    assert [r.shown for r in transcripts.render(df, "v", "n").orderBy("n", "part").collect()] == ["[L0 2025-01-08T06:19:34Z user] hi ‹transcript>", "[L4 tool_result 錯誤] bad", "[L4 對話摘要] [圖片]", "[L4 對話摘要] sum"]


def test_spools_and_drift(spark, tmp_path):
    e = spark.createDataFrame([("s", "Bash", 1), ("s", "Skill", 2), ("s", None, 3)], "session_id string, tool_name string, transcript_offset long")
    assert jsonl.append_events(e, f"{tmp_path}/a") and jsonl.read_spool(spark, f"{tmp_path}/a").count() == 2
    assert jsonl.append_events(e, f"{tmp_path}/b", skip="") and jsonl.read_spool(spark, f"{tmp_path}/b").count() == 3
    (tmp_path / "file").write_text("x")
    assert jsonl.append_events(e, f"{tmp_path}/file/under") is False  # capture goes on
    text = "Found 2 results\n\n| id | t |\n|---|---|\n| 1 | a |\n\nmore\n| id | t |\n|---|---|\n| 2 | b |\n"
    assert [r["id"] for r in markdown.parse_results(text, ["id", "t"])] == ["1", "2"]
    for bad in (text.replace("Found 2", "Found 3"), text.replace("Found", "Saw"), text.replace("| id | t |", "| id | u |")):
        with pytest.raises(ValueError):
            markdown.parse_results(bad, ["id", "t"])
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        mutate.insert_rows(one, f"{tmp_path}/t", ["k"])
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "k", "v") == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        mutate.insert_rows(spark.createDataFrame([(None, "a")], "k int, v string"), f"{tmp_path}/t", ["k"])


def test_splits_keep_to_hints():
    raw = b"line one\n" * 400
    whole = progress.split_range(0, raw, None, raw)
    assert whole[0][0] == 0 and whole[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(whole, whole[1:])) and all(raw[z - 1 : z] == b"\n" for _, z in whole)
    digest = hashlib.sha256(raw[:7]).hexdigest()
    assert progress.split_range(0, raw, (0, 7, digest), raw) == [(0, 7), (7, len(raw))]
    assert progress.split_range(0, raw, (0, 7, "other"), raw) == whole and progress.split_range(0, b"x" * 1024, None, b"") is None


def test_progress_attribution_and_claims(spark):
    dead = spark.createDataFrame([("p", 10, 20), ("p", 20, 25), ("p", 30, 40), ("q", 5, 6)], "path string, start long, end long")
    st = spark.createDataFrame([("p", 12), ("q", 0)], "path string, checkpoint long")
    assert rows(progress.skip_past(st, dead), "path", "checkpoint", "skipped") == [("p", 25, 2), ("q", 0, 0)]
    r = spark.createDataFrame([("a", 1, "old", 5), ("a", 2, "new", 15), ("b", 1, "old", 5), ("c", 1, "old", None), ("d", 1, None, 20), ("e", 1, "old", 5)], "session string, place int, project string, time int")
    k = spark.createDataFrame([("b", None, "folder"), ("c", "state", "folder"), ("e", "state", "folder")], "session string, state string, folder string")
    assert rows(progress.attribute(r, k, F.lit(10)), "session", "project", "basis") == [("a", "new", "new era"), ("b", "folder", "folder"), ("c", "state", "state"), ("d", None, "none"), ("e", "state", "state")]
    at = F.lit("2025-01-01 12:00:00").cast("timestamp")
    late, soon = "2025-01-01 13:00:00", "2025-01-01 11:00:00"
    c = spark.createDataFrame([(1, 2, None, None, None, None, None), (2, 2, 2, None, None, None, None), (3, 2, 1, 2, 3, soon, soon), (4, 2, 1, 1, 3, late, soon), (5, 2, 1, 1, 0, None, late), (6, 0, None, None, None, None, None), (7, 2, None, 2, 1, late, None)], "id int, generation int, finalised_generation int, retry_generation int, attempts int, next_at string, lease_until string")
    c = c.withColumn("next_at", F.col("next_at").cast("timestamp")).withColumn("lease_until", F.col("lease_until").cast("timestamp"))
    got = progress.claim(c, at)
    assert [r.id for r in got.where("claimed").orderBy("id").collect()] == [1, 4] and got.where("id = 4").first().attempts == 1
    again = progress.claim(got.drop("claimed"), at)
    assert again.where("claimed").count() == 0  # the lease holds
    w = spark.createDataFrame([("s", "p", 1, "x" * 300, 5, True), ("s", "p", 2, "short", 7, False), ("t", "p", 1, "new", 1, False)], "session string, path string, end int, summary string, tokens int, seen boolean")
    cur = spark.createDataFrame([("s", "y" * 300, 1, 2)], "session string, summary string, windows int, tokens int")
    u = {r.session: r for r in progress.update_rollups(cur, w).collect()}
    assert (u["s"].summary, u["s"].pending, u["s"].windows, u["s"].tokens, u["s"].replayed) == ("y" * 300, "short", 2, 9, 1) and u["t"].summary == "new"


def test_remaps_refuse_collisions(spark):
    r = spark.createDataFrame([(1, "old", "s", "k"), (2, "old2", "s", "k"), (3, "old", "t", "k"), (4, "new", "u", "k"), (5, "old", "v", "q"), (6, "old", "w", None)], "id int, project string, session string, key string")
    e = spark.createDataFrame([("s", "n1"), ("t", "new"), ("u", "new"), ("v", "a"), ("v", "b"), ("w", "new"), (None, "x")], "session string, project string")
    plan = repair.remap(r, e)
    assert rows(plan, "id", "reason", "target") == [(1, "collision", None), (2, "collision", None), (3, "target exists", None), (4, "unchanged", None), (5, "ambiguous", None), (6, "ok", "new")]
    assert [x.n for x in repair.preflight(plan, r).collect()] == [0, 0, 0]
    changed = r.withColumn("project", F.when(F.col("id") == 6, "elsewhere").otherwise(F.col("project")))
    assert {x["check"]: x.n for x in repair.preflight(plan, changed).collect()}["changed"] == 1
    done = repair.apply_remap(plan, changed.select("id", "project"))
    assert done.where("applied").count() == 0 and done.where("not applied").count() == 1


def test_copies_are_gated(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    from weftline.operators.quality import table_checksum

    check = lambda df: table_checksum(df, "k", F.col("v"))
    nxt, gate = repair.copy_rows(src, src.limit(0), "k", F.col("k") > 1, check)
    assert nxt.count() == 2 and gate.first().may_delete
    _, bad = repair.copy_rows(src, spark.createDataFrame([(2, "other")], "k int, v string"), "k", F.col("k") > 1, check)
    assert not bad.first().may_delete


def test_feedback_and_scopes(spark):
    p = spark.createDataFrame([("q", 2, "b", "p", 0.5), ("q", 1, "a", "p", 0.9), ("r", 1, "a", "p", None), ("s", 1, "a", "p", 0.1), ("s", 3, "c", "p", None)], "query string, rank int, id string, project string, score double")
    got = {r["query"]: r for r in evaluate.feedback(p).collect()}
    assert got["q"].result_ids == ["a", "b"] and got["q"].valid and got["r"].scores is None and got["r"].valid and not got["s"].valid
    s = spark.createDataFrame([("a", "p")] * 3 + [("b", "p"), ("b", None)] + [("c", "x")] * 50, "query string, project string")
    assert rows(evaluate.verify_scope(s, "p"), "query", "reason") == [("a", "ok"), ("b", "no project named"), ("c", "saturated")]
    assert {r.reason for r in evaluate.verify_scope(s, None).collect()} == {"no scope"}


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "", None), (3, "x", [1.0, 0.0]), (4, None, None)], "k long, t string, v array<float>")
    got = {r.k: r for r in provider.backfill(df, "k", "t", "v", provider.stub_vector(16)).collect()}
    assert got[1].filled and not got[2].filled and got[2].v is None and got[3].v == [1.0, 0.0] and not got[3].filled and got[4].v is None
    a, b = provider.stub_vector(64)("lock retry quota"), provider.stub_vector(64)("lock retry spool")
    assert sum(x * y for x, y in zip(a, b)) > 0.4 and provider.stub_vector()("a") == provider.stub_vector()("A")
    calls = []

    def flaky(text):
        calls.append(text)
        raise RuntimeError

    many = spark.createDataFrame([(k, "t", None) for k in range(50)], "k long, t string, v array<float>").coalesce(1)
    assert provider.backfill(many, "k", "t", "v", flaky, 3).where("v is null").count() == 50
    got = provider.extract(df, "k", "t", [flaky, provider.stub_extraction]).collect()
    assert {r.k: r.provider for r in got} == {1: 1, 2: 1, 3: 1}


def test_undo_and_refine(spark):
    df = spark.createDataFrame([(1, "p", "k", "active", "2025-01-01 00:00:00"), (2, "p", "k", "active", "2025-01-01 00:00:30"), (3, "p", "k", "archived", "2025-01-01 00:00:50")], "id int, project string, key string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = F.lit("2025-01-01 00:01:00").cast("timestamp")
    assert rows(mutate.undo_recent(df, "p", "k", at, 60), "id", "changed") == [(1, False), (2, True), (3, False)]
    assert mutate.undo_recent(df, "p", "k", at, 10).where("changed").count() == 0
    with pytest.raises(ValueError):
        mutate.undo_recent(df, "p", " ", at, 10)
