import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.llm.mixing import mix, mix_report, plan_mix
from weftline.llm.packing import best_fit, duplicate_cluster, pack, pack_report
from weftline.llm.tokens import encoding, with_token_counts, DEFAULT_VOCABULARY


def test_best_fit_respects_capacity_and_conflicts():
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 60) for _ in range(400)), reverse=True)
    clusters = [rnd.choice([None, *range(40)]) for _ in sizes]
    sources = [rnd.choice("abc") for _ in sizes]
    box = best_fit(sizes, sources, clusters, 100, frozenset("c"))
    load, held, srcs = Counter(), Counter(), Counter()
    for b, s, c, src in zip(box, sizes, clusters, sources):
        load[b] += s
        held[b, c] += c is not None
        srcs[b] += src == "c"
    assert max(load.values()) <= 100 and max(held.values()) <= 1 and max(srcs.values()) <= 1
    free = best_fit(sizes, sources, [None] * len(sizes), 100)
    assert len(set(free)) <= 1.03 * sum(sizes) / 100 + 1
    # more copies than containers: they are spread evenly and waste nothing
    assert len(set(best_fit([10] * 100, ["a"] * 100, [7] * 100, 100))) == 10


def test_sources_are_spread_over_the_containers():
    rnd = random.Random(3)
    sizes = sorted((int(rnd.lognormvariate(2.5, 1)) % 100 + 1 for _ in range(6000)), reverse=True)
    sources = [rnd.choice([*"aaabbcdefg", None]) for _ in sizes]
    fewest, n = -(-sum(sizes) // 200), Counter(sources)

    def beyond(spread):
        box = best_fit(sizes, sources, [None] * len(sizes), 200, spread=spread)
        load, held = Counter(), Counter()
        for b, s, src in zip(box, sizes, sources):
            load[b] += s
            held[b, src] += src is not None
        assert max(load.values()) <= 200 and len(load) <= 1.03 * fewest
        return sum(max(0, k - max(1, -(-1.5 * n[src] // fewest))) for (_, src), k in held.items() if src)

    assert beyond(1.5) < 0.8 * beyond(None)
    # a source that stands apart stays so, whatever it costs
    box = best_fit([10] * 30, ["x"] * 10 + ["y"] * 20, [None] * 30, 100, frozenset("x"), spread=2.0)
    assert len(set(box[:10])) == 10


ITEMS = "doc_id long, source string, cluster long, n_tokens long, capacity int, size int"


def test_pack_table(spark):
    rows = [(k, "s", None, n, 1, 1) for k, n in enumerate([5, 120, 100, 0, None, 60, 40, 250, 99, 1])] + [(None, None, None, 7, 1, 1), (5, "s", None, 60, 1, 1)]
    caps = spark.createDataFrame([("a", 100), ("b", 30), ("x", None), ("y", 0), (None, 9)], "pack_name string, capacity_tokens int")
    got = pack(spark.createDataFrame(rows, ITEMS), caps).collect()
    assert {r.pack_name for r in got} == {"a", "b"}
    for name, cap in (("a", 100), ("b", 30)):
        load, tokens, spans = Counter(), Counter(), defaultdict(list)
        for r in got:
            if r.pack_name == name:
                if r.container_id is not None:
                    load[r.container_id] += r.end_token - r.start_token
                tokens[r.doc_id] += r.end_token - r.start_token
                spans[r.doc_id].append((r.start_token, r.end_token))
        assert max(load.values()) <= cap
        want = Counter()
        for k, _, _, n, *_ in rows:
            want[k] += n or 0
        assert tokens == want
        assert all(len(v) == 1 or tokens[k] > cap or k == 5 for k, v in spans.items())  # divided only if larger
        assert sorted(spans[1]) == [(a, min(a + cap, 120)) for a in range(0, 120, cap)]
    zero = [r for r in got if r.doc_id in (3, 4)]
    assert all(r.container_id is None for r in zero) and len(zero) == 4
    assert pack(spark.createDataFrame([], ITEMS), caps).count() == 0
    report = {r.pack_name: r for r in pack_report(spark.createDataFrame(got), caps).collect()}
    assert 0.5 < report["a"].fill <= 1


def test_shards_are_bounded_and_containers_distinct(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit(None).cast("long").alias("cluster"), (F.col("id") % 90 + 1).alias("n_tokens"))
    caps = spark.createDataFrame([("a", 100)], "pack_name string, capacity_tokens int")
    got = pack(df, caps, shard_tokens=20_000)
    load = got.groupBy("container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n"))
    assert got.count() == 3000 and load.agg(F.max("n")).first()[0] <= 100
    assert pack_report(got, caps).first().fill > 0.97


def test_clusters_and_tokens(spark):
    df = spark.createDataFrame([(1, "Same  text\nhere"), (2, "same text here"), (3, "other"), (4, ""), (5, None), (6, " \n"), (7, "<|endoftext|> é資料")], "doc_id long, text string")
    c = {r.doc_id: r.c for r in df.select("doc_id", duplicate_cluster(F.col("text")).alias("c")).collect()}
    assert c[1] == c[2] != c[3] and c[4] is None and c[5] is None and c[6] is None
    n = {r.doc_id: r.n_tokens for r in with_token_counts(df, "text", ["doc_id"]).collect()}
    enc = encoding(DEFAULT_VOCABULARY)
    assert n == {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in df.collect()} and n[4] == n[5] == 0
    assert enc.decode(enc.encode_ordinary("<|endoftext|> é資料")) == "<|endoftext|> é資料"


DOCS = "doc_id long, source string, n_tokens long, weight double, key int, epochs int"


def test_mix_meets_budgets(spark):
    rnd = random.Random(2)
    docs = [(k, s, rnd.randint(1, 50), rnd.choice([None, 0.0, 0.5, 0.9]), 1, 1) for k, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["small"] * 20)]
    docs += [(None, "big", 5, 1.0, 1, 1), (9001, None, 5, 1.0, 1, 1), (9002, "big", 0, 1.0, 1, 1), (9003, "other", 5, 1.0, 1, 1)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 5), ("gone", 0.2, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix(df, targets).collect()
    assert {r.source for r in got} == {"big", "mid", "small"}
    have, used = Counter(), Counter()
    for d in docs:
        if d[0] is not None and d[2]:
            have[d[1]] += d[2]
    for r in got:
        used[r.source] += r.repeats * r.n_tokens
    total = min(have[s] * m / w for s, w, m in (("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 5)))
    for s, w, m in (("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 5)):
        assert w * total - 50 <= used[s] <= w * total + 1
        assert all(1 <= r.repeats <= m for r in got if r.source == s)
        reps = {r.repeats for r in got if r.source == s}
        assert max(reps) - min(reps) <= 1  # whole epochs come first
    again = mix(df.repartition(3), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    rep = {r.source: r for r in mix_report(mix(df, targets), df, targets).collect()}
    assert rep["gone"].actual_share == 0 and abs(rep["big"].actual_share - 0.6) < 0.03
    assert mix(df, targets, total_tokens=100).agg(F.sum("n_tokens")).first()[0] <= 100


def test_heavier_documents_are_chosen_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_tokens"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.3).alias("weight"))
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = Counter(r.doc_id % 2 for r in mix(df, t, total_tokens=1000).collect())
    assert n[0] + n[1] == 1000 and 2.0 < n[0] / n[1] < 4.0


def test_weights_of_any_scale_count(spark):
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    base = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_tokens"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))
    chosen = [sorted(r.doc_id for r in mix(base.withColumn("weight", F.col("weight") * scale), t, total_tokens=1000).collect()) for scale in (1.0, 2.0**-14, 2.0**20)]
    assert chosen[0] == chosen[1] == chosen[2] and 2.0 < sum(x % 2 == 0 for x in chosen[0]) / sum(x % 2 for x in chosen[0]) < 4.5
    odd = base.withColumn("weight", F.when(F.col("doc_id") % 4 == 0, float("nan")).when(F.col("doc_id") % 4 == 1, float("inf")).when(F.col("doc_id") % 4 == 2, -1.0))
    n = Counter(r.doc_id % 4 for r in mix(odd, t, total_tokens=1500).collect())
    assert n[1] == 1000 and sum(n.values()) == 1500


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], DOCS)
    assert mix(empty, t).count() == 0 and mix(empty, t.limit(0)).count() == 0
    assert plan_mix(empty, t).first().budget == 0
