import itertools
import random
import re

import numpy as np

from weftline.llm.neardup import _last_partners, _widths, likely, near_duplicate_groups, near_duplicate_pairs, near_duplicates, word_sets

SCHEMA = "obs_id long, title string, narrative string, facts array<string>, n int, sig string"
WORD = re.compile(r"[^\W_]+")


def brute(rows, t):
    sets = {i: frozenset(WORD.findall(" ".join([a or "", b or "", *[x for x in c or [] if x]]).lower())) for i, a, b, c in rows}
    out = set()
    for (i, x), (j, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and len(x & y) >= t * len(x | y) - 1e-12:
            out.add((i, j))
    return out


def fixture(seed=3, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(90)] + ["Ünïcode", "資料", "A1b2"]
    rows, i = [], 0
    for _ in range(n):
        words = rnd.sample(vocab, rnd.randint(1, 40))
        for _ in range(rnd.choice([1, 1, 1, 2, 4])):
            i += 1
            w = list(words)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rnd.shuffle(w)
            k = len(w) // 2
            rows.append((i, " ".join(w[:3]) or None, "-".join(w[3:k]) or None, [" ".join(w[k:]).upper(), None]))
    rows += [(9001, None, None, None), (9002, "", "...", []), (9003, "same words", None, None), (9004, "WORDS, same!", "", [None])]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    links, members = near_duplicates(df, threshold=0.7)
    got = [(r.id_a, r.id_b) for r in near_duplicate_pairs(links, members).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 0.7)
    groups = {r.id: r.group_id for r in near_duplicate_groups(links, members).collect()}
    assert 9001 not in groups and 9002 not in groups and groups[9003] == groups[9004]
    for a, b in got:
        assert groups[a] == groups[b]
    assert all(groups[g] == g for g in groups.values())


def test_long_texts_have_wider_signatures(spark):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for size in (20, 150, 161, 200, 300, 321, 460, 700, 1000, 1400):
        for _ in range(6):
            words = rnd.sample(vocab, size)
            for share in (0.0, 0.05, 0.15, 0.3):  # edits, and cuts that lead to another width
                i += 1
                w = [rnd.choice(vocab) if rnd.random() < share / 2 else x for x in words][: int(size * (1 - share * 0.9)) or 1]
                rows.append((i, " ".join(w), None, None))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    links, members = near_duplicates(df)
    assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(links, members).collect()} == brute(rows, 0.7)
    few = near_duplicates(df, threshold=0.9)
    assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(*few).collect()} == brute(rows, 0.9)
    assert list(_widths(np.array([1, 160, 161, 320, 321, 640, 641]))) == [4, 4, 8, 8, 16, 16, 32]


def test_tiles_and_partners():
    meta = [{"tile": k, "lo": lo, "hi": hi} for k, (lo, hi) in enumerate([(1, 10), (10, 14), (14, 15), (16, 30), (40, 60)])]
    assert _last_partners(meta, 0.7) == [(0, 2), (1, 3), (2, 3), (3, 4), (4, 4)]
    assert _last_partners([], 0.7) == []


def test_an_id_with_several_texts_counts_with_each(spark):
    rows = [(1, "a b c d e f g h i j", None, None), (1, "k l m n o p q r s t", None, None), (2, "a b c d e f g h i j x", None, None), (3, "k l m n o p q r s t y", None, None), (1, "a b c d e f g h i j", None, None)]
    pairs = {(r.id_a, r.id_b) for r in near_duplicate_pairs(*near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))).collect()}
    assert pairs == {(1, 2), (1, 3)}


def test_large_classes_and_their_links_give_all_pairs(spark):
    rnd = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for k in range(1, 81):  # two linked classes of 40 records each, of reordered and repeated words
        w = words if k % 2 else [*words, "lambda"]
        rows.append((k, " ".join(rnd.sample(w, len(w)) + rnd.choices(w, k=k % 3)), None, None))
    rows.append((100, "another text", None, None))
    links, members = near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    got = [(r.id_a, r.id_b) for r in near_duplicate_pairs(links, members).collect()]
    assert len(got) == len(set(got)) == 80 * 79 // 2 and set(got) == brute(rows, 0.7)


def test_empty_and_wordless(spark):
    for rows in ([], [(1, None, None, None, 1, "x"), (None, "a", "b", [], 1, "x")]):
        links, members = near_duplicates(spark.createDataFrame(rows, SCHEMA))
        assert links.count() == 0 and members.count() == 0
        assert near_duplicate_groups(links, members).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(1, "A_b c-D", "d 資料1", ["É", None], 1, "x")], SCHEMA)
    assert sorted(word_sets(df, "obs_id", ["title", "narrative"], ["facts"]).first().words) == sorted(["a", "b", "c", "d", "資料1", "é"])


def test_the_filter_keeps_all_wanted_rows(spark):
    df = spark.range(0, 5000).selectExpr("id * 977 as obs_id", "id as _row")
    wanted = df.where("obs_id % 11 = 0").selectExpr("obs_id as _end")
    got = likely(df, df.obs_id, wanted, "_end")
    ids = {r.obs_id for r in got.collect()}
    assert got.columns == df.columns and {r._end for r in wanted.collect()} <= ids and len(ids) < 500
    assert likely(df, df.obs_id, wanted.limit(0), "_end").count() == 0
