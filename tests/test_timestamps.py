import datetime as D
import itertools
import random

import numpy as np
import pytest

from weftline.functions.timeparse import is_normal, with_interpretations
from weftline.operators import timestamps as V
from pyspark.sql import functions as F

ZONES = "writer_host string, zone_id string"
RECORDS = "table_name string, record_id long, time_text string, source string, form string, chunk int"


def utc(*a):
    return int((D.datetime(*a) - D.datetime(1970, 1, 1)).total_seconds() * 1000)


CASES = [
    ("2025-01-08T12:16:24.099Z", utc(2025, 1, 8, 12, 16, 24) + 99), ("2025-01-08t12:16:24.099z", utc(2025, 1, 8, 12, 16, 24) + 99),
    ("  2025-01-08T12:16:24Z\n", utc(2025, 1, 8, 12, 16, 24)), ("2025-01-08T12:16:24.099999999Z", utc(2025, 1, 8, 12, 16, 24) + 99),
    ("2025-01-08T20:16:24+08:00", utc(2025, 1, 8, 12, 16, 24)), ("2025-01-08 07:16:24,5 -0500", utc(2025, 1, 8, 12, 16, 24) + 500),
    ("20250108T121624Z", utc(2025, 1, 8, 12, 16, 24)), ("Wed, 08 Jan 2025 12:16:24 GMT", utc(2025, 1, 8, 12, 16, 24)),
    ("08 Jan 2025 07:16:24 EST", utc(2025, 1, 8, 12, 16, 24)), ("2025-07-08T14:16:24[Europe/Berlin]", utc(2025, 7, 8, 12, 16, 24)),
    ("2025-07-08 20:16:24 Asia/Taipei", utc(2025, 7, 8, 12, 16, 24)), ("2025-01-08T20:16:24+08:00[Asia/Taipei]", utc(2025, 1, 8, 12, 16, 24)),
    ("1736338584", utc(2025, 1, 8, 12, 16, 24)), ("1736338584099", utc(2025, 1, 8, 12, 16, 24) + 99), ("1736338584099123", utc(2025, 1, 8, 12, 16, 24) + 99),
    ("1736338584099123456", utc(2025, 1, 8, 12, 16, 24) + 99), ("1736338584.25", utc(2025, 1, 8, 12, 16, 24) + 250),
    # without a zone: Berlin
    ("2025-01-08 13:16", utc(2025, 1, 8, 12, 16)), ("08.01.2025 13:16:24", utc(2025, 1, 8, 12, 16, 24)), ("Jan 8, 2025 1:16:24 PM", utc(2025, 1, 8, 12, 16, 24)),
    ("Jan 8, 2025 12:00:00 AM", utc(2025, 1, 7, 23)), ("2025/01/08 13:16:24", utc(2025, 1, 8, 12, 16, 24)),
    ("2025-10-26 02:30:00", utc(2025, 10, 26, 0, 30)),  # occurs twice: the earlier
    ("2025-03-30 02:30:00", utc(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("03/04/2025 00:00:00", utc(2025, 4, 2, 22)),  # day before month
] + [(x, None) for x in ("", " ", "null", "n/a", "T::Z", "yesterday", "2025-1", "0000-00-00T00:00:00Z", "2025-02-30 10:00", "2025-01-08T25:00:00Z", "13/13/2025 10:00:00", "2025-01-08 10:00:00 XYZ", "2025-01-08T10:00:00[Nowhere/City]", "123", None)]


def test_forms(spark):
    df = spark.createDataFrame([("t", k, x, "h", "clash", 1) for k, (x, _) in enumerate(CASES)], RECORDS)
    zones = spark.createDataFrame([("h", "Europe/Berlin"), ("h", "UTC"), (None, "UTC"), ("z", None)], ZONES)
    got = {r.record_id: r.utc_millis for r in V.normalise_timestamps(df, zones).collect()}
    assert {CASES[k][0]: v for k, v in got.items()} == dict(CASES)
    for host in (None, "other", "z"):
        lone = spark.createDataFrame([("t", 1, "2025-01-08 13:16", host, "c", 1), ("t", 2, "2025-01-08 13:16Z", host, "c", 1)], RECORDS)
        assert {r.record_id: r.utc_millis for r in V.normalise_timestamps(lone, zones).collect()} == {1: None, 2: utc(2025, 1, 8, 13, 16)}
    assert V.normalise_timestamps(df.limit(0), zones).count() == 0
    rest = V.normalise_timestamps(df, zones, keep_normal=False)
    assert rest.count() == len(CASES) - 1


def test_all_readings(spark):
    df = spark.createDataFrame([("03/04/2025 10:00:00", "UTC"), ("04/04/2025 10:00:00", "UTC"), ("25/04/2025 10:00:00", "UTC"), ("2025-10-26 02:30:00", "Europe/Berlin"), ("2025-10-26 00:30:00", "Europe/Berlin"), ("2025-10-26T02:30:00Z", "Europe/Berlin")], "x string, z string")
    got = with_interpretations(df, "x", "z", day_first=None, fold="both").collect()
    assert [len(r.readings) for r in got] == [2, 1, 1, 2, 1, 1]
    assert got[0].readings[0].millis == utc(2025, 4, 3, 10) and got[0].readings[1].millis == utc(2025, 3, 4, 10)
    assert [x.millis for x in got[3].readings] == [utc(2025, 10, 26, 0, 30), utc(2025, 10, 26, 1, 30)]
    assert not spark.createDataFrame([("2025-01-08T12:16:24.099Z ",)], "x string").select(is_normal(F.col("x")).alias("n")).first().n


C = V.Costs(None, "both")


def brute(states):
    best, path = None, None
    for choice in itertools.product(*[range(len(s[1])) for s in states]):
        c = V.LATER_CHOICE * choice[0]
        for (a, i), (b, j) in zip(zip(states, choice), list(zip(states, choice))[1:]):
            c += C.step(a, b)[i, j]
        if best is None or c < best - 1e-12:
            best, path = c, list(choice)
    return best, path


def cost(states, path):
    return V.LATER_CHOICE * path[0] + sum(C.step(a, b)[i, j] for a, b, i, j in zip(states, states[1:], path, path[1:]))


def test_decoding_equals_brute_force_however_it_is_cut():
    rnd = random.Random(4)
    for _ in range(60):
        states = []
        for _ in range(rnd.randint(1, 8)):
            k = rnd.choice([1, 1, 2, 3])
            states.append(([rnd.choice("abc") for _ in range(k)], [rnd.randrange(10) * 100_000 for _ in range(k)]))
        best, _ = brute(states)
        assert cost(states, V._decode(states, C, None, None)) == pytest.approx(best)
        # cut into segments, chained by their matrices, each decoded with its fixed ends
        cuts = sorted(rnd.sample(range(1, len(states)), min(len(states) - 1, rnd.randint(0, 3)))) if len(states) > 1 else []
        parts = [states[a:b] for a, b in zip([0, *cuts], [*cuts, len(states)])]
        rows = [dict(chunk=c, segment=0, source="s", fa=p[0][0], ta=p[0][1], fb=p[-1][0], tb=p[-1][1], cost=V._matrix(p, C).ravel().tolist()) for c, p in enumerate(parts)]
        fixed = V._chain(rows, C)
        path = []
        for c, p in enumerate(parts):
            i, j = fixed.get((c, "s"), (None, None))
            path += V._decode(p, C, i, j)
        assert cost(states, path) == pytest.approx(best)


def test_rules_outweigh_the_order(spark):
    # the order would have the month first and the later of two equal times; the rules have it otherwise
    texts = [f"{m:02d}/28/2025 10:00:00" for m in range(1, 6)] + ["06/03/2025 10:00:00", "07/03/2025 10:00:00"] + ["2025-10-26T02:10:00Z", "2025-10-26 02:30:00", "2025-10-26 03:30:00"]
    df = spark.createDataFrame([("t", k, x, "h", "c", 1) for k, x in enumerate(texts)], RECORDS)
    zones = spark.createDataFrame([("h", "Europe/Berlin")], ZONES)
    got = {r.record_id: r for r in V.normalise_timestamps(df, zones, chunk_rows=2).collect()}
    assert all(got[k].utc_millis is None and got[k].n_readings == 0 for k in range(5))
    assert (got[5].utc_millis, got[6].utc_millis) == (utc(2025, 3, 6, 9), utc(2025, 3, 7, 9)) and got[5].n_readings == 2
    assert got[8].utc_millis == utc(2025, 10, 26, 0, 30) and got[8].n_readings == 2
    free = {r.record_id: r.utc_millis for r in V.normalise_timestamps(df, zones, day_first=None, fold="both").collect()}
    assert free[5] == utc(2025, 6, 3, 8) and free[0] == utc(2025, 1, 28, 9)
    month = {r.record_id: r.utc_millis for r in V.normalise_timestamps(df, zones, day_first=False).collect()}
    assert month[5] == utc(2025, 6, 3, 8) and month[4] == utc(2025, 5, 28, 8) and month[8] == utc(2025, 10, 26, 0, 30)
    swapped = spark.createDataFrame([("t", 1, "28/05/2025 10:00:00", "h", "c", 1)], RECORDS)
    assert V.normalise_timestamps(swapped, zones, day_first=False).first().utc_millis is None


def test_viterbi_over_chunks(spark):
    # one source writes month first throughout, with days that only sometimes show it
    rows, want = [], {}
    day = D.datetime(2025, 1, 1, 12)
    for k in range(400):
        day += D.timedelta(hours=19)
        rows.append(("t", k, day.strftime("%m/%d/%Y %H:%M:%S"), "us", "c", 1))
        want[k] = int((day - D.datetime(1970, 1, 1)).total_seconds() * 1000)
    zones = spark.createDataFrame([("us", "UTC")], ZONES)
    for partitions in ("1", "9"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r.record_id: r.utc_millis for r in V.normalise_timestamps(spark.createDataFrame(rows, RECORDS), zones, day_first=None).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert np.mean([got[k] == want[k] for k in want]) > 0.99
