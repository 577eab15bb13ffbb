"""Running values per key without a task per key, against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundwork.operators import scans, traffic

BIG = 2**62 + 7


def rows_of(seed, n=900):
    """(key, seconds, id): a hot key, null keys, large keys, ties."""
    rng = random.Random(seed)
    keys = [1] * 6 + [None, None, BIG, BIG + 1, 5, 6, 7, 8]
    out = [(rng.choice(keys), rng.randrange(3000) * rng.choice([1, 1, 7]), i) for i in range(n)]
    return out + [(2**53 + 1, 5, n), (2**53, 5, n + 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, t long, i long").withColumn("ts", F.timestamp_seconds("t"))


def by_key(rows):
    held = defaultdict(list)
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        held[k].append((t, i))
    return held


def windows(rows, width):
    out = {}
    for own in by_key(rows).values():
        start = None
        for t, i in own:
            if start is None or t - start >= width:
                start, turn = t, 0
            turn += 1
            out[i] = (start, turn)
    return out


@pytest.mark.parametrize("block", [4, 64, scans.BLOCK])
@pytest.mark.parametrize("width", [1, 40, 5000])
def test_anchored_windows_match_a_loop(spark, width, block):
    rows = rows_of(width)
    want = windows(rows, width)
    events = frame(spark, rows)
    got = {r.i: r for r in traffic.quota_anchored(events, "k", "ts", 3, width, "i", block).collect()}
    assert {i: (r.allowed, r.remaining, r.reset_at) for i, r in got.items()} == {i: (turn <= 3, max(3 - turn, 0), start + width) for i, (start, turn) in want.items()}
    assert {i: r.k for i, r in got.items()} == {i: k for k, _, i in rows}
    hits = {r.i: (r.k, r.hit, r.expires_at) for r in traffic.cache_hits(events, "k", "ts", width, "i", block).collect()}
    assert hits == {i: (k, want[i][1] > 1, float(want[i][0] + width)) for k, _, i in rows}


def test_a_hot_key_is_spread_over_all_tasks(spark):
    n, parts = 200_000, 8
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 5 % 86400).alias("ts"))
    sizes = scans.ranges(rows, ["k"], ["ts", "i"]).groupBy("_range").count().collect()
    assert len(sizes) == parts and max(r["count"] for r in sizes) < n / parts * 1.5
    out = traffic.quota_anchored(rows.where("k = 7"), "k", "ts", 5, 600, "i", block=1000)
    got = [(r.i, r.reset_at) for r in out.where("remaining = 4").orderBy("reset_at").collect()]
    want = windows([(7, i * 5 % 86400, i) for i in range(0, n, 3)], 600)
    assert got == sorted(((i, s + 600) for i, (s, turn) in want.items() if turn == 1), key=lambda x: x[1])


def test_aligned_quota_matches_a_loop(spark):
    rows = rows_of(2)
    seen, want = defaultdict(int), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k, t // 60] += 1
        want[i] = (k, seen[k, t // 60] <= 3, max(3 - seen[k, t // 60], 0), (t // 60 + 1) * 60)
    assert {r.i: (r.k, r.allowed, r.remaining, r.reset_at) for r in traffic.quota_aligned(frame(spark, rows), "k", "ts", 3, 60, "i").collect()} == want


def test_sessions_match_a_loop(spark):
    rows = rows_of(3)
    want = []
    for k, own in by_key(rows).items():
        session, last, held = 0, own[0][0], defaultdict(list)
        for t, _ in own:
            session += t - last > 20
            last = t
            held[session].append(t)
        want += [(k, s, min(ts), max(ts), len(ts)) for s, ts in held.items()]
    got = traffic.sessionize(frame(spark, rows), "k", "ts", 20, "i").select("k", "session", F.unix_seconds("started"), F.unix_seconds("ended"), "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cached_values_match_a_loop(spark):
    rows = rows_of(4)
    want = {}
    for k, own in by_key(rows).items():
        last = None
        for t, i in sorted(own, key=lambda x: (x[0], x[1] % 4 != 0, x[1])):
            if i % 4 == 0:
                last = (t, float(i))
            else:
                live = last is not None and last[0] + 50 > t
                want[i] = (k, last[1] if live else None, live)
    events = frame(spark, rows).withColumn("value", F.col("i").cast("double"))
    got = traffic.cache_asof(events.where("i % 4 = 0"), events.where("i % 4 <> 0"), "k", "ts", 50, "i").collect()
    assert {r.i: (r.k, r.value, r.hit) for r in got} == want


def test_events_without_a_time_and_none(spark):
    events = spark.createDataFrame([(1, None, 0), (1, 10, 1), (None, None, 2)], "k long, t long, i long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.i: (r.allowed, r.remaining, r.reset_at) for r in traffic.quota_anchored(events, "k", "ts", 2, 10, "i").collect()}
    assert got == {0: (False, 0, None), 1: (True, 1, 20), 2: (False, 0, None)}
    for rows in (traffic.quota_anchored(events.limit(0), "k", "ts", 2, 10, "i"), traffic.quota_aligned(events.limit(0), "k", "ts", 2, 10, "i"), traffic.sessionize(events.limit(0), "k", "ts", 2, "i")):
        assert rows.count() == 0
