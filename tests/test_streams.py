"""Streams with state that ends, and the bucketed snapshot."""

import os
import time

import pytest
from pyspark.sql import functions as F

from groundwork.operators import dialogue, traffic
from groundwork.streaming import stateful, streams

BIG = 2**62 + 7
EVENTS = "k long, ts timestamp, i long"


def files(spark, folder, rows, n):
    """One file, so that each is a micro-batch of its own."""
    frame = spark.createDataFrame(rows, "k long, t long, i long").select("k", F.timestamp_seconds("t").alias("ts"), "i")
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    os.utime(folder, (n, n))


def source(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(rows, tmp_path, name):
    out = []
    query = rows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True)
    query = query.foreachBatch(lambda b, i: out.extend(b.collect())).start()
    query.awaitTermination(120)
    return out, query


ROWS = [[(1, 100 + i, i) for i in range(7)] + [(None, 100, 10), (None, 101, 11), (BIG, 100, BIG + 1), (BIG + 1, 100, BIG + 2), (5, 130, None)], [(1, 107, 20), (1, 111, 21), (None, 112, 22)], [(7, 90000, 30)], [(7, 90001, 31)]]


def test_windows_equal_the_batch_twin_and_their_state_ends(spark, tmp_path):
    for n, rows in enumerate(ROWS):
        files(spark, tmp_path / "in", rows, n)
        time.sleep(0.05)
    everything = spark.read.schema(EVENTS).parquet(str(tmp_path / "in"))
    out, query = run(stateful.quota_anchored(source(spark, tmp_path / "in"), "k", "i", 3, 10), tmp_path, "q")
    want = traffic.quota_anchored(everything, "k", "ts", 3, 10, "i").collect()
    assert sorted(map(str, out)) == sorted(map(str, want))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 6 and held[-1] == 1  # five keys came and went, one stays
    hits, _ = run(stateful.cache_hits(source(spark, tmp_path / "in"), "k", "i", 10), tmp_path, "h")
    assert sorted(map(str, hits)) == sorted(map(str, traffic.cache_hits(everything, "k", "ts", 10, "i").collect()))


TURNS = [(1, 1, "I want to invest in a company"), (1, 2, "It is a software company"), (1, 3, "3% of revenue is haram"), (None, 1, "a loan"), (None, None, None), (BIG, 1, "hello"), (BIG, 2, None)]


def test_dialogues_with_null_sessions_equal_the_batch_twin(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "session_id long, turn long, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = dialogue.clarify(turns).collect()
    assert {r.session_id for r in want} == {1, None, BIG} and len(want) == len(TURNS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        out, _ = run(stateful.clarify_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))), tmp_path, "d")
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert sorted(map(str, out)) == sorted(map(str, want))


@pytest.mark.parametrize("idle,states", [(1, ["CLARIFYING", "CLARIFYING"]), (86_400_000, ["CLARIFYING", "CLARIFYING"])])
def test_an_idle_dialogue_is_forgotten(spark, tmp_path, idle, states):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    turns, known = "session_id long, turn long, text string", []
    try:
        for turn, text in ((1, "I want to invest in a company"), (2, "It is a software company")):
            spark.createDataFrame([(1, turn, text)], turns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = stateful.clarify_stream(spark.readStream.schema(turns).parquet(str(tmp_path / "in")), idle=idle)
            out, _ = run(rows, tmp_path, "t")
            known += [(r.state, r.known) for r in out]
            time.sleep(0.05)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert [k[0] for k in known] == states and (known[1][1] == "{}") == (idle == 1)


def written(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_micro_batch_rewrites_only_its_buckets_and_may_run_again(spark, tmp_path):
    schema = "id string, v string, seq int"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.incremental_upsert(stream, str(tmp_path / "out"), "id", "seq", str(tmp_path / "c"), buckets=16).trigger(availableNow=True).start().awaitTermination(120)

    read = lambda: {r.id: r.v for r in streams.snapshot(spark, str(tmp_path / "out"), spark.createDataFrame([], "id string, v string").schema).collect()}
    batch([(f"d{i}", "old", 1) for i in range(200)] + [(None, "none", 1), ("d5", "older", 0)])
    first = written(tmp_path / "out")
    assert len(first) == 16 and read() == {f"d{i}": "old" for i in range(200)} | {None: "none"}
    batch([("d7", "new", 1)])
    second = written(tmp_path / "out")
    assert len(set(second) - set(first)) == 1 and all(second[p] == t for p, t in first.items())
    want = {f"d{i}": "old" for i in range(200)} | {None: "none", "d7": "new"}
    assert read() == want
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):  # as if the driver had died before the commit
        file.unlink()
    batch([("e", "e", 1)])
    assert read() == want | {"e": "e"}
    for k in range(3):
        batch([("d7", f"new{k}", 1)])
    own = {p for p in written(tmp_path / "out") if "bucket=" in p}
    bucket = next(iter(set(second) - set(first))).split("bucket=")[1].split("/")[0]
    assert len([p for p in own if f"bucket={bucket}/" in p]) == 2 and read() == want | {"e": "e", "d7": "new2"}
