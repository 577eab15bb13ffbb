"""Exact neighbours over blocks and the inverted file."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundwork.operators import neighbours


def frame(spark, data, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>")


def asked(rows):
    return rows.withColumnRenamed("id", "query_id")


def nearest(data, n, k):
    unit = neighbours.unit(data.astype(np.float32))
    sims = np.round(unit[:n] @ unit.T, 6)
    return {(q, int(i), r + 1) for q in range(n) for r, i in enumerate(np.lexsort((np.arange(len(data)), -sims[q]))[:k])}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    out = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    out[200:400] = out[200]  # a third of all rows are copies
    return out


def found(rows):
    return {(r.query_id, r.id, r["rank"]) for r in rows.collect()}


@pytest.mark.parametrize("most", [1 << 20, 600])
def test_exact_in_place_and_over_a_grid(spark, data, most):
    rows = frame(spark, data)
    got = neighbours.knn_exact(asked(rows.where("id < 30")), rows, 4, most_bytes=most)
    assert found(got) == nearest(data, 30, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(cell" in plan) == (most == 600) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_best_scores():
    sims = np.round(np.random.default_rng(5).normal(size=(30, 50)), 1)
    row, column, score = neighbours.best(sims, 4)
    for i in range(30):
        want = sorted(range(50), key=lambda j: (-sims[i, j], j))[:4]
        assert column[row == i].tolist() == want and score[row == i].tolist() == sims[i, want].tolist()


def test_cells_that_the_triangle_inequality_leaves_hold_the_exact_rows(spark, data, monkeypatch):
    rows, pairs = frame(spark, data), []
    scored = neighbours.scored
    monkeypatch.setattr(neighbours, "scored", lambda p, *a: pairs.append(p.agg(F.sum(F.col("n") * F.octet_length("q_ids") / 8)).first()[0] or 0) or scored(p, *a))
    assert found(neighbours.knn_approx(asked(rows.where("id < 200")), rows, 3, exact=True)) == nearest(data, 200, 3)
    assert sum(pairs) < 0.5 * 200 * 600  # clustered rows: most cells are ruled out
    pairs.clear()
    near = found(neighbours.knn_approx(asked(rows.where("id < 200")), rows, 3))
    assert len({x[:2] for x in near} & {x[:2] for x in nearest(data, 200, 3)}) >= 0.9 * 600 and len(near) == 600 and sum(pairs) < 0.2 * 200 * 600


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    want = {(r.query_id, r.id) for r in entry.queries()["knn_exact"](spark, sf).collect()}
    got = {(r.query_id, r.id) for r in entry.queries()["knn_approx"](spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_far_neighbours_odd_rows_and_none(spark):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "id long, vector array<float>")  # no two are nearer than cosine 0
    counts = neighbours.knn_approx(asked(rows), rows, 3, exact=True).groupBy("query_id").count().collect()
    assert [r["count"] for r in counts] == [3] * 8
    odd = rows.unionByName(spark.createDataFrame([(None, [1.0] * 8), (90, None), (91, []), (92, [0.0] * 8), (2**62 + 7, [1.0] + [0.0] * 7), (2**62 + 7, [1.0] + [0.0] * 7), (93, [1.0] * 3)], rows.schema))
    for search in (neighbours.knn_exact, neighbours.knn_approx):
        got = search(asked(rows.where("id = 0")), odd, 3).orderBy("rank").collect()
        assert [(r.id, r.similarity) for r in got] == [(0, 1.0), (2**62 + 7, 1.0), (2**62 + 7, 1.0)]
        assert search(asked(rows.limit(0)), rows, 3).count() == 0 == search(asked(rows), rows, 0).count()
        assert search(asked(rows), rows.limit(0), 3).count() == 0


def test_fitted_probes(spark, data):
    cells = neighbours.fit_cells(neighbours.usable(frame(spark, data), "id"), 16, 5, sample=300)
    assert len(cells.centres) == 120 and 1 <= cells.probes <= 120
    assert np.allclose(np.linalg.norm(cells.centres, axis=1), 1)


class Task:
    """Stands for a table in one task: what is mapped runs here, over the given batches, and only its rows and its peak of memory are kept."""

    def __init__(self, batches):
        self.batches = batches

    def where(self, _):
        return self

    def mapInArrow(self, run, _):
        run(iter(self.batches[:1]))
        tracemalloc.start()
        self.rows = sum(sum(b.column("n").to_pylist()) for b in run(iter(self.batches)))
        self.mb = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        return self


def batches(n, dims, *more):
    vectors = np.random.default_rng(3).normal(size=(n, dims)).astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, n * dims + 1, dims, dtype=np.int32), pa.array(vectors.ravel()))
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists, *more], names=["key", "vector", *(f"more{i}" for i in range(len(more)))])
    return [whole.slice(at, 10000) for at in range(0, n, 10000)]


def test_dealing_the_corpus_holds_no_table_of_rows_by_cells(spark):
    cells = neighbours.Cells(neighbours.unit(np.random.default_rng(4).normal(size=(2048, 8))), 2048)
    few, many = (neighbours.blocks(Task(batches(n, 8)), 8, cells.own) for n in (10_000, 80_000))
    assert (few.rows, many.rows) == (10_000, 80_000) and few.mb < 80 and many.mb < 100  # the table would have 1250 MB


def test_dealing_queries_to_every_cell_holds_no_copy_a_cell():
    centres = neighbours.unit(np.random.default_rng(4).normal(size=(1024, 8)))
    cells = neighbours.Cells(centres, 1024, np.full(1024, -1.0))
    near, kth = pa.array([bytes(128)] * 10_000), pa.array(np.full(10_000, -2.0))
    dealt = neighbours._probes(Task(batches(10_000, 8, near, kth)), 8, cells)
    assert dealt.rows == 10_000 * 1024 and dealt.mb < 150  # all at once are 625 MB as the matrix of the bound alone


def test_probes_come_once_in_the_order_of_centres():
    rng = np.random.default_rng(6)
    centres, x = neighbours.unit(rng.normal(size=(40, 8))), neighbours.unit(rng.normal(size=(3000, 8)))
    cells = neighbours.Cells(centres, 30, np.full(40, 0.9))
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")
    probed = cells.probed(x, 7)
    assert (probed.sum(axis=1) == 7).all() and all(probed[i, order[i, :7]].all() for i in range(len(x)))
    bound = np.cos(np.maximum(np.arccos(x @ centres.T) - np.arccos(0.9), 0))
    left = cells.probed(x, 30, np.full(len(x), 0.5))
    assert all(set(np.flatnonzero(left[i])) == {c for c in order[i, :30] if bound[i, c] + 1e-6 >= 0.5} for i in range(len(x)))


def test_small_blocks_of_a_cell_become_one_and_full_ones_stay(spark):
    copies = F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.sin("id")).cast("float")  # two thirds are copies, more than half a block for each of three tasks
    rows = spark.range(0, 60_000, 1, 3).select(F.col("id").alias("key"), F.array(copies, *(F.lit(0.5).cast("float"),) * 15).alias("vector"))
    cells = neighbours.Cells(neighbours.unit(np.array([[1, *[0.5] * 15], [0, *[0.5] * 15], [-1, *[0.5] * 15]])), 3)
    made = neighbours.blocks(rows, 16, cells.own)
    got = neighbours.merged(made, 16, 4).collect()
    few, many = ({c: sum(r.cell == c for r in some) for c in range(3)} for some in (got, made.collect()))
    assert many == {0: 3, 1: 3, 2: 3} and few == {0: 3, 1: 1, 2: 1} and max(r.n for r in got) <= 16384
    seen = np.concatenate([np.frombuffer(r.ids, dtype=np.int64) for r in got])
    assert np.array_equal(np.sort(seen), np.arange(60_000)) and all((np.diff(np.frombuffer(r.ids, dtype=np.int64)) > 0).all() for r in got)
    for r in got:
        ids, vectors = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.vectors, dtype=np.float32).reshape(-1, 16)
        assert np.allclose(vectors[:, 0], np.where(ids % 3 > 0, 1, np.sin(ids)), atol=1e-6) and (cells.own(vectors) == r.cell).all()


@pytest.mark.parametrize("most, numbers", [(1, 1), (50, 700), (1000, 1 << 20)])
def test_candidates_are_merged_before_many_are_held(data, monkeypatch, most, numbers):
    monkeypatch.setattr(neighbours, "HELD_ROWS", most)
    monkeypatch.setattr(neighbours, "NUMBERS", numbers)
    block = lambda rows: (np.asarray(rows, dtype=np.int64).tobytes(), data[rows].astype(np.float32).tobytes())
    pairs = [(*block(range(q, q + 10)), *block(range(c, c + 100))) for c in range(0, 600, 100) for q in (0, 10, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs)], names=["q_ids", "q_vectors", "ids", "vectors"])

    class Pairs:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: list(run(iter([batch.slice(0, 7), batch.slice(7)])))

    sent = neighbours.scored(Pairs(), 16, 4, 4, 4)
    rows = sorted((q, -s, i) for b in sent for q, i, s in zip(*(c.to_pylist() for c in b.columns)))
    got = {(q, i, r + 1) for n in range(30) for r, (q, _, i) in enumerate([x for x in rows if x[0] == n][:4])}
    assert got == nearest(data, 30, 4) and (len(sent) == 1) == (most == 1000)


def test_probes_are_never_broadcast(spark, data, monkeypatch):
    rows, plans, scored = frame(spark, data), [], neighbours.scored
    monkeypatch.setattr(neighbours, "scored", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or scored(pairs, *a))
    assert found(neighbours.knn_approx(asked(rows.where("id < 30")), rows, 3, exact=True)) == nearest(data, 30, 3)
    assert len(plans) == 2 and all("SortMergeJoin [cell" in p and p.count("BroadcastExchange") == i for i, p in enumerate(plans))  # in the second, only the k-th scores


def test_recall_on_rows_that_the_centres_have_not_seen(spark):
    data = np.random.default_rng(8).normal(size=(4000, 16))
    rows = frame(spark, data)
    near = found(neighbours.knn_approx(asked(rows.where("id < 200")), rows, 5, sample=400))
    assert len({x[:2] for x in near} & {x[:2] for x in nearest(data, 200, 5)}) >= 0.9 * 1000
