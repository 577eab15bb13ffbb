"""Nearest neighbours by blocks of vectors: exact over a grid of blocks, and through an inverted file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwork.sources.shared import fresh_folder

MOST_BYTES = 64 << 20  # of query vectors that are sent to every task at once
BLOCK_BYTES = 1 << 20  # of the vectors of a block
HELD_ROWS = 1 << 20  # candidates: a task merges a quarter of these at a time, and sends on what is left where it is half of them
HELD_BYTES = 32 << 20  # of vectors that a task deals to cells at once
ASKED_BYTES = 128 << 10  # of query vectors that a task deals to the cells they probe
SENT_BYTES = 8 << 20  # of blocks that a task makes before it sends them on
NUMBERS = 1 << 20  # of a matrix of scores that is there at once
BLOCK = "cell long, n long, ids binary, vectors binary"
FOUND = "query_id long, id long, similarity double"


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def slices(rows: int, width: int) -> list[slice]:
    """Ranges of rows whose matrix of this width holds at most ``NUMBERS``, so that memory depends neither on the rows of a task nor on the number of cells."""
    step = max(1, NUMBERS // max(1, width))
    return [slice(a, a + step) for a in range(0, rows, step)]


def best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k largest scores to 6 digits, the first columns on ties: a partition finds the k-th score, and only scores as large are sorted."""
    sims = np.round(sims, 6)
    n = sims.shape[1]
    if n > k:
        row, column = np.nonzero(sims >= np.partition(sims, n - k, axis=1)[:, n - k, None])
    else:
        row, column = (x.ravel() for x in np.indices(sims.shape))
    score = sims[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept], score[kept]


def rank_within_query(rows: DataFrame, score: str, k: int, tie: str = "id") -> DataFrame:
    """Rank by score, cut at k; Spark limits each task's groups before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def usable(rows: DataFrame, key: str) -> DataFrame:
    """key and vector of the rows that have both; vectors of floats keep 4 bytes a number."""
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    vector = F.col("vector") if kind == "float" else F.col("vector").cast("array<double>")
    return rows.where(F.col(key).isNotNull() & (F.size("vector") > 0)).select(F.col(key).cast("long").alias("key"), vector.alias("vector"))


def _arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(-1, dims)


def _sent(made: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks (cell, ids, vectors) in batches of a few megabytes."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["cell", "n", "ids", "vectors"])

    held, size = [], 0
    for cell, ids, vectors in made:
        held.append((int(cell), len(ids), ids.tobytes(), vectors.tobytes()))
        size += ids.nbytes + vectors.nbytes
        if size >= SENT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _most(vectors: np.ndarray) -> int:
    """Rows of a full block."""
    return max(1, BLOCK_BYTES // max(1, vectors.itemsize * vectors.shape[1]))


def _packed(cells: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows of one cell, by id."""
    order = np.lexsort((ids, cells))
    cells, most = cells[order], _most(vectors)
    edges = np.flatnonzero(np.diff(cells, prepend=-1)).tolist()
    for start, stop in zip(edges, [*edges[1:], len(cells)]):
        for at in range(start, stop, most):
            rows = order[at : min(at + most, stop)]
            yield cells[at], ids[rows], vectors[rows]


def blocks(rows: DataFrame, dims: int, cells: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of (key, vector) as blocks. ``cells`` gives the cells of a matrix of vectors, by default 0. Tasks deal what they read; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            yield from _sent(_packed(cells(vectors) if cells else np.zeros(len(ids), dtype=np.int64), ids, vectors))

        for batch in batches:
            held.append(_arrays(batch, dims))
            size += held[-1][1].nbytes
            if size >= HELD_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return rows.where(F.size("vector") == dims).mapInArrow(run, BLOCK)


def merged(rows: DataFrame, dims: int, width: int) -> DataFrame:
    """The blocks, with the small ones that many tasks made for a cell put together. Those half full stay and go to any task, so a cell of many copies isn't one task's alone."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = BLOCK_BYTES // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            held, size, now = [], 0, None
            for batch in batches:
                for cell, ids, vectors in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    block = np.frombuffer(ids.as_py(), dtype=np.int64), np.frombuffer(vectors.as_py(), dtype=f"f{width}").reshape(-1, dims)
                    if held and (cell != now or size >= least):
                        yield from _packed(np.full(sum(len(h[0]) for h in held), now), *(np.concatenate(c) for c in zip(*held)))
                        held, size = [], 0
                    if block[1].nbytes >= least:
                        yield cell, *block
                    else:
                        held.append(block)
                        size, now = size + block[1].nbytes, cell
            if held:
                yield from _packed(np.full(sum(len(h[0]) for h in held), now), *(np.concatenate(c) for c in zip(*held)))

        yield from _sent(made())

    by = F.when(F.octet_length("vectors") >= least, F.xxhash64("ids")).otherwise(F.xxhash64("cell"))
    return rows.repartition(tasks, by).sortWithinPartitions("cell").mapInArrow(run, BLOCK)


def scored(pairs: DataFrame, dims: int, k: int, width: int, other: int) -> DataFrame:
    """(query_id, id, similarity): the k best of a task's pairs of blocks for every query. ``width``, ``other``: bytes of a number of the queries' and the corpus's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def kept() -> list[np.ndarray]:
            query, near, sims = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((near, -sims, query))
            first = np.searchsorted(query[order], query[order])
            order = order[np.arange(len(order)) - first < k]
            return [query[order], near[order], sims[order]]

        def sent(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "similarity"])

        for batch in batches:
            for q_ids, q_vectors, ids, vectors in zip(*(batch.column(i) for i in range(4))):
                mine, theirs = np.frombuffer(q_ids.as_py(), dtype=np.int64), np.frombuffer(ids.as_py(), dtype=np.int64)
                a, b = (unit(np.frombuffer(v.as_py(), dtype=f"f{w}").reshape(-1, dims)) for v, w in ((q_vectors, width), (vectors, other)))
                for some in slices(len(a), len(b)):
                    query, near, sims = best(a[some] @ b.T, k)
                    held.append([mine[some][query], theirs[near], sims])
                    size += len(query)
                if size >= HELD_ROWS // 4:
                    held, size = [kept()], 0
                    if len(held[0][0]) >= HELD_ROWS // 2:
                        yield sent(held.pop())
        if held:
            yield sent(kept())

    return pairs.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(run, FOUND)


def _width(rows: DataFrame) -> int:
    return 4 if rows.schema["vector"].dataType.elementType.simpleString() == "float" else 8


def _asked(probes: DataFrame) -> DataFrame:
    return probes.select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): the k most cosine-similar rows for each query; similarity to 6 digits, ties by id.

    ``queries`` has query_id and vector, ``corpus`` id and vector; rows with a null id or a null or empty vector take no part, nor corpus rows of another length than the queries'. Both sides are packed into
    blocks of a megabyte. Query blocks of ``most_bytes`` at most (measured) are sent to the tasks that read the corpus, which then is not shuffled; more of them are dealt by a join to a grid, every
    stripe of the corpus with all query blocks. A pair of blocks is multiplied at once and keeps k rows per query, so scores are neither shuffled nor held, and one window over these candidates gives the ranks.
    """
    mine, theirs = usable(queries, "query_id"), usable(corpus, "id")
    n, dims = mine.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n or k <= 0:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank long")
    asked, held = _asked(blocks(mine, dims)), blocks(theirs, dims)
    if n * dims * _width(mine) <= most_bytes:
        pairs = held.join(F.broadcast(asked), "cell")
    else:
        stripes = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = held.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(stripes)))
        pairs = dealt.join(asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))), "cell")
    return rank_within_query(scored(pairs, dims, k, _width(mine), _width(theirs)), "similarity", k)


@dataclass
class Cells:
    """The coarse part of an inverted file: centres (unit vectors), how many cells a query probes, and the smallest cosine of any member of a cell to its centre."""

    centres: np.ndarray
    probes: int
    reach: np.ndarray | None = None

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centre's cell."""
        return np.concatenate([np.argmax(unit(vectors[some]) @ self.centres.T, axis=1) for some in slices(len(vectors), len(self.centres))] or [np.zeros(0, dtype=np.int64)])

    def probed(self, vectors: np.ndarray, stop: int, kth: np.ndarray | None = None) -> np.ndarray:
        """(vector, cell) booleans: the ``stop`` cells with the nearest centres, without those that can't hold a row as similar as the vector's ``kth``.

        A member's angle to the centre is at most the cell's, so by the triangle inequality its angle to the vector is at least the difference.
        """
        out = np.zeros((len(vectors), len(self.centres)), dtype=bool)
        for some in slices(*out.shape):
            sims, part = unit(vectors[some]) @ self.centres.T, out[some]
            np.put_along_axis(part, np.argsort(-sims, axis=1, kind="stable")[:, :stop], True, axis=1)
            if kth is not None:
                angle = np.arccos(np.clip(sims, -1, 1)) - np.arccos(np.clip(self.reach, -1, 1))
                part &= np.cos(np.maximum(angle, 0)) + 1e-6 >= kth[some, None]  # scores are rounded to 6 digits
        return out


def fit_cells(corpus: DataFrame, dims: int, k: int, *, sample: int = 16384, per_cell: int = 5, most_cells: int = 4096, recall: float = 0.92, turns: int = 8, trials: int = 512) -> Cells:
    """Centres by k-means on the unit sphere, over the ``sample`` rows with the least hash of their id, and the number of probes that reaches ``recall`` on ``trials`` of these rows.

    The sample bounds what reaches the driver. Of a larger corpus up to twice as many are taken, and every other one, which the centres haven't seen, is for the trials. A trial's k nearest others in the sample are farther off than its k nearest in the corpus, so probes are rather too many than too few.
    """
    n = corpus.count()
    held = corpus.where(F.size("vector") == dims).orderBy(F.xxhash64("key"), "key").limit(sample if n <= sample else 2 * sample).select("vector").toArrow()
    x = unit(np.asarray(held.column(0).combine_chunks().flatten()).reshape(-1, dims))
    if not len(x):
        return Cells(np.zeros((1, dims)), 1)
    x, held = (x, x) if len(x) <= sample else (x[::2], x[1::2])  # centres fitted on the trials themselves would lie nearer to them than to other rows
    count = max(1, min(most_cells, n // per_cell, len(x) // 2))
    centres = x[np.linspace(0, len(x) - 1, count).astype(np.int64)]
    for _ in range(turns):
        cell = Cells(centres, 1).own(x)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        full = np.bincount(cell, minlength=count) > 0
        centres = np.where(full[:, None], unit(sums), centres)
    cell, some = Cells(centres, 1).own(held), held[: min(trials, len(held))]
    sims = some @ held.T
    sims[np.arange(len(some)), np.arange(len(some))] = -2
    near = np.argsort(-sims, axis=1)[:, : max(1, min(k, len(held) - 1))]
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(place, cell[near], axis=1).ravel() + 1
    return Cells(centres, int(np.quantile(needed, recall, method="higher")))


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int, *, exact: bool = False, **fit) -> DataFrame:
    """As ``knn_exact``, through an inverted file: rows are dealt to the cells of ``fit_cells`` and a query is compared with those of its nearest cells only.

    A quarter of a query's probes come first; their k-th score rules out every later cell that the triangle inequality puts farther off. The others are probed up to the fitted number, or, with ``exact``, all of
    them, which gives the rows of ``knn_exact``. The corpus is shuffled once into blocks by cell, which are written; blocks meet the queries that probe their cell in a sort-merge join, of which Spark may split a large cell.
    A task holds a bounded number of vectors, scores and blocks at once, however many rows, cells and probes there are.
    """
    spark = queries.sparkSession
    mine, theirs = usable(queries, "query_id"), usable(corpus, "id")
    n, dims = mine.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n or k <= 0:
        return spark.createDataFrame([], FOUND + ", rank long")
    cells = fit_cells(theirs, dims, k, **fit)
    if exact:
        cells.probes = len(cells.centres)
    path, centres = fresh_folder(spark, "cells"), cells.centres
    width, other = _width(mine), _width(theirs)
    merged(blocks(theirs, dims, cells.own), dims, other).write.parquet(path)
    held = spark.read.schema(BLOCK).parquet(path)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            least = [float((unit(np.frombuffer(v.as_py(), dtype=f"f{other}").reshape(-1, dims)) @ centres[c]).min()) for c, v in zip(cell, batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(least)], names=["cell", "least"])

    cells.reach = np.ones(len(centres))
    for r in held.select("cell", "vectors").mapInArrow(reach, "cell long, least double").groupBy("cell").agg(F.min("least").alias("least")).collect():  # one row a cell
        cells.reach[r.cell] = r.least
    first, path = max(1, cells.probes // 4), fresh_folder(spark, "asked")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(centres)):
                near = np.packbits(cells.probed(_arrays(part, dims)[1], first), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in near])], names=["key", "vector", "near"])

    kind = mine.schema["vector"].dataType.simpleString()
    asked = mine.where(F.size("vector") == dims).repartition(-(-n * dims * width // ASKED_BYTES)).mapInArrow(begun, f"key long, vector {kind}, near binary")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    # Spark takes probes for as large as the queries that they are made of, and would broadcast many gigabytes
    ask = lambda probes: scored(held.join(_asked(probes).hint("merge"), "cell"), dims, k, width, other)
    near = ask(_probes(asked, dims, cells))
    path = fresh_folder(spark, "near")
    rank_within_query(near, "similarity", k).write.parquet(path)
    near = spark.read.schema(FOUND + ", rank long").parquet(path)
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("key"), F.col("similarity").alias("kth"))
    rest = asked.join(kth, "key", "left").select("key", "vector", "near", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
    return rank_within_query(near.drop("rank").unionByName(ask(_probes(rest, dims, cells))), "similarity", k)


def _parts(batch: pa.RecordBatch, cells: int) -> list[pa.RecordBatch]:
    """Slices of the batch whose table of probes, a byte a cell, is bounded."""
    most = max(1, 16 * NUMBERS // cells)
    return [batch.slice(at, most) for at in range(0, batch.num_rows, most)]


def _probes(rows: DataFrame, dims: int, cells: Cells) -> DataFrame:
    """Blocks of queries by the cells that they probe: those of ``near``, or with a ``kth`` score the others that may hold a row as similar."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in _parts(batch, len(cells.centres)):
                ids, vectors = _arrays(part, dims)
                near = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                probed = np.unpackbits(near, axis=1, count=len(cells.centres)).astype(bool)
                if part.num_columns > 3:
                    probed = cells.probed(vectors, cells.probes, part.column(3).to_numpy()) & ~probed
                most = _most(vectors)
                for cell, column in enumerate(np.ascontiguousarray(probed.T)):
                    who = np.flatnonzero(column)
                    yield from ((cell, ids[who[at : at + most]], vectors[who[at : at + most]]) for at in range(0, len(who), most))

    return rows.mapInArrow(lambda batches: _sent(made(batches)), BLOCK)
