"""Line dedup: common lines in a sharded minimal perfect hash over compact arrays, which documents probe."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .perfect import PerfectHash

WHITE = b" \t\n\v\f\r"
ARRAYS = ("sizes", "bits", "prints", "counts", "owners")
SHARD = "shard int, n long, hits long, width int, " + ", ".join(f"{a} binary" for a in ARRAYS)


def _split(texts: list[bytes | None], least_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's lines; row, place and hash (two halves) of the lines whose key is long enough."""
    lines, rows, places, digests = [], [], [], []
    for i, data in enumerate(texts):
        own = (data or b"").split(b"\n")
        lines.append(own)
        for j, line in enumerate(own):
            key = line.strip(WHITE)
            if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                rows.append(i)
                places.append(j)
                digests.append(xxhash.xxh3_128_digest(key.lower()))  # bytes: A-Z only
    return lines, np.array(rows, dtype=np.int64), np.array(places, dtype=np.int64), np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def _identity(key: str | Column) -> Column:
    """64 bits of a key, one for one if the key is an integer."""
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.isnull(key))


def common_lines(docs: DataFrame, key: str, least_chars: int, least_docs: int) -> DataFrame:
    """(hi, lo, docs, owner): the line keys that stand in ``least_docs`` rows or more, by the halves of their hash; owner is the identity of the largest key."""
    own = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary").alias("_text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows, _, halves = _split(batch.column(1).to_pylist(), least_chars)
            found = np.unique(np.column_stack([rows, halves]), axis=0) if len(rows) else np.zeros((0, 3), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["_key", "hi", "lo"])

    held = own.mapInArrow(emit, f"_key {own.schema['_key'].dataType.simpleString()}, hi long, lo long")
    counted = held.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("_key").alias("_key")).where(F.col("docs") >= least_docs)
    return counted.select("hi", "lo", "docs", _identity("_key").alias("owner"))


def _built(table: pa.Table) -> pa.Table:
    hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    docs, owner = table.column("docs").to_numpy(), table.column("owner").to_numpy()
    index = PerfectHash.over(hi, lo)
    order = np.argsort(index.numbers(hi, lo))
    kind = np.min_scalar_type(int(docs.max()))
    arrays = [index.sizes, index.bits, lo[order], docs[order].astype(kind), owner[order]]
    row = [table.column("shard")[0].as_py(), len(hi), int(docs.sum()), kind.itemsize, *(a.tobytes() for a in arrays)]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * len(ARRAYS)]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=["shard", "n", "hits", "width", *ARRAYS])


def line_index(common: DataFrame, shard_keys: int) -> DataFrame:
    """``common_lines`` in shards of about ``shard_keys`` keys: a perfect hash and, by its numbers, the arrays of fingerprints, counts and owners."""
    shards = max(1, -(-common.count() // shard_keys))
    return common.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_built, SHARD)


class Shard:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        self.index = PerfectHash(np.frombuffer(row["sizes"], dtype=np.int64), np.frombuffer(row["bits"], dtype=np.uint64))
        self.prints, self.owners = np.frombuffer(row["prints"], dtype=np.uint64), np.frombuffer(row["owners"], dtype=np.int64)
        self.counts = np.frombuffer(row["counts"], dtype=f"u{row['width']}")

    def probe(self, hi: np.ndarray, lo: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many documents hold each line, if it is a common one that another document keeps; else 0."""
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        out = np.zeros(len(hi), dtype=np.int64)
        at = self.index.numbers(hi, lo)
        met = np.flatnonzero(at >= 0)
        met = met[(self.prints[at[met]] == lo[met]) & (self.owners[at[met]] != own[met])]
        out[met] = self.counts[at[met]]
        return out


def _cut(batch: pa.RecordBatch, least_chars: int, texts: bool, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[list]:
    """n_lines, n_dropped, most_docs, kept_sha256 (and the text) of a batch's texts. ``judge`` gives the documents of each line to drop, 0 for the others, from rows and hashes."""
    lines, rows, places, halves = _split(batch.column(batch.schema.get_field_index("_text")).to_pylist(), least_chars)
    docs = judge(rows, halves) if len(rows) else np.zeros(0, dtype=np.int64)
    gone: dict[int, set[int]] = {}
    most: dict[int, int] = {}
    for i, j, n in zip(rows[docs > 0].tolist(), places[docs > 0].tolist(), docs[docs > 0].tolist()):
        gone.setdefault(i, set()).add(j)
        most[i] = max(most.get(i, 0), n)
    kept = [b"\n".join(own if i not in gone else [x for j, x in enumerate(own) if j not in gone[i]]) for i, own in enumerate(lines)]
    out = [[len(own) for own in lines], [len(gone.get(i, ())) for i in range(len(lines))], [most.get(i) for i in range(len(lines))], [hashlib.sha256(k).hexdigest() for k in kept]]
    return [*out, kept] if texts else out


def _in_place(rows: DataFrame, index: DataFrame, shards: int, cut: Callable, schema: str, passed: list[str]) -> DataFrame:
    """Every task probes all shards, which are few bytes, for the lines of its own documents: nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast({r.shard: r.asDict() for r in index.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: Shard(row) for s, row in shared.value.items()}
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_own")).to_numpy()

            def judge(at: np.ndarray, halves: np.ndarray) -> np.ndarray:
                out, of = np.zeros(len(at), dtype=np.int64), halves[:, 0] % shards
                for s in np.unique(of).tolist():
                    if s in held:
                        mine = np.flatnonzero(of == s)
                        out[mine] = held[s].probe(halves[mine, 0], halves[mine, 1], own[at[mine]])
                return out

            yield cut(batch, judge)

    return rows.select(*passed, "_own", "_text").mapInArrow(run, schema)


def _routed(rows: DataFrame, index: DataFrame, shards: int, least_chars: int, most_probes: int, cut: Callable, schema: str, passed: list[str]) -> DataFrame:
    """Hashes of lines travel to their shard and are read there as a stream behind its arrays; what must go comes back once for each text.

    A shard with many hits is sent to several tasks, and its probes are dealt to these, so no common line makes a task long.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"_a": F.xxhash64("_own", "_text"), "_b": F.xxhash64("_text", F.lit("b"), "_own")})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, _, halves = _split(batch.column(4).to_pylist(), least_chars)
            sent = [batch.column(i).take(pa.array(at)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*sent, pa.array(halves[:, 0] % shards, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["_a", "_b", "_own", "_salt", "shard", "hi", "lo"])

    probes = rows.select("_a", "_b", "_own", F.monotonically_increasing_id().alias("_salt"), "_text").mapInArrow(emit, "_a long, _b long, _own long, _salt long, shard int, hi long, lo long")
    copies = F.ceil(F.col("hits") / most_probes).cast("long")
    busy = F.broadcast(index.where(F.col("hits") > most_probes).select("shard", copies.alias("_copies")))  # at most all hits / most_probes rows
    probes = probes.join(busy, "shard", "left").withColumn("copy", F.pmod("_salt", F.coalesce("_copies", F.lit(1))))
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    first = F.when(F.col("width").isNull(), 1).otherwise(0)
    both = arrays.select("shard", "copy", "width", *ARRAYS).unionByName(probes.select("shard", "copy", "hi", "lo", "_own", "_a", "_b"), allowMissingColumns=True)
    both = both.repartition(partitions(spark), "shard", "copy").withColumn("_turn", first).sortWithinPartitions("shard", "copy", "_turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            turn, shard_of = get("_turn").to_numpy(), get("shard").to_numpy()
            edges = np.flatnonzero(np.diff(shard_of) | (turn[1:] == 0) | (turn[:-1] == 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(turn)]):
                if turn[lo] == 0:
                    shard, at = Shard({a: get(a)[lo].as_py() for a in ("width", *ARRAYS)}), shard_of[lo]
                elif at == shard_of[lo]:  # else no common line has this shard
                    docs = shard.probe(*(get(c).slice(lo, hi - lo).to_numpy() for c in ("hi", "lo", "_own")))
                    met = pa.array(np.flatnonzero(docs) + lo)
                    yield pa.RecordBatch.from_arrays([*(get(c).take(met) for c in ("_a", "_b", "hi", "lo")), pa.array(docs[docs > 0])], names=["_a", "_b", "hi", "lo", "docs"])

    hits = both.mapInArrow(answer, "_a long, _b long, hi long, lo long, docs long")
    gone = hits.groupBy("_a", "_b").agg(F.collect_set(F.struct("hi", "lo", "docs")).alias("_gone"))  # one text's lines at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [{(g["hi"], g["lo"]): g["docs"] for g in x or ()} for x in batch.column(batch.schema.get_field_index("_gone")).to_pylist()]
            yield cut(batch, lambda at, halves: np.array([gone[i].get((a, b), 0) for i, (a, b) in zip(at.tolist(), halves.tolist())], dtype=np.int64))  # noqa: B023

    return rows.join(gone, ["_a", "_b"], "left").select(*passed, "_gone", "_text").mapInArrow(run, schema)


def drop_common_lines(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    least_chars: int = 40,
    least_docs: int = 5,
    texts: bool = False,
    keep: Sequence[str] = (),
    in_place: int = 64 << 20,
    shard_keys: int = 1 << 16,
    most_probes: int = 1 << 20,
) -> DataFrame:
    """key, ``keep``, n_lines, n_dropped, most_docs, kept_sha256 (and kept_text) of every row's text without its common lines.

    A text is split at newlines. A line's key is the line without blanks at its ends, A-Z in lower case. Keys of ``least_chars`` code points or more that
    stand in ``least_docs`` rows or more lose all their lines, except in the rows with the largest document key that holds them. ``most_docs`` is the largest number of
    rows that hold a dropped line, null if none was dropped.

    The keys' 128-bit hashes are counted by Spark; those found often enough are put into shards, each a minimal perfect hash with arrays of 64-bit fingerprints, counts and owners. Where
    all shards together have at most ``in_place`` bytes (measured), every task probes them for its own documents. Beyond that hashes, not texts, are sent to the shards'
    arrays in streams; the rows are the same.

    A null or empty text is one empty line. Null keys are smaller than all others; where no row has a key, all lines stay. Rows stand for themselves: equal rows count
    each. No rows: no rows.
    """
    spark = docs.sparkSession
    index = written(line_index(written(common_lines(docs, key, least_chars, least_docs), "common_lines"), shard_keys), "line_index")
    sized = index.agg(F.count("*"), F.sum(sum((F.octet_length(a) for a in ARRAYS), F.lit(0)).cast("long")), F.sum("n")).first()
    shards = max(1, -(-(sized[2] or 0) // shard_keys))
    rows = docs.select(F.col(key).alias("_key"), *(F.col(k).alias(f"_keep_{k}") for k in keep), _identity(key).alias("_own"), F.col("text").cast("binary").alias("_text"))
    passed = ["_key", *(f"_keep_{k}" for k in keep)]
    added = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "most_docs": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.binary()} if texts else {})
    kinds = {"n_lines": "long", "n_dropped": "long", "most_docs": "long", "kept_sha256": "string", "kept_text": "binary"}
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed), *(f"{a} {kinds[a]}" for a in added)])

    def cut(batch: pa.RecordBatch, judge: Callable) -> pa.RecordBatch:
        made = _cut(batch, least_chars, texts, judge)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *(pa.array(v, t) for v, t in zip(made, added.values()))], names=[*passed, *added])

    if (sized[1] or 0) <= in_place:
        out = _in_place(rows, index, shards, cut, schema, passed)
    else:
        out = _routed(rows, index, shards, least_chars, most_probes, cut, schema, passed)
    text = [F.col("kept_text").cast("string").alias("kept_text")] if texts else []
    return out.select(F.col("_key").alias(key), *(F.col(f"_keep_{k}").alias(k) for k in keep), "n_lines", "n_dropped", "most_docs", "kept_sha256", *text)
