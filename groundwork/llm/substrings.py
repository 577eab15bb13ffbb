"""Removal of repeated byte strings: anchors bring equal strings into one shard, where a suffix array finds the earlier copy."""

from __future__ import annotations

import hashlib
import itertools
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions
from .suffixes import repeated_starts

GRAM, CHUNK, SHARD = 20, 1 << 18, 1 << 20
LARGE, BUCKETS = 8 << 20, 64  # bytes of one anchor's pieces from which they are split, and into how many files
PLACE = np.uint64((1 << 21) - 1)  # a chunk has fewer bytes
NO_KEY = -(1 << 63)
ROWS = 1 << 18  # rows looked at together: with 31 bits of a start and 13 of its run they fit a long


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by joining hashes of 1, 2, 4, 8 and 16 bytes."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    power, width, parts = 0x9E3779B97F4A7C15, 1, {1: h}
    while 2 * width <= GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, 2 * width
        parts[width] = h
    rest = GRAM - width
    h = h[: len(h) - rest] * np.uint64(0xA0761D6478BD642F) + parts[rest][width:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def anchor_runs(texts: list[bytes], length: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor, start, starts) of the runs of starts whose ``length``-byte strings share one anchor in one place.

    A string's anchor is the gram in it of least hash (by the upper 43 bits, leftmost on ties), so equal strings have equal anchors at
    equal places, wherever they stand. An anchor serves at most length - GRAM + 1 starts. Another ``turn`` orders grams otherwise.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.any():
        empty = np.array([], dtype=np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    grams = _gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    if turn:
        grams = (grams ^ np.uint64(turn)) * np.uint64(0x94D049BB133111EB)
    least = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    place, number = (least[at] & PLACE).astype(np.int64), np.repeat(np.arange(len(texts)), starts)
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (number[1:] != number[:-1]))))
    return number[head], grams[place[head]], at[head] - begin[number[head]], np.diff(np.append(head, len(at)))


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Segments of about CHUNK bytes in all: text numbers, offsets and bytes. A longer text is cut so that each start keeps its whole string in one segment."""
    number, offset, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            number.append(i)
            offset.append(at)
            held.append(t[at : at + CHUNK + length - 1])
            size += len(held[-1])
            if size >= CHUNK:
                yield number, offset, held
                number, offset, held, size = [], [], [], 0
    if held:
        yield number, offset, held


def _runs(texts: list[bytes], length: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor_runs`` of texts of any number and length."""
    parts = [anchor_runs([], length)]
    for numbers, offsets, segments in _chunks(texts, length):
        number, anchor, start, count = anchor_runs(segments, length, turn)
        parts.append((np.array(numbers)[number], anchor, start + np.array(offsets)[number], count))
    return tuple(np.concatenate(c) for c in zip(*parts))  # type: ignore[return-value]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def repeated_runs(rows: DataFrame, length: int) -> DataFrame:
    """(_id, at) for rows (_id, text): the runs whose anchor stands at least twice in the corpus; at is start * 2**13 + number of starts.

    An anchor that repeats inside an Arrow batch is known to repeat; of it one witness per batch goes to the count, so a
    group in that shuffle has at most one row per batch, however often its anchor stands.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            number, anchor, start, count = _runs(_texts(batch.column(1)), length)
            at, own = (start << 13) + count, ids[number]
            _, first, back, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = times[back] > 1
            witness = first[times > 1]
            key = np.where(known, own ^ (start >> 20), anchor.view(np.int64))  # known ones stay with their document, a megabyte of it at a time
            columns = [
                pa.array(np.concatenate((key, anchor.view(np.int64)[witness]))),
                pa.array(np.concatenate((known, np.zeros(len(witness), dtype=bool)))),
                pa.array(np.concatenate((own, own[witness]))),
                pa.array(np.concatenate((at, np.full(len(witness), -1)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "known", "_id", "at"])

    found = rows.mapInArrow(emit, "key long, known boolean, _id long, at long")
    twice = F.count("*").over(Window.partitionBy("key")) > 1
    return found.withColumn("_twice", twice).where((F.col("known") | F.col("_twice")) & (F.col("at") >= 0)).select("_id", "at")


PIECES = "anchor long, _doc long, twin long, start long, starts long, piece binary"


def shard_pieces(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of every repeated run, keyed by anchor. Of equal pieces in a batch the first is kept; the others are whole
    repeats, and go on as joined ranges (``starts`` holds the end, ``piece`` is null), spread by position."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            docs, twins, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))
            wanted = batch.column(3).to_pylist()
            found: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
            again: dict[tuple[int, int], list[tuple[int, int]]] = {}
            number, anchor, start, count = _runs(texts, length)
            asked = np.concatenate([np.empty(0, dtype=np.int64), *(np.array(w, dtype=np.int64) + (i << 44) for i, w in enumerate(wanted))])
            keep = np.isin((number << 44) + (start << 13) + count, asked)
            for i, m, s, n in zip(number[keep].tolist(), anchor.view(np.int64)[keep].tolist(), start[keep].tolist(), count[keep].tolist()):
                piece = texts[i][s : s + n + length - 1]
                place = (docs[i], twins[i], s, n)
                known = found.get((m, piece))
                if known is None:
                    found[m, piece] = place
                elif known[:3] != place[:3]:
                    found[m, piece] = min(known, place)
                    doc, twin, lo, k = max(known, place)
                    again.setdefault((doc, twin), []).append((lo, lo + k + length - 1))
            rows = [(hash((*own, lo)), *own, lo, hi, None) for own, ranges in again.items() for lo, hi in joined_ranges(ranges)]
            rows += [(m, *place, piece) for (m, piece), place in found.items()]
            for lo in range(0, len(rows), 20000):
                part = rows[lo : lo + 20000]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(zip(*part))], names=[f.split()[0] for f in PIECES.split(", ")])

    return joined.mapInArrow(emit, PIECES)


class Split:
    """Pieces of one anchor, cut anew by a second anchor and kept in files by it, so that equal strings meet in one file and each can be held."""

    def __init__(self, length: int):
        self.length, self.files = length, [tempfile.TemporaryFile() for _ in range(BUCKETS)]

    def add(self, rows: list[tuple]) -> None:
        number, anchor, start, count = _runs([r[5] for r in rows], self.length, turn=1)
        for i, m, s, n in zip(number.tolist(), anchor.tolist(), start.tolist(), count.tolist()):
            first, doc, twin, at, _, piece = rows[i]
            pickle.dump((first, doc, twin, at + s, n, piece[s : s + n + self.length - 1]), self.files[m % BUCKETS])

    def parts(self) -> Iterator[Iterator[tuple]]:
        for f in self.files:
            if f.tell():
                f.seek(0)
                yield self._rows(f)
            f.close()

    @staticmethod
    def _rows(f: IO[bytes]) -> Iterator[tuple]:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def sort_shards(pieces: DataFrame, length: int, budget: int, large: int = LARGE) -> DataFrame:
    """(_doc, twin, lo, hi): byte ranges covered by a string that starts earlier. ``pieces`` come sorted by anchor, piece and position.

    Of equal pieces only the first is sorted, as a stream, so copies cost no memory. An anchor with one distinct piece has nothing to sort:
    strings in one piece have the anchor at different places in themselves, so no two are equal. Pieces are gathered up to SHARD bytes, a
    shard ends where an anchor does; its suffix queues spill to disk past ``budget`` bytes. An anchor with over ``large`` bytes of distinct pieces
    goes to files by a second anchor (``Split``), which are sorted one by one.
    """

    def settle(rows: Iterable[tuple]) -> Iterator[tuple]:
        places: list[tuple] = []  # three numbers a piece

        def pieces() -> Iterator[tuple[bytes, int, tuple]]:
            for _, doc, twin, start, n, piece in rows:
                places.append((doc, twin, start))
                yield piece, n, places[-1]

        for i, mine in repeated_starts(pieces(), length, budget):
            doc, twin, start = places[i]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            yield from ((doc, twin, start + int(a), start + int(b) + length - 1) for a, b in zip(edge[::2], edge[1::2]))

    def finish(held: list[tuple], split: Split | None) -> Iterator[tuple]:
        if split is None:
            if held:
                yield from settle(held)
            return
        if held:
            split.add(held)
        for part in split.parts():
            yield from settle(part)

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size, split, last, lone = [], 0, None, (None, None, None), None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, doc, twin, start, n, piece = row
                if piece is None:
                    yield doc, twin, start, n
                    continue
                if (anchor, piece) == last[:2]:
                    if last[2] != (doc, twin, start):
                        yield doc, twin, start, start + n + length - 1
                    continue
                if anchor != last[0]:
                    lone = row
                    if split or size >= SHARD:
                        yield from finish(held, split)
                        held, size, split = [], 0, None
                else:
                    for r in (lone, row) if lone else (row,):
                        held.append(r)
                        size += len(r[5]) + 1
                    lone = None
                    if size >= large:
                        split = split or Split(length)
                        split.add(held)
                        held, size = [], 0
                last = (anchor, piece, (doc, twin, start))
        yield from finish(held, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = covered(batches)
        while made := list(itertools.islice(ranges, 20000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=["_doc", "twin", "lo", "hi"])

    return pieces.mapInArrow(run, "_doc long, twin long, lo long, hi long")


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data`` without these ranges, and how many maximal runs they make."""
    left, at, spans = [], 0, joined_ranges(ranges)
    for lo, hi in spans:
        left.append(data[at:lo])
        at = hi
    left.append(data[at:])
    return b"".join(left), len(spans)


def remove_repeats(docs: DataFrame, *, length: int = 100, key: str = "doc_id", budget: int = 8 << 20, large: int = LARGE, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes from every whole text, as UTF-8 bytes, each byte covered by a ``length``-byte string that also starts earlier: at a smaller key,
    or in the same document before.

    1. Runs of starts with one anchor are found (``anchor_runs``); those whose anchor stands only once in the corpus can hold no repeat. 2. The
    pieces of the others are sent to shards by anchor, so that all places of one string meet. 3. Every shard is suffix-sorted by
    induction (``suffixes``), neighbours that share ``length`` bytes form groups, and all but the earliest start of a group are repeats. 4.
    The ranges are cut out of the documents. Texts are shuffled once: both joins use one exchange.

    ``key`` must cast to long. Null text: empty. Null keys come first. Rows are joined by a hash of key and text, so that many rows with one key cost no more than others; they
    are ordered by it, and equal rows count as one document and get equal results. Texts under ``length`` bytes stay whole. Returns key, n_bytes, n_removed, n_spans,
    kept_sha256, ``keep`` columns and, with ``texts``, kept_text (bytes of characters cut in two are left out). No rows: no rows. Other columns are ignored.
    """
    kind = docs.schema[key].dataType
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    rows = rows.withColumn("_id", F.xxhash64("_doc", "_text"))
    also = [f"_keep_{c}" for c in keep]
    runs = repeated_runs(rows.select("_id", "_text"), length).groupBy("_id").agg(F.collect_set("at").alias("_runs"))
    joined = rows.join(runs, "_id").select("_doc", "_id", "_text", "_runs")
    pieces = shard_pieces(joined, length).repartition(n, "anchor").sortWithinPartitions("anchor", "piece", "_doc", "twin", "start")
    ranges = sort_shards(pieces, length, budget, large)
    ranges = ranges.groupBy(F.col("twin").alias("_id")).agg(F.collect_set(F.struct("_doc", "lo", "hi")).alias("_ranges"))
    marked = rows.join(ranges, "_id", "left").select("_doc", "_text", "_ranges", *also)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ranges = batch.column(2)
            for i, (doc, data) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(1)))):
                mine = ranges[i].as_py()
                mine = [(r["lo"], r["hi"]) for r in mine if r["_doc"] == doc] if mine else []
                left, spans = cut(data, mine) if mine else (data, 0)
                row = (doc, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
                out.append((*row, left.decode("utf-8", "ignore")) if texts else row)
            types = [pa.int64()] * 4 + [pa.string()] * (1 + texts)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)), *batch.columns[3:]], names=[*names, *also])

    names = ["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * texts]
    schema = "_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    schema += "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in also)
    out = marked.mapInArrow(finish, schema)
    own = F.when(F.col("_doc") != NO_KEY, F.col("_doc")).cast(kind)
    return out.select(own.alias(key), *names[1:], *(F.col(f"_keep_{c}").alias(c) for c in keep))
