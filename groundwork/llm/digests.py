"""Document fingerprints by improbable features: rare-entropy byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

WINDOW = 16
FILTER_BYTES, PER_FILTER, HASHES = 256, 160, 5
LEVELS = 256  # entropy is counted in so many steps from 0 to log2(window)
WEAK = 48  # windows under so many steps, such as runs of one character, are no features
_COUNT_BITS = np.array([0.0, *(c * np.log2(c) for c in range(1, 34))])
_GAIN = np.round(_COUNT_BITS * 4096).astype(np.int64)


def entropy_levels(data: bytes, window: int) -> np.ndarray:
    """Shannon entropy of every window of so many bytes, in LEVELS steps; exact integer sums, so equal windows have equal values anywhere.

    A window's sum of c*log2(c) over its byte counts changes with the byte that leaves and the one that enters; both
    counts come from the sorted places of each byte value.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    order = np.argsort(x, kind="stable")
    places = (x[order].astype(np.int64) << 40) + order
    at = np.arange(len(x))
    before = at - np.searchsorted(places, places - (window - 1), "left")
    after = np.searchsorted(places, places + (window - 1), "right") - at
    enter, leave = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    enter[order] = _GAIN[before + 1] - _GAIN[before]
    leave[order] = _GAIN[after] - _GAIN[after - 1]
    sums = np.cumsum(enter)[window - 1 :]
    sums[1:] -= np.cumsum(leave)[: len(sums) - 1]
    top = int(_GAIN[window])
    return (top - sums) * (LEVELS - 1) // top


def select(levels: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Windows that are the rarest (leftmost on ties) in at least a quarter of the neighbourhoods, of ``window`` windows each, they stand in."""
    n = len(levels)
    value = (rank[levels] << 32) + np.arange(n)
    width = 1
    while 2 * width <= min(window, n):
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    rarest = value & 0xFFFFFFFF
    counts = np.bincount(rarest, minlength=n)
    chosen = np.flatnonzero(counts >= min(window // 4, counts.max()))
    return chosen[levels[chosen] >= WEAK]


def _mixed(words: np.ndarray) -> np.ndarray:
    h = np.full(len(words), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class Digest:
    """Chained Bloom filters of a text's features, PER_FILTER features in each."""

    def __init__(self, data: bytes, ranks: np.ndarray, levels: np.ndarray | None = None):
        self.levels = levels
        if len(data) < WINDOW:
            hashed = _mixed(np.frombuffer(data.ljust(WINDOW, b"\0"), dtype="<u8").reshape(1, -1)) if data else np.array([], dtype=np.uint64)
        else:
            if levels is None:
                self.levels = entropy_levels(data, WINDOW)
            at = select(self.levels, ranks, WINDOW)
            at = at if len(at) else np.array([0])
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), WINDOW)[at]
            hashed = _mixed(np.ascontiguousarray(windows).view("<u8"))
        first = np.sort(np.unique(hashed, return_index=True)[1])
        hashed = hashed[first]
        n_filters = -(-len(hashed) // PER_FILTER)
        bits = np.zeros((n_filters, FILTER_BYTES * 8), dtype=np.uint8)
        number = np.arange(len(hashed)) // PER_FILTER
        for k in range(HASHES):
            bits[number, (hashed >> np.uint64(11 * k) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = 1
        self.filters = np.packbits(bits, axis=1).view("<u8") if n_filters else np.zeros((0, FILTER_BYTES // 8), dtype="<u8")
        self.ones = np.bitwise_count(self.filters).sum(axis=1, dtype=np.int64)

    def text(self) -> str:
        return base64.b64encode(self.filters.tobytes()).decode()

    def likeness(self, other: Digest) -> float:
        """Bits in common over what chance explains, of each filter with its best match in the longer digest, weighed by bits set (0 to 1)."""
        a, b = (self, other) if len(self.ones) <= len(other.ones) else (other, self)
        if not len(a.ones):
            return 1.0 if not len(b.ones) else 0.0
        total = 0.0
        for f, ones in zip(a.filters, a.ones):
            best = 0.0
            for lo in range(0, len(b.ones), 4096):
                common = np.bitwise_count(b.filters[lo : lo + 4096] & f).sum(axis=1, dtype=np.int64)
                chance = b.ones[lo : lo + 4096] * ones / (FILTER_BYTES * 8)
                room = np.maximum(np.minimum(b.ones[lo : lo + 4096], ones) - chance, 1e-9)
                best = max(best, float(((common - chance) / room).max()))
            total += min(1.0, best) * ones
        return float(total / a.ones.sum())


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level by how few windows of the whole corpus have it, rarest first: LEVELS sums, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                if len(data or b"") >= WINDOW:
                    sums += np.bincount(entropy_levels(data, WINDOW), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int64()), pa.array(sums, pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    counts[:WEAK] = np.iinfo(np.int64).max
    ranks = np.empty(LEVELS, dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return ranks


def next_in_order(docs: DataFrame, key: str) -> DataFrame:
    """Rows (_bucket, _tail, _key, _text), partitioned by _bucket and sorted so that each row's successor by descending key comes next.

    Keys of any type that has an order, ties and nulls by a hash of their text, are range-partitioned without the texts; each range's first (key, hash) reaches
    the driver and every task: one per range, whatever the number of rows. Then each document goes to its range, and a range's first document also
    to the range before it, as the tail (the very first to the last range). So texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    ranges = hashed.select("_key", "_hash").repartitionByRange(4 * partitions(spark), F.desc_nulls_last("_key"), "_hash")
    place = F.struct(F.col("_key").isNotNull().alias("some"), F.col("_key").alias("key"), F.bitwise_not("_hash").alias("back"))
    found = ranges.groupBy(F.spark_partition_id()).agg(F.max(place).alias("head")).collect()
    heads = sorted(tuple(r.head) for r in found)  # ascending: a row's range is that of the least head that is not below it

    @F.arrow_udf("bucket int, head boolean")
    def bucket(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        places = [(k is not None, k, ~h) for k, h in zip(keys.to_pylist(), hashes.to_pylist())]
        at = [bisect.bisect_left(heads, p) for p in places]
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array([heads[i] == p for i, p in zip(at, places)])], names=["bucket", "head"])

    rows = hashed.withColumn("_in", bucket("_key", "_hash"))
    own = F.struct(F.col("_in.bucket").alias("bucket"), F.lit(0).alias("tail"))
    tail = F.struct(F.pmod(F.col("_in.bucket") + 1, F.lit(max(1, len(heads)))).cast("int").alias("bucket"), F.lit(1).alias("tail"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_in.head"), F.array(own, tail)).otherwise(F.array(own))))
    rows = rows.select(F.col("_to.bucket").alias("_bucket"), F.col("_to.tail").alias("_tail"), "_key", "_text", "_hash")
    return rows.repartition(partitions(spark), "_bucket").sortWithinPartitions("_bucket", "_tail", F.desc_nulls_last("_key"), "_hash").drop("_hash")


def _edited(data: bytes, following: bytes) -> tuple[int, bytes, int]:
    """Code points of ``data``; its text with the last half of them replaced by as many first ones of ``following``; where that begins."""
    starts = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80)
    half = len(starts) // 2
    kept = data[: starts[len(starts) - half]] if half else data
    theirs = np.flatnonzero(np.frombuffer(following[: 4 * half + 4], dtype=np.uint8) & 0xC0 != 0x80)
    taken = following[: theirs[half]] if half < len(theirs) else following if half else b""
    return len(starts), kept + taken, len(kept)


def _edited_digest(edited: bytes, at: int, own: Digest, following: Digest, ranks: np.ndarray) -> Digest:
    """The digest of an edited text: windows inside either part have the levels they have there, and only those across the cut are computed."""
    if own.levels is None or following.levels is None or len(edited) < WINDOW:
        return Digest(edited, ranks)
    first, after = max(0, at - WINDOW + 1), max(0, len(edited) - at - WINDOW + 1)
    across = edited[first : min(len(edited), at + WINDOW - 1)]
    middle = entropy_levels(across, WINDOW) if len(across) >= WINDOW else own.levels[:0]
    return Digest(edited, ranks, np.concatenate((own.levels[:first], middle, following.levels[:after])))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and the likeness of the text to that and to the next document.

    A window's improbability is how few windows of all documents have its entropy (``rarity``); windows have 16 bytes in every text. The next document is
    that of the next smaller key (after the last: the first), ties in order of a hash of their text. Null text: empty; an empty text has an empty fingerprint, like
    only to another empty one. Texts shorter than a window are one feature. Null keys come last. No rows: no rows. Other columns are ignored.
    """
    ranks = rarity(docs)
    rows = next_in_order(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        previous = None  # (bucket, key, data, digest), until its successor is seen
        for batch in batches:
            kind = batch.column(2).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made: list[tuple] = []
                for bucket, tail, own, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).cast(pa.binary()).to_pylist()):
                    if previous is None and tail:
                        continue  # a further document with the head's key
                    digest = Digest(data, ranks)
                    if previous is not None:
                        n, edited, cut = _edited(previous[2], data)
                        mine = previous[3]
                        theirs = _edited_digest(edited, cut, mine, digest, ranks)
                        made.append((previous[1].as_py(), n, hashlib.sha256(edited).hexdigest(), mine.text(), theirs.text(), mine.likeness(theirs), mine.likeness(digest)))
                    previous = None if tail else (bucket, own, data, digest)
                if made:
                    types = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
