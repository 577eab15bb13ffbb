"""Phrase collocations by partitioned mining: shards mined at their share of the support, then all candidates counted everywhere."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes as they are read: A-Z in lower case, every mark that ends a piece as a newline, tabs as blanks.
READ = bytes(0x0A if chr(b) in ".,;:!?\n\v\f\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = b"S"  # between pieces: no word has a capital letter
PART, HELD = 4 << 20, 64 << 20  # bytes of text in a row of the encoded table, and in all rows that a task has open
GROUP = 1 << 20  # words of the input for each bucket of counts
FEW = 100_000  # rows that may be sent to every task
STEP = np.uint64(0x9E3779B97F4A7C15)
ENCODED = "lang string, shard int, n_words long, codes binary, words binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def encoded(docs: DataFrame, lang: str, shards: int) -> DataFrame:
    """Texts as rows of word numbers (0 between pieces) with the words they stand for, by language and shard (a hash of the text)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), F.col("text").cast("binary").alias("text"))

    def pack(lang: str, shard: int, texts: list[bytes]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        numbers[END]
        tokens = b"\n".join(texts).translate(READ).replace(b"\n", b" " + END + b" ").split()
        codes = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        row = [lang, shard, int(np.count_nonzero(codes)), codes.tobytes(), b" ".join(list(numbers)[1:])]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "shard", "n_words", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = defaultdict(list)
        size: dict[tuple[str, int], int] = defaultdict(int)
        for batch in batches:
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if not text:
                    continue
                held[key].append(text)
                size[key] += len(text)
                if size[key] >= PART or sum(size.values()) >= HELD:
                    full = max(size, key=size.get)
                    yield pack(*full, held.pop(full))
                    del size[full]
        for key, texts in held.items():
            yield pack(*key, texts)

    return rows.mapInArrow(run, ENCODED)


class Grams:
    """The phrases of one encoded row: their hashes by length, and which of them may be frequent in a shard."""

    def __init__(self, lang: str, codes: bytes, words: bytes):
        self.codes, self.words = np.frombuffer(codes, dtype=np.int32), [END, *words.split(b" ")] if words else [END]
        self.base = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], dtype=np.uint64)[self.codes]
        self.inside, self.lang = self.codes != 0, xxhash.xxh3_64_intdigest(lang.encode())

    def hashes(self, k: int) -> np.ndarray:
        """Of the phrase of k words at each place."""
        out = self.base
        for i in range(1, k):
            out = out[:-1] * STEP + self.base[i:]
        return out

    def keys(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        """Of a phrase in a language and shard."""
        return _mixed(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(b"%d" % shard, self.lang)))

    def whole(self, k: int) -> np.ndarray:
        """Places where k words stand within a piece."""
        out = self.inside
        for _ in range(1, k):
            out = out[:-1] & self.inside[len(self.inside) - len(out) + 1 :]
        return out

    def possible(self, k: int, shard: int, below: np.ndarray | None) -> np.ndarray:
        """Places of phrases of k words both of whose parts of k - 1 words may be frequent in the shard."""
        if len(self.codes) < k:
            return np.zeros(0, dtype=np.int64)
        if k == 1:
            return np.flatnonzero(self.inside)
        at = np.flatnonzero(self.whole(k - 1))
        held = np.zeros(len(self.codes) - k + 2, dtype=bool)
        held[at] = _in(below, self.keys(self.hashes(k - 1)[at], shard))
        return np.flatnonzero(held[:-1] & held[1:] & self.whole(k))


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent(rows: DataFrame, k: int, below: np.ndarray | None, bucket_bits: int, filter_bits: int) -> np.ndarray:
    """Bits of the phrases of k words that reach their shard's support. ``rows``: the encoded table with ``support``; ``below``: the bits of k - 1 words.

    Each row's phrases are counted where they are; keys and counts go to buckets by the key's first bits, and each bucket gives its slice of the bits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = shared.value
        for batch in batches:
            for lang, shard, support, codes, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                grams = Grams(lang, codes, words)
                at = grams.possible(k, shard, below)
                keys, counts = np.unique(grams.keys(grams.hashes(k)[at], shard), return_counts=True)
                bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), dtype=np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                spans = list(zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]))
                blobs = [[v[a:b].tobytes() for a, b in spans] for v in (keys, counts.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges].astype(np.int32)), pa.array([support] * len(spans), pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "support", "keys", "counts"]
                )

    def reduced(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint32).astype(np.int64)
        support = np.repeat(table.column("support").to_numpy(), [len(x) // 8 for x in table.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - np.uint64(1)))
        often = np.add.reduceat(counts[order], first) >= support[order[first]]
        slice_bits = filter_bits - bucket_bits
        at = (keys[order[first]][often] >> np.uint64(64 - filter_bits)) & np.uint64((1 << slice_bits) - 1)
        bits = np.zeros(1 << slice_bits, dtype=bool)
        bits[at] = True
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["bucket", "bits"])

    sent = rows.select("lang", "shard", "support", "codes", "words").mapInArrow(run, "bucket int, support long, keys binary, counts binary")
    slices = sent.groupBy("bucket").applyInArrow(reduced, "bucket int, bits binary").collect()  # 2 ** filter_bits bits in all
    out, each = np.zeros(1 << (filter_bits - 3), dtype=np.uint8), 1 << (filter_bits - bucket_bits - 3)
    for s in slices:
        out[s.bucket * each : (s.bucket + 1) * each] = np.frombuffer(s.bits, dtype=np.uint8)
    return out


def _counted(rows: DataFrame, frequent: list[np.ndarray], shards: int) -> DataFrame:
    """(lang, phrase, k, f): exact counts of all phrases that are frequent in any shard, over all shards."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for lang, codes, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams = Grams(lang, codes, words)
                for k in range(1, len(frequent) + 1):
                    at = np.flatnonzero(grams.whole(k)) if len(grams.codes) >= k else np.zeros(0, dtype=np.int64)
                    hashes, first, counts = np.unique(grams.hashes(k)[at], return_index=True, return_counts=True)
                    held = np.zeros(len(hashes), dtype=bool)
                    for s in range(shards):
                        held |= _in(frequent[k - 1], grams.keys(hashes, s))
                    places = at[first[held]]
                    spelled = [b" ".join([grams.words[c] for c in own]) for own in grams.codes[np.add.outer(places, np.arange(k))].tolist()]
                    n = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(spelled, pa.binary()), pa.array(np.full(n, k, dtype=np.int32)), pa.array(counts[held])], names=["lang", "phrase", "k", "f"])

    found = rows.select("lang", "codes", "words").mapInArrow(run, "lang string, phrase binary, k int, f long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "k").agg(F.sum("f").alias("f"))


def mine_phrases(docs: DataFrame, *, lang: str = "lang", support: int = 100, longest: int = 5, top: int | None = 2000, shards: int = 4, contained_percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language, the best first; at most ``top`` of a language, all if None.

    Texts are cut at the marks .,;:!? and line ends into pieces, and these at blanks and tabs into words, A-Z in lower case. n counts a language's words, f a phrase's places within pieces.
    Phrases of 2 to ``longest`` words with a = f(phrase) >= ``support`` are scored by floor(1000 * a * n / (l * r)) at the cut into two parts (l, r: their f) that scores lowest, the earliest of those.
    A phrase inside a longer one that is also frequent is left out if 100 * f(longer) >= ``contained_percent`` * a. Order: score and a descending, then phrase by its bytes.

    Texts are dealt to ``shards`` by their hash. A shard with a share of a language's words is mined completely, by length, for phrases with that share of the support: a phrase that reaches
    the support reaches its share in some shard. A shard is as large as the corpus makes it; its phrases are counted by Spark over many tasks, and those with a part that is not frequent in the shard are not looked at. What is frequent in any shard is then counted in all of them.
    Between the steps go bits of fixed number (at most 2^28 a length); two phrases on one bit only cost a count, and the last counts are by the phrase itself. Inside a row of 4 MB of text phrases are told apart by 64 bits.

    Null text: no words. Null lang: ``und``. Rows stand for themselves. A language without a frequent phrase has no row; no rows: no rows.
    """
    table = written(encoded(docs, lang, shards), "encoded")
    parts = table.groupBy("lang", "shard").agg(F.sum("n_words").alias("part"))
    totals = parts.groupBy("lang").agg(F.sum("part").alias("n"))
    shares = parts.join(totals, "lang").where("n > 0").selectExpr("lang", "shard", f"(cast({support} as decimal(19,0)) * part + n - 1) div n as support")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bucket_bits = min(20, max(0, (words // GROUP).bit_length()))
    filter_bits = min(28, max(16, (words // 16).bit_length(), bucket_bits + 3))
    shares = written(shares, "shares")
    few = shares.count() <= FEW  # a row for each language and shard
    rows, frequent = table.join(F.broadcast(shares) if few else shares, ["lang", "shard"]), []
    for k in range(1, longest + 1):
        frequent.append(_frequent(rows, k, frequent[-1] if frequent else None, bucket_bits, filter_bits))
    counts = written(_counted(table, frequent, shards).where(F.col("f") >= support), "phrases")

    own = counts.where("k >= 2").withColumn("w", F.split("phrase", " "))
    cuts = own.select("lang", "phrase", "k", "f", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "f", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 * f as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))

    spans = own.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k"))).alias("size")).where("size < k")
    inner = spans.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    longer = inner.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < contained_percent * F.col("f"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = kept.select("lang", "phrase", F.col("f").alias("a"), "b.l", "b.r", "n", "b.score").withColumn("rank", rank.cast("long"))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
