"""SimHash near-duplicates: a generalised pigeonhole search and its connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, joined_by_size, partitions, written

SEED, BITS, SHINGLE = 42, 64, 3
#: Words of a signature that are compared, and the share of their bits in which texts of similarity 0.8 may differ: 0.1515 is expected, and one deviation of 256 bits added.
COMPARED, DIFFER = 4, 0.175
_STEPS = np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def signature(text: bytes | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """Majority bits of the hashes of all shingles, repeats included: 64 of XXH64, then as many more of every further word, whose hashes are mixed from it (no words: 0)."""
    split = (text or b"").lower().split()
    if not split:
        return np.zeros(words, dtype=np.uint64)
    joined = map(b" ".join, zip(*(split[i:] for i in range(shingle)))) if len(split) >= shingle else [b" ".join(split)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), dtype=np.uint64)
    n, ones = len(hashed), np.zeros(BITS * words, dtype=np.int64)
    for at in range(0, n, 240):  # so that counts of a part fit a byte
        part = hashed[at : at + 240, None]
        if words > 1:
            more = (part ^ _STEPS[: words - 1]) * np.uint64(0xBF58476D1CE4E5B9)
            more = (more ^ more >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            part = np.concatenate((part, more ^ more >> np.uint64(32)), axis=1)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).view(">u8").astype(np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the XXH64 of all 3-word shingles, repeats included (no words: 0)."""
    return int(signature(text)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """Key, ``keep`` and the signature as signed longs: ``fp`` for one word, else fp0, fp1, ..."""
    names = ["fp"] if words == 1 else [f"fp{i}" for i in range(words)]
    rows = docs.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_keep_{c}") for c in keep), F.col("text").alias("_text"))

    def compute(texts: list) -> dict[str, list]:
        made = np.stack([signature(t, shingle, words) for t in texts]).view(np.int64) if texts else np.zeros((0, words), dtype=np.int64)
        return dict(zip(names, made.T))

    out = appended(rows, "_text", compute, ", ".join(f"{n} bigint" for n in names), binary=True)
    return out.select(F.col("_key").alias(key), *(F.col(f"_keep_{c}").alias(c) for c in keep), *names)


def correlated_groups(together: np.ndarray, ones: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Splits the bits into groups of near-equal width, joining each bit to the group it is most correlated with.

    What a key tells apart is shared out that way: bits that repeat one another stand in one group and spoil one key only.
    """
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        width = -(-len(left) // (groups - g))
        chosen = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(axis=1))))]
        while len(chosen) < width:
            chosen.append(left.pop(int(np.argmax(corr[np.ix_(left, chosen)].sum(axis=1)))))
        out.append(sorted(chosen))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds, one per partition and at least -1, that sum to ``total`` at the least cost; costs[i][t + 1] is threshold t's."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                if done + t not in step or cost + more < step[done + t][0]:
                    step[done + t] = (cost + more, [*chosen, t])
        best = step
    return best[total][1]


def flips(bits: list[int], distance: int) -> list[int]:
    """Masks of at most ``distance`` of these bits."""
    masks = [0]
    if distance >= 1:
        masks += [1 << b for b in bits]
    if distance >= 2:
        masks += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
    return masks


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def bit_statistics(fps: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each pair of a word's bits is set together over all fingerprints: 64 x 64 sums a word, whatever their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((len(names), BITS, BITS)), 0
        for batch in batches:
            for sum_, column in zip(sums, batch.columns):
                values = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                bits = (values[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
                sum_ += bits.T @ bits
            n += batch.num_rows
        cells = np.append(sums.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int64()), pa.array(cells, pa.int64())], names=["cell", "n"])

    found = fps.select(*names).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(len(names) * BITS * BITS + 1)
    cells[found.column(0).to_numpy()] = found.column(1).to_numpy()
    together = cells[:-1].reshape(len(names), BITS, BITS)
    return together, np.diagonal(together, axis1=1, axis2=2).copy(), int(cells[-1])


def plan(fps: DataFrame, distance: int, groups: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition. Thresholds sum to distance - groups + 1, the generalised pigeonhole bound.

    The candidates of a threshold are estimated from the whole table: the sum over key values of their squared counts for threshold 0;
    a wider threshold multiplies that by its number of flipped keys, which are also probes to pay for.
    """
    together, ones, n = bit_statistics(fps, ["fp"])
    parts = correlated_groups(together[0], ones[0], n, groups)
    costs = []
    for bits in parts:
        mask = signed(sum(1 << b for b in bits))
        pairs = fps.groupBy(F.col("fp").bitwiseAND(mask)).count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0.0
        costs.append([0.0, *((pairs + n) * len(flips(bits, t)) for t in range(distance + 1))])
    return list(zip(parts, allocate(costs, distance - groups + 1)))


def spanning_links(keys: np.ndarray, values: np.ndarray, distance: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) whose links connect what the pairs of one key within ``distance`` bits connect, for rows sorted by key; ``values`` has a column per word.

    Pairs are verified by XOR and bit count: in keys of up to 64 rows by comparing each row with those after it, all keys at a time; in larger
    ones in blocks. Joining labels leaves fewer links than rows.
    """
    label = np.arange(len(keys))
    if not len(keys):
        return label, label

    def join(i: np.ndarray, j: np.ndarray) -> None:  # joins the labels of linked rows until none differ
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label[:] = label[label]

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in values.T)

    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(cuts, len(keys)))
    left = np.repeat(cuts + sizes, sizes) - np.arange(len(keys)) - 1  # rows of the key after this one
    left[np.repeat(sizes, sizes) > 64] = 0
    near, i, shift = [], np.flatnonzero(left > 0), 1
    while len(i):
        near.append(i[apart(i, i + shift) <= distance])
        near[-1] = np.stack((near[-1], near[-1] + shift))
        shift += 1
        i = i[left[i] >= shift]
    if near:
        join(*np.concatenate(near, axis=1))
    for lo, n in zip(cuts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        step = max(1, most // n)
        for at in range(lo, lo + n, step):
            mine = np.arange(at, min(at + step, lo + n))
            i, j = np.nonzero(apart(mine[:, None], np.arange(at, lo + n)[None, :]) <= distance)
            join(i[i < j] + at, j[i < j] + at)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return label[linked], linked


def verified(met: DataFrame, words: list[str], distance: int) -> DataFrame:
    """Links (a, b) between the first words of rows (key, words) that share a key and differ in at most ``distance`` bits: a spanning set of each key's."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, *columns = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("key", *words))
            a, b = spanning_links(key, np.stack(columns, axis=1).view(np.uint64), distance)
            other = columns[0][a] != columns[0][b]
            return pa.RecordBatch.from_arrays([pa.array(columns[0][a[other]]), pa.array(columns[0][b[other]])], names=["a", "b"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            first = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            held.append(batch.slice(0, first))
            if first:
                yield flush(held)
                held = []
            held.append(batch.slice(first))
        if held:
            yield flush(held)

    grouped = met.select("key", *words).repartition(partitions(met.sparkSession), "key").sortWithinPartitions("key")
    return grouped.mapInArrow(verify, "a long, b long")


def in_blocks(met: DataFrame, counts: DataFrame, crowd: int) -> DataFrame:
    """Rows (key, ...) with the keys of over ``crowd`` rows cut into pairs of blocks: a row goes to its block's pair with every block, so every two
    rows of the key still meet, and no key has over some 2 * ``crowd`` rows. ``counts`` has key and _n; the row's word ``fp`` chooses its block."""
    crowded = counts.where(F.col("_n") > crowd).select("key", F.ceil(F.col("_n") / crowd).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("_blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
    split = met.join(crowded, "key", "left").withColumn("_to", F.explode(F.when(F.col("_blocks").isNull(), F.array("key")).otherwise(pairs)))
    return split.select(F.col("_to").alias("key"), *(c for c in met.columns if c != "key"))


def links(fps: DataFrame, *, distance: int = 2, groups: int = 3, crowd: int = 20000) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``distance`` bits apart, enough to connect what all of them connect.

    Every fingerprint is sent to its key in each partition, and as a probe to the keys within the partition's threshold. Keys with over ``crowd`` rows are
    split by a second pigeonhole: what remains differs in at most ``distance`` bits, so it agrees on one of distance + 1 parts
    of the other bits, whose values join the key; keys that are still as large are cut into pairs of blocks (``in_blocks``). Neither loses a pair. A key's rows are verified inside
    one task, and only a spanning set of links leaves it.
    """
    variants = []
    for number, (bits, threshold) in enumerate(plan(fps, distance, groups)):
        if threshold < 0:
            continue
        mask, rest = signed(sum(1 << b for b in bits)), [b for b in range(BITS) if b not in bits]
        cut = -(-len(rest) // (distance + 1))
        subs = [signed(sum(1 << b for b in rest[i : i + cut])) for i in range(0, len(rest), cut)]
        probes = F.explode(F.array(*(F.lit(signed(m)) for m in flips(bits, threshold))))
        sent = fps.select(F.lit(number).alias("part"), "fp", probes.alias("_flip"))
        variants.append(
            sent.select("part", F.col("fp").bitwiseAND(mask).bitwiseXOR(F.col("_flip")).alias("value"), "fp", F.array(*(F.col("fp").bitwiseAND(s) for s in subs)).alias("subs"))
        )
    sent = reduce(DataFrame.unionByName, variants)
    counts = sent.groupBy("part", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    met = sent.join(counts, ["part", "value"])
    salted = F.when(F.col("_n") > crowd, F.transform("subs", lambda s, i: F.xxhash64(i, s))).otherwise(F.array(F.lit(0).cast("long")))
    met = met.select("fp", "_n", F.xxhash64("part", "value").alias("_key"), F.explode(salted).alias("_salt"))
    met = met.select("fp", "_n", F.xxhash64("_key", "_salt").alias("key"))
    counts = met.where(F.col("_n") > crowd).groupBy("key").agg(F.count("*").alias("_n"))
    return verified(in_blocks(met.select("key", "fp"), counts, crowd), ["fp"], distance)


def similar_links(sigs: DataFrame, words: int, groups: int, parts: int, *, differ: float = DIFFER, crowd: int = 20000) -> DataFrame:
    """Links (a, b) between distinct signatures of ``words`` words fp0, fp1, ... whose first words differ in at most ``differ`` of their bits; a and b are fp0.

    Each word's bits are grouped by correlation into ``groups`` partitions. Over all, thresholds that sum to zero are allocated by cost, so every pair within
    ``parts`` - 1 bits is found for sure, and of those farther apart the share that ``parts_for`` reckons with. Crowded keys are cut into pairs of blocks.
    """
    names, spark = [f"fp{i}" for i in range(words)], sigs.sparkSession
    together, ones, n = bit_statistics(sigs, names)
    split = [(w, bits) for w in range(words) for bits in correlated_groups(together[w], ones[w], n, groups)][:parts]
    masked = lambda w, bits: F.col(names[w]).bitwiseAND(signed(sum(1 << b for b in bits)))
    keyed = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), masked(w, bits).alias("value")) for i, (w, bits) in enumerate(split)))).alias("_at")
    counts = written(sigs.select(keyed).select("_at.*").groupBy("part", "value").agg(F.count("*").alias("_n")), "counts")
    pairs = {r.part: r.pairs for r in counts.groupBy("part").agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2).alias("pairs")).collect()}
    costs = [[0.0, pairs.get(i, 0.0) + n, (pairs.get(i, 0.0) + n) * (1 + len(bits))] for i, (_, bits) in enumerate(split)]
    sent = []
    for i, ((w, bits), threshold) in enumerate(zip(split, allocate(costs, 0))):
        for flip in flips(bits, threshold) if threshold >= 0 else []:
            sent.append(F.xxhash64(F.lit(i), masked(w, bits).bitwiseXOR(F.lit(signed(flip)))))
    compared = names[:COMPARED]
    met = sigs.select(F.explode(F.array(*sent)).alias("key"), F.col("fp0").alias("fp"), *compared[1:])
    crowded = counts.where(F.col("_n") > crowd // 2).select(F.xxhash64("part", "value").alias("key"), (2 * F.col("_n")).alias("_n"))  # probes may double a key
    met = in_blocks(met, crowded, crowd)
    return verified(met, ["fp", *compared[1:]], int(differ * BITS * min(words, COMPARED)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (a, b) but the smallest of its component, by alternating large and small stars.

    Each turn is two shuffles of the edges and is written to the shared folder. The turns end when a turn changes nothing.
    """
    e = written(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(small.where("a <> b").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        before = now


def near_duplicates(docs: DataFrame, *, distance: int = 2, groups: int = 3, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, ``keep``, fingerprint (16 hex digits) and component_id: the smallest key reachable over links of at most ``distance`` bits.

    Documents with one fingerprint form a class; only classes are searched, and a class's size never matters. Null or empty
    text: fingerprint zero, linked like any other. Null keys take part, but a component's id is its smallest non-null key (null if it has
    none). Repeated rows are each returned. No rows: no rows. Other columns are ignored.
    """
    rows = written(fingerprints(docs, key, keep), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min(key).alias("_least")), "classes")
    edges = links(classes, distance=distance, groups=groups)
    labels = components(edges)
    return rows.join(_of_classes(classes, labels, "fp"), "fp").select(key, *keep, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def parts_for(n: int, similarity: float = 0.8, missed: float = 0.025) -> tuple[int, int]:
    """(partitions to a word, partitions in all) for ``n`` signatures.

    A partition is about as wide as log2(n), so that few unrelated signatures share a value at any size. Shingle sets of this similarity have
    cosine c = 2s / (1 + s), each bit differs with the chance arccos(c) / pi, and so many partitions leave a pair without
    a common value in ``missed`` of all cases.
    """
    groups = min(5, max(1, round(BITS / max(2.0, np.log2(max(n, 2)) - 1))))
    agree = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** -(-BITS // groups)
    return groups, int(np.ceil(np.log(missed) / np.log(1 - agree)))


def near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Key and component_id: the smallest key reachable over texts that are alike in ``similarity`` of their ``shingle``-word shingles, by signatures.

    A signature has as many words as the partitions need (``parts_for``), of which the first 256 bits decide: texts of similarity 0.8 differ in 15 % of them, and up to
    17.5 % are a link. Documents with one signature form a class; only classes are searched. Null or empty text: signature zero. Null keys take part, but a
    component's id is its smallest non-null key (null if it has none). Repeated rows are each returned. No rows: no rows. Other columns are ignored.
    """
    groups, parts = parts_for(docs.count(), similarity)
    words = max(COMPARED, -(-parts // groups))
    rows = written(fingerprints(docs, key, (), shingle, words), "signatures")
    names = [f"fp{i}" for i in range(words)]
    sigs = written(rows.groupBy(*names).agg(F.min(key).alias("_least")), "classes")
    of_class = _of_classes(sigs, components(similar_links(sigs, words, groups, parts)), "fp0")
    return rows.select(key, F.col("fp0").alias("fp")).join(of_class, "fp").select(key, "component_id")


def _of_classes(classes: DataFrame, labels: DataFrame, word: str) -> DataFrame:
    """(fp, component_id) of every class's first word: classes with equal ones are one, and the least key of all with a label is its id."""
    of_class = classes.groupBy(F.col(word).alias("fp")).agg(F.min("_least").alias("_least"))
    of_class = of_class.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("label", "fp").alias("label"))
    of_class = written(of_class, "labelled")
    heads = of_class.groupBy("label").agg(F.min("_least").alias("component_id"), F.count("*").alias("_n"))
    return joined_by_size(of_class, heads, ["label"], "_n", of_class.count()).select("fp", "component_id")


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))
