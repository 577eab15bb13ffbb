"""Mixture-controlled packing: deficit round-robin over source queues, which any partition takes up where the ones before it end."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, written

END_ID = 0
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # a fixed value of the vocabulary
UNIT = 1 << 16  # quanta and deficits are counted in 65536ths of a token


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of byte_bpe_50k.json from its file of ranks: the same ids, several times as fast (tests hold both together)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokens(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text, in which the vocabulary's special token is one id, then the end id; as uint16 (the vocabulary has under 65,536 ids)."""
    return np.append(encoder(path).encode_to_numpy(text or "", allowed_special="all").astype(np.uint16), np.uint16(END_ID))


def tokenized(rows: DataFrame, path: str) -> DataFrame:
    """Written table: _key, _queue (the number of its source), doc_tokens, _ids, and where the row's tokens start among those of its source in its task (_task, _start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, filled = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                queues, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                ids = [tokens(t, path) for t in texts]
                starts = []
                for q, x in zip(queues, ids):
                    starts.append(filled.get(q, 0))
                    filled[q] = starts[-1] + len(x)
                made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["_key", "_queue", "doc_tokens", "_ids", "_task", "_start"])

    kind = rows.schema["_key"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"_key {kind}, _queue int, doc_tokens long, _ids binary, _task int, _start long"), "tokens")


def quanta(weights: np.ndarray, width: float) -> np.ndarray:
    """What each queue's deficit gains in a round: its share of ``width`` tokens, in UNITs, at least one."""
    return np.maximum(np.rint(weights / weights.sum() * (width * UNIT)).astype(np.int64), 1)


def opening(queues: int) -> np.ndarray:
    """The queues' deficits before the first round: different parts of a token, half of one on average, so that they don't all round up in the same round."""
    return (2 * np.arange(queues) + 1) * UNIT // (2 * queues)


def served(rounds: np.ndarray, totals: np.ndarray, quantum: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Tokens that each queue has been served in all of the first so many rounds: one row per entry of ``rounds``.

    In a round, every queue in turn gains its quantum, is served the whole tokens of its deficit, and keeps the rest of the deficit for the next round; an
    emptied queue is passed over. So after r rounds a queue has had the whole tokens of its opening deficit and r quanta, and its deficit is what
    they are over that: a window or a partition takes both up from the tokens before it.
    """
    return np.minimum((rounds[:, None] * quantum[None, :] + opening[None, :]) // UNIT, totals[None, :])


def dealt(queue: int, lo: np.ndarray, hi: np.ndarray, totals: np.ndarray, quantum: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Where round-robin puts the tokens lo to hi of a queue: (which range, first token, end, place in the order of service), one row per range and round.

    Ranges ascend and don't overlap; the token before a range has carried the queue to that range's first round and deficit.
    """
    early = opening(len(totals))
    round_of = lambda token: -((early[queue] - (token + 1) * UNIT) // quantum[queue])  # from 1
    if quantum[queue] >= UNIT:  # every round from the first token's to the last one's serves some
        which, turn = _counted(round_of(lo), round_of(hi - 1) + 1)
    else:  # a round serves one token at most
        which, turn = _counted(lo, hi)
        turn = round_of(turn)
    turns, back = np.unique(turn, return_inverse=True)
    begin, place = np.empty(len(turns), dtype=np.int64), np.empty(len(turns), dtype=np.int64)
    step = max(1, block // len(totals))
    for at in range(0, len(turns), step):
        part = turns[at : at + step]
        before = served(part - 1, totals, quantum, early)
        begin[at : at + step] = before[:, queue]
        place[at : at + step] = before[:, queue:].sum(axis=1) + served(part, totals[:queue], quantum[:queue], early[:queue]).sum(axis=1)
    a = np.maximum(begin[back], lo[which])
    b = np.minimum(served(turn, totals[queue : queue + 1], quantum[queue : queue + 1], early[queue : queue + 1])[:, 0], hi[which])
    return which, a, b, place[back] + a - begin[back]


def _counted(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers of the ranges lo to hi."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return which, np.arange(len(which)) - (np.cumsum(count) - count - lo)[which]


def pieces(lo: np.ndarray, hi: np.ndarray, path: list[tuple[int, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, ...]:
    """(range, first token, end, window, offset in the window) of the pieces of the tokens lo to hi of a source.

    ``path`` holds (number, totals, quanta) of the source among those of its queue, then of that queue among all: the
    source's place in its queue's order is the token number that the queue is dealt by. Neighbours in one order stay one piece.
    """
    which, first, end, at = np.arange(len(lo)), lo, hi, lo
    for number, totals, quantum in path:
        if len(totals) > 1:
            part, a, b, place = dealt(number, at, at + (end - first), totals, quantum)
            which, first, end, at = which[part], first[part] + a - at[part], first[part] + b - at[part], place
            joins = (which[1:] == which[:-1]) & (at[1:] == at[:-1] + (end - first)[:-1])
            head = np.flatnonzero(np.append(True, ~joins)) if len(which) else np.array([], dtype=np.int64)
            which, first, at, end = which[head], first[head], at[head], end[np.append(head[1:], len(end)) - 1] if len(head) else end
    part, window = _counted(at // width, (at + (end - first) - 1) // width + 1)
    begin = np.maximum(window * width, at[part])
    stop = np.minimum((window + 1) * width, at[part] + (end - first)[part])
    return which[part], first[part] + begin - at[part], first[part] + stop - at[part], window, begin - window * width


def pack(docs: DataFrame, *, width: int = 1024, queues: int = 64, targets: dict[str | None, float] | None = None, key: str = "doc_id", source: str = "source", ranks: str | None = None) -> DataFrame:
    """Packs all documents into sequences of ``width`` tokens, every one with the target proportions of the sources.

    ``targets`` weighs sources by name; without it, and for sources it does not name, a source weighs its share of the corpus's tokens. Each source is a queue (null: its
    own); with more than ``queues`` sources, every queues-th one is in the same queue, and round-robin runs among those in the same way, so each keeps its proportion. A source's
    tokens stand in the order of the written token table: the task's number, then the row's place. Deficit round-robin
    (``served``) deals the tokens out in one order, which is cut into windows; so all sequences but the last are full, documents are cut where a
    quantum or a window ends, and when a source is used up the others fill the windows. Texts are tokenised once; then token sums per (task, source),
    which carry rounds and deficits from partition to partition, are joined to the ids, by broadcast while Spark measures them as small.

    Returns per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null or empty text: the end id
    alone. Repeated rows are packed each. Null keys stay null. No rows: no rows. Other columns are ignored.
    """
    path = ranks or public_tokenizers.path(RANKS)
    docs = docs.select(F.col(key).alias("_key"), F.col(source).alias("_own"), "text")
    names = docs.select(F.col("_own").alias("_source")).distinct()
    turn = ranked(names.withColumn("_none", F.col("_source").isNull()), [], [F.col("_none"), F.col("_source")], "_turn")
    turn = turn.select("_source", F.col("_turn").cast("int").alias("_turn"))
    few = turn.count() <= 10000  # only then are the names small enough to be sent to every task
    turn = F.broadcast(turn) if few else turn
    queued = docs.join(turn, F.col("_own").eqNullSafe(F.col("_source")), "left")
    held = tokenized(queued.select("_key", F.col("_turn").alias("_queue"), "text"), path)
    sums = held.groupBy("_queue", "_task").agg(F.sum("doc_tokens").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_queue").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.withColumn("_base", earlier), "sums")
    found = sums.groupBy("_queue").agg(F.sum("_n").alias("_n")).toArrow()  # two numbers per source
    sizes = np.zeros(found.num_rows, dtype=np.int64)
    sizes[found.column(0).to_numpy()] = found.column(1).to_numpy()
    weights = sizes / max(sizes.sum(), 1)
    if targets:  # as many names as the parameter has
        for r in turn.where(F.col("_source").isin([t for t in targets if t is not None]) | F.col("_source").isNull()).collect():
            weights[r._turn] = targets.get(r._source, weights[r._turn])
    totals, heavy = (np.array([x[q::queues].sum() for q in range(min(queues, len(x)))]) for x in (sizes, weights))
    outer = quanta(heavy, width) if len(sizes) else sizes
    placed = held.join(sums.drop("_n"), ["_queue", "_task"]).select("_key", "_queue", "doc_tokens", "_ids", (F.col("_base") + F.col("_start")).alias("_from"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                queue, length, start = (part.column(c).to_numpy() for c in (1, 2, 4))
                data = [np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() for x in part.column(3).to_pylist()]
                for q in np.unique(queue):
                    rows = np.flatnonzero(queue == q)
                    rows = rows[np.argsort(start[rows], kind="stable")]
                    own, shared = q // queues, slice(q % queues, None, queues)
                    inner = (own, sizes[shared], quanta(weights[shared], outer[q % queues] / UNIT))  # a round of the queue's sources is what the queue is served in a round
                    doc, first, ends, window, offset = pieces(start[rows], start[rows] + length[rows], [inner, (q % queues, totals, outer)], width)
                    doc = rows[doc]
                    first, ends = first - start[doc], ends - start[doc]
                    crc = [zlib.crc32(data[d][4 * a : 4 * b]) for d, a, b in zip(doc.tolist(), first.tolist(), ends.tolist())]
                    columns = (first, ends - first, np.array(crc, dtype=np.int64), length[doc], window, offset)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    kind = placed.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema).withColumnRenamed("_key", key)
