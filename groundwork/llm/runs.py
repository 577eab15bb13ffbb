"""Periodic runs of words: common extensions over a difference cover, found on harmonic grids."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

#: A perfect difference set. Any two remainders modulo PERIOD become members of COVER by one and the same shift.
PERIOD, COVER = 13, (0, 1, 3, 9)
PART = 4 << 20  # bytes of texts that are sorted together
SCHEMA = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _shifts() -> np.ndarray:
    inside = np.isin(np.arange(PERIOD), COVER)
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD])
    return out


SHIFT = _shifts()


def _pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the pairs, equal ones for equal pairs."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


class Extensions:
    """Longest common extensions of any two different positions of ``words``, which ends in a symbol of its own.

    Only suffixes that start at a position of the cover are sorted: by the names of their first ``PERIOD`` words, then by doubling among those still tied. Their neighbours' common
    prefixes are in a sparse table of minima. A query compares the few words up to the next shift at which both positions are in the cover, then reads the table.
    """

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        self.ends = np.concatenate([words, np.full(2 * PERIOD, -1)])
        name = np.unique(np.concatenate([words, np.zeros(2 * PERIOD, dtype=np.int64)]), return_inverse=True)[1]
        for by in (1, 2, 4, PERIOD - 8):  # windows of 1, 2, 4, 8 and 13 words
            name = _pair_names(name[:-by], name[by:])
        at = np.add.outer(np.arange(0, n + PERIOD, PERIOD), COVER).ravel()
        self.at = at = at[at < n]
        self.order_of = np.full(PERIOD, -1)
        self.order_of[list(COVER)] = np.arange(len(COVER))
        self.sorted, levels = self._sort(name[at])
        self.rank = np.empty(len(at), dtype=np.int64)
        self.rank[self.sorted] = np.arange(len(at))
        self.table = self._minima(self._neighbours(levels))

    def _sort(self, name: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sampled suffixes in order, and after each doubling the place where a suffix's ties begin (last: -1, past the end)."""
        m = len(name)
        order = np.argsort(name, kind="stable")
        opens = np.diff(name[order], prepend=-1) != 0
        rank = np.append(np.zeros(m, dtype=np.int64), -1)
        rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        levels, step = [rank.copy()], len(COVER)
        while True:
            size = np.bincount(rank[:-1], minlength=m)
            tied = np.flatnonzero(size[rank[:-1]] > 1)
            if not len(tied):
                break
            behind = rank[np.minimum(tied + step, m)]
            by = np.lexsort((behind, rank[tied]))
            tied, first, second = tied[by], rank[tied][by], behind[by]
            fresh = np.diff(first, prepend=-1) != 0
            opens = fresh | (np.diff(second, prepend=-2) != 0)
            own = np.arange(len(tied))
            inside = own - own[fresh][np.cumsum(fresh) - 1]  # place among the suffixes it was tied with
            rank[tied] = first + inside[opens][np.cumsum(opens) - 1]
            levels.append(rank.copy())
            step *= 2
        order = np.empty(m, dtype=np.int64)
        order[rank[:-1]] = np.arange(m)
        return order, levels

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it."""
        a, b, m = self.sorted[:-1].copy(), self.sorted[1:].copy(), len(self.at)
        words = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(levels))):
            alike = levels[level][np.minimum(a, m)] == levels[level][np.minimum(b, m)]
            a += alike * (len(COVER) << level)
            b += alike * (len(COVER) << level)
            words += alike * (PERIOD << level)
        return words + self._compared(self.at[self.sorted[:-1]] + words, self.at[self.sorted[1:]] + words, np.full(len(a), PERIOD))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``most``, one by one."""
        out, left = np.zeros(len(i), dtype=np.int64), np.flatnonzero(most > 0)
        for d in range(PERIOD):
            left = left[self.ends[i[left] + d] == self.ends[j[left] + d]]
            out[left] = d + 1
            left = left[most[left] > d + 1]
            if not len(left):
                break
        return out

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on (i and j differ everywhere)."""
        shift = SHIFT[i % PERIOD, j % PERIOD]
        out = self._compared(i, j, shift)
        met = np.flatnonzero(out == shift)
        a, b = (x[met] + shift[met] for x in (i, j))
        inside = np.maximum(a, b) < len(self.words)
        met, a, b = met[inside], a[inside], b[inside]
        ra, rb = (self.rank[x // PERIOD * len(COVER) + self.order_of[x % PERIOD]] for x in (a, b))
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            row = self.table[k]
            out[met[own]] += np.minimum(row[lo[own]], row[hi[own] - (1 << k)])
        return out


def _grid_runs(words: np.ndarray, lengths: np.ndarray, least_words: int, least_turns: int) -> np.ndarray:
    """(start, length, period) of all runs. ``words`` holds texts by falling length, each with a closing symbol of its own.

    Equal words ``period`` apart stand in a stretch of at least max(least_words, least_turns * period) - period positions, so one of them is a multiple of that number: only these are looked at.
    """
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    starts, periods = [], []
    for p in range(1, int(lengths[0]) // least_turns + 1 if len(lengths) else 1):
        least = max(least_words, least_turns * p)
        stop = first[np.searchsorted(-lengths, -least, side="right")]
        if stop == 0:
            break
        step = least - p
        found = np.flatnonzero(words[: stop - p : step] == words[p:stop:step]) * step
        if len(found):
            starts.append(found)
            periods.append(np.full(len(found), p))
    if not starts:
        return np.zeros((0, 3), dtype=np.int64)
    i, p = np.concatenate(starts), np.concatenate(periods)
    s = np.maximum(least_words, least_turns * p) - p
    lce = Extensions(words)
    ahead = lce.common(i, i + p)

    def kept(ok: np.ndarray) -> None:
        nonlocal i, p, s, ahead
        i, p, s, ahead = i[ok], p[ok], s[ok], ahead[ok]

    missing = np.maximum(s - ahead, 0)  # words that a stretch needs before i
    near = np.maximum(i - missing, 0)
    kept((missing <= i) & ((missing == 0) | (lce.common(near, near + p) >= missing)))
    before = np.maximum(i - s, 0)
    kept((i < s) | (lce.common(before, before + p) < s))  # the stretch of the grid's point before is found there
    lo, hi = np.maximum(i - s + 1, 0), i.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        reaches = lce.common(mid, mid + p) >= i - mid
        lo, hi = np.where(reaches, lo, np.minimum(mid + 1, hi)), np.where(reaches, mid, hi)
    runs = np.column_stack([hi, i - hi + ahead + p, p])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = (np.diff(runs[:, :2], axis=0, prepend=-1) != 0).any(axis=1)  # else a multiple of the smallest period
    return runs[fresh]


def _measured(texts: list[bytes | None], least_words: int, least_turns: int, outputs: bool) -> dict[str, list]:
    split = [(t or b"").split() for t in texts]  # bytes split at exactly x20 and x09-x0D
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(numbers.__getitem__, split[k]), dtype=np.int64, count=len(split[k])) for k in order]
    joined = np.concatenate([x for k, own in enumerate(ids) for x in (own, [len(numbers) + k])]) if ids else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths[order] + 1)])
    runs = _grid_runs(joined, lengths[order], least_words, least_turns)
    edges = np.zeros(len(joined) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges) > 0
    of = np.searchsorted(first, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    names = [*(c.split()[0] for c in SCHEMA.split(", ")), *(("runs", "collapsed_text") if outputs else ())]
    out: dict[str, list] = {c: [None] * len(texts) for c in names}
    for k, i in enumerate(order.tolist()):
        own = runs[bounds[k] : bounds[k + 1]] - [first[k], 0, 0]
        own = own[np.lexsort((own[:, 2], own[:, 0]))]
        words = split[i]
        if len(own):
            start, length, period = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            out["start"][i], out["length"][i], out["period"][i], out["exponent_milli"][i] = start, length, period, 1000 * length // period
            words = [w for w, g in zip(words, gone[first[k] : first[k] + lengths[i]].tolist()) if not g]
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist())
        text = b" ".join(words)
        out["n_words"][i], out["n_runs"][i] = int(lengths[i]), len(own)
        out["runs_sha256"][i], out["collapsed_sha256"][i] = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
        if outputs:
            out["runs"][i], out["collapsed_text"][i] = listed, text
    return out


def find_runs(docs: DataFrame, *, key: str = "doc_id", least_words: int = 6, least_turns: int = 4, texts: bool = False) -> DataFrame:
    """Per row: the key, n_words, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 (and runs, collapsed_text).

    A run is a stretch of words with smallest period q, of max(least_words, least_turns * q) words at least (``least_turns`` at least 2), that no neighbouring word continues. A run's words after its first q
    are dropped from the collapsed text, whose words are joined by a blank. ``runs`` lists start,length,period line by line. Ties of the longest run go to the smallest start, then period.

    Rows are independent: no shuffle. Texts of a batch are sorted together in parts of 4 MB; a longer text is a part of its own, so memory follows the longest text. Null and empty texts, and
    texts of blanks, have no words, no run and four nulls. Null or repeated keys change nothing. No rows: no rows.
    """
    if least_turns < 2:
        raise ValueError("least_turns must be at least 2")

    def compute(values: list[bytes | None]) -> dict[str, list]:
        parts, size = [[]], 0
        for v in values:
            if size and size + len(v or b"") > PART:
                parts.append([])
                size = 0
            parts[-1].append(v)
            size += len(v or b"")
        made = [_measured(p, least_words, least_turns, texts) for p in parts]
        return {c: [x for m in made for x in m[c]] for c in made[0]}

    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary").alias("_text"))
    out = appended(rows, "_text", compute, SCHEMA + (", runs string, collapsed_text binary" if texts else ""))
    return out.select(F.col("_key").alias(key), *(F.col(c).cast("string").alias(c) if c == "collapsed_text" else c for c in out.columns if c != "_key"))


def with_repeated_tails(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text; in one of ten rows, by the CRC-32 of the key, the words from some word on repeat the first few of these again and again.

    With h the CRC-32 of the key in decimals and g = floor(h / 10), that is rows with h % 10 = 0 and n > 0 words: word i >= a becomes word a + (i - a) % p, where a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary").alias("_text"), F.crc32(F.col(key).cast("string").cast("binary")).alias("_h"))
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))

    def edit(values: list[bytes | None]) -> dict[str, list]:
        out = []
        for v in values:
            h, text = v.split(b" ", 1)
            g, words = int(h) // 10, text.split()
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                words = words[:a] + [words[a + k % p] for k in range(len(words) - a)]
            out.append(b" ".join(words))
        return {"text": out}

    led = F.concat(F.concat(F.col("_h").cast("string"), F.lit(" ")).cast("binary"), F.coalesce("_text", F.lit(b"")))
    edited = appended(rows.where(chosen).select("_key", led.alias("_led")), "_led", edit, "text binary")
    both = rows.where(~chosen).select("_key", F.col("_text").alias("text")).unionByName(edited)
    return both.select(F.col("_key").alias(key), F.col("text").cast("string").alias("text"))
