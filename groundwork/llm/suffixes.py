"""Suffix sorting by recursive induction over disk-backed queues, for shards far larger than memory.

Queues carry suffix tuples: the position, the symbol before it with its type, and the common prefix with the suffix ahead in the queue. A text's
LMS substrings are sorted by one induction and named; the string of names is sorted in the same way, until it fits in memory; its
order then induces that of all suffixes, and the common prefixes of the sorted LMS suffixes those of all neighbours.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

SEPARATOR, FIRST_BYTE = 1, 2  # symbol 0 ends the text, 1 ends a piece, byte b is b + 2
SYMBOLS = 258
Columns = tuple[np.ndarray, ...]


class Space:
    """The memory of one sort. Arrays over a sixteenth of ``budget`` bytes and queues over a quarter lie in unnamed temporary files; tuples are worked on in blocks."""

    def __init__(self, budget: int):
        self.budget, self.block = budget, max(64, budget // 64)

    def array(self, n: int, dtype: object) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.budget // 16:
            return np.zeros(n, dtype=dtype)
        with tempfile.TemporaryFile() as f:
            return np.asarray(np.memmap(f, dtype=dtype, mode="w+", shape=(n,)))

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        return ((at, min(at + self.block, n)) for at in range(0, n, self.block))


class Queue:
    """Tuples in queues by number, as columns. Pushes come in suffix order, so taking the least number in order of arrival makes them one priority queue.
    Past a quarter of the budget, what is held goes to a temporary file, one run a queue, and is read back in blocks."""

    def __init__(self, space: Space):
        self.space, self.held, self.file, self.end = space, 0, None, 0
        self.queues: dict[int, list] = {}

    def push(self, number: int, columns: Columns) -> None:
        self.kinds = [c.dtype for c in columns]
        self.queues.setdefault(number, []).append(columns)
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.space.budget // 4:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        for chunks in self.queues.values():
            spilled = next((i for i, x in enumerate(chunks) if isinstance(x[0], np.ndarray)), len(chunks))
            if spilled == len(chunks):
                continue
            joined = _joined(chunks[spilled:])
            del chunks[spilled:]
            for lo in range(0, len(joined[0]), self.space.block):
                part = [c[lo : lo + self.space.block] for c in joined]
                chunks.append((self.end, len(part[0])))
                for c in part:
                    self.file.write(c.tobytes())
                    self.end += c.nbytes
        self.held = 0

    def _read(self, chunk: tuple) -> Columns:
        if isinstance(chunk[0], np.ndarray):
            return chunk
        at, n = chunk
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), dtype=k) for k in self.kinds)

    def take(self, number: int) -> Iterator[Columns]:
        """What is in a queue, in order of arrival, which empties it."""
        chunks = self.queues.pop(number, [])
        self.held -= sum(c.nbytes for x in chunks if isinstance(x[0], np.ndarray) for c in x)
        return self._blocks(chunks)

    def look(self, number: int, backwards: bool = False) -> Iterator[Columns]:
        """What is in a queue, which stays there; backwards from the last arrival to the first."""
        chunks = self.queues.get(number, [])
        if backwards:
            return (tuple(c[::-1] for c in x) for x in self._blocks(chunks[::-1], -1))
        return self._blocks(chunks)

    def _blocks(self, chunks: list, turn: int = 1) -> Iterator[Columns]:
        held, size = [], 0
        for chunk in chunks:
            x = self._read(chunk)
            if held and size + len(x[0]) > self.space.block:
                yield _joined(held[::turn])
                held, size = [], 0
            held.append(x)
            size += len(x[0])
        if held:
            yield _joined(held[::turn])


def _joined(chunks: list[Columns]) -> Columns:
    return chunks[0] if len(chunks) == 1 else tuple(np.concatenate(c) for c in zip(*chunks))


class Level:
    """A text of the recursion: symbols (the last one is its only 0), their types, and the ranges of symbols that have a queue each.

    ``typed`` is twice the symbol, and one more where the suffix is smaller than the next one (type S). With ``depth``, common prefixes up to it are carried
    along (the symbols are few then, and each is a range).
    """

    def __init__(self, text: np.ndarray, symbols: int, space: Space, depth: int = 0):
        n = len(text)
        self.text, self.symbols, self.space, self.depth, self.n = text, symbols, space, depth, n
        self.place = np.int32 if n < 1 << 31 else np.int64
        self.typed = space.array(n, np.uint16 if depth else np.int64)
        smaller = True
        self.typed[n - 1] = 1
        for lo, hi in reversed(list(space.blocks(n - 1))):
            t = np.asarray(text[lo : hi + 1])
            d = np.flatnonzero(t[:-1] != t[1:])
            rises = np.append(t[d] < t[d + 1], smaller)
            small = rises[np.searchsorted(d, np.arange(hi - lo))]
            smaller = bool(small[0])
            self.typed[lo:hi] = t[:-1].astype(self.typed.dtype) * 2 + small
        if depth:
            self.cuts = np.arange(symbols + 1)
        else:  # ranges of about as many symbols as a block holds; a symbol that fills one has it for itself
            sample = np.sort(np.asarray(text[:: max(1, n // (1 << 14))]))
            parts = min(len(sample), max(1, 4 * n // space.block))
            bounds = sample[np.arange(parts) * len(sample) // parts]
            self.cuts = np.unique(np.concatenate(([0], bounds, bounds[1:][bounds[1:] == bounds[:-1]] + 1, [symbols])))

    def range_of(self, symbol: np.ndarray) -> np.ndarray:
        return symbol if self.depth else np.searchsorted(self.cuts, symbol, "right") - 1

    def before(self, position: np.ndarray) -> np.ndarray:
        """The symbol and type before each position (of no use for position 0)."""
        return self.typed[np.maximum(position - 1, 0)]

    def lms(self) -> np.ndarray:
        """The places where type S follows type L, in text order."""
        out, count = self.space.array(self.n // 2 + 1, self.place), 0
        for lo, hi in self.space.blocks(self.n):
            t = np.asarray(self.typed[max(lo - 1, 0) : hi]) & 1
            found = np.flatnonzero(t[1:] > t[:-1]) + max(lo, 1)
            out[count : count + len(found)] = found
            count += len(found)
        return out[:count]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, up to ``depth``, four symbols a step."""
        words = np.lib.stride_tricks.sliding_window_view(self.text, 4)
        last = len(words) - 1
        out, live, step = np.zeros(len(a), dtype=np.uint8), np.flatnonzero(a != b), 0
        while len(live) and step < self.depth:
            x, y = a[live] + step, b[live] + step
            # the text's end differs from all, so a suffix that has come near it is compared symbol by symbol
            near = np.maximum(x, y) > last
            far = np.flatnonzero(~near)
            differ = np.ascontiguousarray(words[x[far]]).view("<u8")[:, 0] ^ np.ascontiguousarray(words[y[far]]).view("<u8")[:, 0]
            same = np.where(differ == 0, 4, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 16)
            out[live[far]] = np.minimum(step + same, self.depth)
            for i in np.flatnonzero(near):
                k, n = step, live[i]
                while k < self.depth and self.text[a[n] + k] == self.text[b[n] + k]:
                    k += 1
                out[n] = k
            live = live[far[same == 4]]
            step += 4
        return out


class Minima:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-width], self.rows[-1][width:]))
            width *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo..hi], ends included; 255 where lo is past hi."""
        out = np.full(len(lo), 255, dtype=np.uint8)
        size = hi - lo + 1
        power = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        for p in np.unique(power[power >= 0]):
            at = np.flatnonzero(power == p)
            out[at] = np.minimum(self.rows[p][lo[at]], self.rows[p][hi[at] - (1 << p) + 1])
        return out


class Scan:
    """One induction over a level: ``want`` 0 goes up through the symbols and induces suffixes of type L from the sorted LMS suffixes, 1 goes down and
    induces type S from those of type L. ``sources(range)`` gives (position, before, symbol) in the order of the scan, or with ``carry`` the common prefix instead of the symbol."""

    def __init__(self, level: Level, want: int, sources: object, carry: bool):
        self.level, self.want, self.sources, self.carry = level, want, sources, carry
        self.queue, self.found = Queue(level.space), Queue(level.space)
        self.since = np.full(level.symbols, 255, dtype=np.uint8) if carry else None

    def run(self) -> Queue:
        """What was induced, by range, in the order of the scan."""
        ranges = range(len(self.level.cuts) - 1)
        for r in reversed(ranges) if self.want else ranges:
            if self.level.cuts[r + 1] - self.level.cuts[r] == 1:
                self._symbol(r)
            else:
                self._range(r)
        return self.found

    def _symbol(self, r: int) -> None:
        last = None

        def follow(chunk: Columns, kept: bool) -> None:
            nonlocal last
            position, seen, third = chunk
            if self.carry and (last is None or not kept and first):
                third = third.copy()
                # the first suffix with a symbol shares nothing with what went before; where the types meet, the texts tell
                third[0] = 0 if last is None else self.level.common(np.array([last]), position[:1])[0]
                chunk = (position, seen, third)
            if kept:
                self.found.push(r, chunk)
            last = int(position[-1])
            self._induce(chunk)

        while r in self.queue.queues:  # what a symbol induces in itself comes in the next turn
            for chunk in self.queue.take(r):
                follow(chunk, True)
        first = True
        for chunk in self.sources(r):
            follow(chunk, False)
            first = False

    def _range(self, r: int) -> None:
        """A range of symbols, sorted in memory. All tuples up to the least symbol that they induce in the range itself are final, as what it induces comes after
        them; so are looked at only the next few, as many as were lately final at once, with what the range has induced in itself (``late``)."""
        mine, theirs = list(self.queue.take(r)), list(self.sources(r))
        if not mine and not theirs:
            return
        sign = -1 if self.want else 1
        kind = np.repeat(np.array([0, 1], dtype=np.int8), [sum(len(c[0]) for c in part) for part in (mine, theirs)])
        ready = (*_joined(mine + theirs), kind)
        order = np.lexsort((kind, sign * ready[2]))
        ready = tuple(c[order] for c in ready)
        late, at, width = tuple(c[:0] for c in ready), 0, 1 << 10
        while at < len(ready[0]) or len(late[0]):
            if len(late[0]) > width:  # too many to be sorted again each time
                ready, late, at = tuple(np.concatenate((c[at:], x)) for c, x in zip(ready, late)), tuple(c[:0] for c in late), 0
                order = np.lexsort((ready[3], sign * ready[2]))
                ready = tuple(c[order] for c in ready)
            near = tuple(c[at : at + width] for c in ready)
            n = len(near[0])
            x = tuple(np.concatenate(c) for c in zip(near, late))
            order = np.lexsort((x[3], sign * x[2]))
            position, seen, symbol, kind = (c[order] for c in x)
            target = seen >> 1
            inside = (position > 0) & (seen & 1 == self.want) & (target >= self.level.cuts[r]) & (target < self.level.cuts[r + 1])
            final = len(position)
            if inside.any():
                bound = (sign * target[inside]).min()
                final = int(np.count_nonzero((sign * symbol < bound) | ((symbol == sign * bound) & (kind == 0))))
            if at + n < len(ready[0]):  # what comes after the last of these may come after others too
                final = min(final, int(np.flatnonzero(order == n - 1)[0]) + 1)
            done = (position[:final], seen[:final], symbol[:final])
            kept = kind[:final] == 0
            if kept.any():
                self.found.push(r, tuple(c[kept] for c in done))
            self._induce(done)
            at += int(np.count_nonzero(order[:final] < n))
            rest = np.sort(order[final:])
            new = [(*c, np.zeros(len(c[0]), dtype=np.int8)) for c in self.queue.take(r)]
            late = _joined([tuple(c[rest[rest >= n]] for c in x), *new])
            width = min(max(2 * final, 1 << 8), self.level.space.block)

    def _induce(self, chunk: Columns) -> None:
        """Pushes the suffixes that begin one symbol earlier and have the wanted type, with the common prefixes that the tuples between two of a symbol leave them."""
        position, seen, third = chunk
        level = self.level
        chosen = np.flatnonzero((position > 0) & (seen & 1 == self.want))
        symbol = seen[chosen] >> 1
        number = level.range_of(symbol)
        order = np.argsort(number, kind="stable")
        chosen, symbol, number = chosen[order], symbol[order], number[order]
        new = position[chosen] - 1
        heads = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.array([], dtype=np.int64)
        carried = symbol
        if self.carry:
            minima, size = Minima(third), len(third)
            start = np.append(0, chosen[:-1] + 1)[: len(chosen)]
            start[heads] = 0
            carried = minima.of(start, chosen)
            names = symbol[heads]
            carried[heads] = np.minimum(carried[heads], self.since[names])
            carried = np.minimum(carried, level.depth - 1) + np.uint8(1)
            self.since = np.minimum(self.since, third.min()) if size else self.since
            ends = np.append(heads[1:], len(chosen)) - 1 if len(heads) else heads
            self.since[names] = minima.of(chosen[ends] + 1, np.full(len(ends), size - 1))
        columns = (new, level.before(new), carried)
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(chosen)).tolist()):
            self.queue.push(int(number[lo]), tuple(c[lo:hi] for c in columns))


def _queued(level: Level, positions: Iterable[np.ndarray], carry: bool) -> Queue:
    """LMS positions by range, as sources; with ``carry`` they are sorted and have the common prefixes of neighbours."""
    out, last = Queue(level.space), None
    for position in positions:
        symbol = level.text[position]
        third = symbol
        if carry:
            third = level.common(np.append(position[:1] if last is None else last, position[:-1]), position)
            last = position[-1:]
        number = level.range_of(np.asarray(symbol))
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                out.push(int(number[part[0]]), (position[part], level.before(position[part]), third[part]))
    return out


def _induced(level: Level, sources: Queue, carry: bool) -> tuple[Queue, Queue]:
    """All suffixes of type L, ascending in every range, and of type S, descending, as sorted LMS positions induce them."""
    large = Scan(level, 0, sources.look, carry).run()

    def backwards(r: int) -> Iterator[Columns]:
        after = 0  # a tuple's common prefix is that with the smaller neighbour; going down it belongs to that one
        for position, seen, third in large.look(r, backwards=True):
            if carry:
                yield position, seen, np.append(np.uint8(after), third[:-1])
                after = third[-1]
            else:
                yield position, seen, third

    return large, Scan(level, 1, backwards, carry).run()


def _named(level: Level, lms: np.ndarray, small: Queue) -> tuple[np.ndarray, int]:
    """The LMS substrings' names in text order, and how many there are; equal substrings have equal names (with ``depth``: those that agree so far)."""
    space = level.space
    at = space.array(level.n // 2 + 1, np.int64)  # LMS positions are two apart at least
    size = space.array(level.n // 2 + 1, level.place)
    for lo, hi in space.blocks(len(lms)):
        size[lms[lo:hi] // 2] = np.append(lms[lo + 1 : hi + 1], [level.n - 1] * (hi == len(lms)))[: hi - lo] - lms[lo:hi] + 1
    count, last, most = 0, None, level.depth or level.n
    for r in range(len(level.cuts) - 2, -1, -1):
        for position, seen, _ in small.look(r):
            mine = position[(seen & 1 == 0) & (position > 0)]
            if not len(mine):
                continue
            before = np.append(mine[:1] if last is None else last, mine[:-1])
            a, b = size[before // 2], size[mine // 2]
            same = (a == b) | (np.minimum(a, b) >= most)
            live, step = np.flatnonzero(same), 0
            while len(live):
                equal = level.text[before[live] + step] == level.text[mine[live] + step]
                same[live[~equal]] = False
                step += 1
                live = live[equal & (b[live] > step)] if step < most else live[:0]
            if last is None:
                same[0] = True
            number = count + np.cumsum(~same)
            at[mine // 2], count, last = number, int(number[-1]), mine[-1:]
    at[(level.n - 1) // 2] = count = count + 1  # the text's end is the least; no scan induces it
    names = space.array(len(lms), np.int64)
    for lo, hi in space.blocks(len(lms)):
        names[lo:hi] = count - at[lms[lo:hi] // 2]
    return names, count + 1


def _order_in_memory(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string that fits in memory, by names of twice as many symbols in each turn."""
    names, reach = np.asarray(names), 1
    while names.max() < len(names) - 1:
        later = np.concatenate((names[reach:] + 1, np.zeros(min(reach, len(names)), dtype=np.int64)))[: len(names)]
        names = np.unique(names * (len(names) + 2) + later, return_inverse=True)[1]
        reach *= 2
    return np.argsort(names, kind="stable")


def _order(text: np.ndarray, symbols: int, space: Space) -> Iterator[np.ndarray]:
    """The positions of a string of names by their suffixes, in blocks."""
    if len(text) * 64 <= space.budget:
        yield _order_in_memory(text)
        return
    level = Level(text, symbols, space)
    large, small = _sorted(level)
    yield np.array([level.n - 1])
    for r in range(len(level.cuts) - 1):
        # a range's symbols come one after the other, each with its suffixes of type L first
        rows = [(p, s, 0) for p, _, s in large.look(r)] + [(p, s, 1) for p, _, s in small.look(r, backwards=True)]
        if level.cuts[r + 1] - level.cuts[r] == 1:
            yield from (p for p, _, _ in rows)
        elif rows:
            position, symbol = (np.concatenate([x[i] for x in rows]) for i in (0, 1))
            kind = np.repeat([x[2] for x in rows], [len(x[0]) for x in rows])
            yield position[np.lexsort((kind, symbol))]


def _sorted(level: Level) -> tuple[Queue, Queue]:
    """All suffixes of a level, of type L and S (without the text's end): sorts and names the LMS substrings, sorts the string of names, and induces."""
    space, lms = level.space, level.lms()
    positions = lambda: (np.asarray(lms[lo:hi]) for lo, hi in space.blocks(len(lms)))
    names, count = _named(level, lms, _induced(level, _queued(level, positions(), False), False)[1])
    if count == len(lms):
        place = space.array(len(lms), level.place)
        for lo, hi in space.blocks(len(lms)):
            place[names[lo:hi]] = lms[lo:hi]
        order = (np.asarray(place[lo:hi]) for lo, hi in space.blocks(len(lms)))
    else:
        order = (np.asarray(lms[part]) for part in _order(names, count, space))
    carry = level.depth > 0
    return _induced(level, _queued(level, order, carry), carry)


def neighbours(text: np.ndarray, depth: int, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefixes with the one before, up to ``depth``) of all suffixes but the text's end, ascending by their first ``depth`` symbols, in blocks.

    ``text`` has symbols under 258 and ends in its only 0.
    """
    level = Level(text, SYMBOLS, space, depth)
    if level.n < 2:
        return
    large, small = _sorted(level)
    for c in range(SYMBOLS):
        last, after = None, None
        for position, _, lcp in large.look(c):
            yield position, lcp
            last = position[-1:]
        for position, _, lcp in small.look(c, backwards=True):
            if after is None:  # where type S begins
                after = 0 if last is None else level.common(last, position[:1])[0]
            yield position, np.append(np.uint8(after), lcp[:-1])
            after = lcp[-1]


def repeated_starts(pieces: Iterable[tuple[bytes, int, tuple]], depth: int, budget: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """For pieces (bytes, starts, order): which of each one's first ``starts`` positions have their next ``depth`` bytes at an earlier position too.

    Positions are ordered by the pieces' ``order``, then by place. Yields (the piece's number, whether repeated) of pieces with a repeat. Texts, tuples and
    marks lie on disk where they outgrow the budget; four numbers a piece are held.
    """
    space = Space(budget)
    with tempfile.TemporaryFile() as f:
        sizes, starts, orders = [], [], []
        for piece, n, order in pieces:
            f.write(piece + b"\0")
            sizes.append(len(piece))
            starts.append(n)
            orders.append(order)
        f.write(b"\0")
        f.seek(0)
        n, begin = sum(sizes) + len(sizes) + 1, np.append(0, np.cumsum(np.array(sizes, dtype=np.int64) + 1))
        text = space.array(n, np.uint16)
        for lo, hi in space.blocks(n):
            text[lo:hi] = np.frombuffer(f.read(hi - lo), dtype=np.uint8).astype(np.uint16) + FIRST_BYTE
    for lo, hi in space.blocks(len(sizes)):
        text[begin[lo:hi] + np.array(sizes[lo:hi])] = SEPARATOR
    text[-1] = 0
    starts = np.array(starts)
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[sorted(range(len(sizes)), key=orders.__getitem__)] = np.arange(len(sizes))
    again = space.array(n, np.bool_)
    first = None  # (order, position): the earliest of the group that the next block may go on with, if it has a valid start
    for position, lcp in neighbours(text, depth, space):
        group = np.cumsum(lcp < depth)
        last = int(group[-1])
        shared = lcp >= depth  # others stand alone, but for the last one, which the next block may go on with
        shared[:-1] |= shared[1:]
        shared[-1] = True
        position, group = position[shared], group[shared]
        piece = np.searchsorted(begin, position, "right") - 1
        valid = piece < len(starts)
        valid[valid] = position[valid] - begin[piece[valid]] < starts[piece[valid]]
        position, group, piece = position[valid].astype(np.int64), group[valid], piece[valid]
        key = rank[piece] << 32 | position - begin[piece]
        if first is not None:
            key, position, group = np.append(first[0], key), np.append(first[1], position), np.append(0, group)
        first = None
        if len(position):
            order = np.lexsort((key, group))
            later = np.append(False, group[order][1:] == group[order][:-1])
            again[position[order[later]]] = True
            lead = order[~later][-1]
            first = (key[lead], position[lead]) if group[lead] == last else None
    for i, (at, n) in enumerate(zip(begin.tolist(), starts.tolist())):
        mine = np.asarray(again[at : at + n])
        if mine.any():
            yield i, mine
