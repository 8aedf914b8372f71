"""External induced suffix sorting of a shard of short strings, with common prefixes.

Suffixes are induced from the sorted left-most S suffixes in two scans over 258 monotone
priority queues, one for each first symbol. A queue holds tuples (position, common prefix
with the entry before it) in arrival order, which is rank order; when the queues exceed
the memory budget they go to scratch files of the task. Whole batches are popped, induced
and pushed with vector operations, and prefixes are carried along: an induced entry
shares one symbol more than the least prefix between its source and the last source
that fed the same queue.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR, SYMBOLS = 1, 258
#: Prefixes are carried up to this length; longer ones count as this.
DEPTH = 64
BATCH = 1 << 18


class Queue:
    """First in, first out tuples (position, prefix); beyond `budget` shared bytes they move to a scratch file."""

    held = 0

    def __init__(self, budget: int):
        self.budget, self.parts, self.file, self.stored = budget, [], None, []

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.append((pos, lcp))
        Queue.held += pos.nbytes + lcp.nbytes
        if Queue.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for pos, lcp in self.parts:
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.stored.append((at, len(pos), pos.dtype))
            Queue.held -= pos.nbytes + lcp.nbytes
        self.parts = []

    def _load(self, at: int, n: int, kind) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        return np.frombuffer(self.file.read(kind.itemsize * n), kind), np.frombuffer(self.file.read(n), np.uint8)

    def forward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for where in self.stored:
            yield self._load(*where)
        yield from self.parts

    def backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Reversed entries; each prefix is still the one with the entry before it in forward order."""
        for pos, lcp in reversed(self.parts):
            yield pos[::-1], lcp[::-1]
        for where in reversed(self.stored):
            pos, lcp = self._load(*where)
            yield pos[::-1], lcp[::-1]

    def drain(self) -> tuple[np.ndarray, np.ndarray] | None:
        found = list(self.forward())
        self.clear()
        if not found:
            return None
        return tuple(np.concatenate(x) for x in zip(*found))

    def clear(self) -> None:
        Queue.held -= sum(p.nbytes + x.nbytes for p, x in self.parts)
        self.parts, self.stored = [], []
        if self.file is not None:
            self.file.close()
            self.file = None


class _Scan:
    """One induction scan: remembers, for each queue, the least prefix since it was last fed."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, budget: int):
        self.text, self.wanted = text, wanted
        self.queues = [Queue(budget) for _ in range(SYMBOLS)]
        self.least = np.zeros(SYMBOLS, np.uint8)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Induce from sources in scan order; lcp[i] is the prefix of source i with the source before it."""
        for a in range(0, len(pos), BATCH):
            self._feed(pos[a : a + BATCH], lcp[a : a + BATCH])

    def _feed(self, pos, lcp) -> None:
        take = np.flatnonzero(pos > 0)
        take = take[self.wanted[pos[take] - 1]]
        before = pos[take] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        take, before, symbol = take[order], before[order], symbol[order]
        untouched = np.ones(SYMBOLS, bool)
        if len(take):
            fresh = np.concatenate(([True], symbol[1:] != symbol[:-1]))
            start = np.where(fresh, 0, np.concatenate(([0], take[:-1] + 1)))
            padded = np.append(lcp, np.uint8(255))
            low = np.minimum.reduceat(padded, np.stack((start, take + 1), 1).reshape(-1))[::2]
            at = np.flatnonzero(fresh)
            names = symbol[at]
            low[at] = np.minimum(low[at], self.least[names])
            low = np.minimum(low, DEPTH - 1) + np.uint8(1)
            low[at[self.least[names] == 0]] = np.minimum(low[at[self.least[names] == 0]], 1)
            stop = np.append(at[1:], len(take))
            for s, a, b in zip(names.tolist(), at.tolist(), stop.tolist()):
                self.queues[s].push(before[a:b], low[a:b])
                tail = lcp[take[b - 1] + 1 :]
                self.least[s] = tail.min() if len(tail) else 255
                untouched[s] = False
        if len(lcp):
            np.minimum(self.least, lcp.min(), out=self.least, where=untouched)


def _run_lengths(text: np.ndarray, pos: int) -> int:
    c, n = text[pos], 1
    while n < DEPTH and pos + n < len(text) and text[pos + n] == c:
        n += 1
    return n


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (S type); the last symbol is the unique smallest one."""
    ends = np.flatnonzero(text[1:] != text[:-1])  # a run of one symbol has one type
    return np.append(np.repeat(text[ends] < text[ends + 1], np.diff(ends, prepend=-1)), True)


def _induce(text, s_type, seeds: np.ndarray, prefixes: np.ndarray, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (symbol, positions, prefixes) by falling symbol from sorted (or to be sorted) LMS seeds."""
    bounds = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))
    down = _Scan(text, ~s_type, budget)
    large = [Queue(budget) for _ in range(SYMBOLS)]
    for c in range(SYMBOLS):
        first, last = True, -1
        while (got := down.queues[c].drain()) is not None:  # rounds: a symbol before itself feeds its own queue
            pos, lcp = got
            lcp = lcp.copy()
            if first:
                lcp[0] = 0
            large[c].push(pos, lcp)
            down.feed(pos, lcp)
            first, last = False, int(pos[-1])
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            lcp = prefixes[a:b].copy()
            lcp[0] = min(_run_lengths(text, last), _run_lengths(text, int(seeds[a]))) if last >= 0 else 0
            down.feed(seeds[a:b], lcp)
    up = _Scan(text, s_type, budget)
    for c in range(SYMBOLS - 1, -1, -1):
        small: list[tuple[np.ndarray, np.ndarray]] = []
        first, last = True, -1
        while (got := up.queues[c].drain()) is not None:
            pos, lcp = got
            lcp = lcp.copy()
            if first:
                lcp[0] = 0
            small.append((pos, lcp))
            up.feed(pos, lcp)
            first, last = False, int(pos[-1])
        if c == 0:
            small = [(np.array([len(text) - 1], seeds.dtype), np.zeros(1, np.uint8))]
        carry = np.uint8(0)
        if last >= 0:
            largest = next(iter(large[c].backward()), None)
            if largest is not None:
                carry = np.uint8(min(_run_lengths(text, last), _run_lengths(text, int(largest[0][0]))))
        joint = int(carry)
        for pos, lcp in large[c].backward():
            shifted = np.concatenate(([carry], lcp[:-1]))
            up.feed(pos, shifted)
            carry = lcp[-1]
        parts = list(large[c].forward())
        large[c].clear()
        if small:  # arrival was by falling rank: turn it round, with prefixes now to the smaller neighbour
            pos = np.concatenate([p for p, _ in small])
            lcp = np.concatenate([x for _, x in small])
            parts.append((pos[::-1], np.concatenate(([np.uint8(joint)], lcp[1:][::-1]))))
        if parts:
            yield c, np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to `most`."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    end = len(text)
    for d in range(most):
        live = live[(np.maximum(a[live], b[live]) + d) < end]
        live = live[text[a[live] + d] == text[b[live] + d]]
        if not len(live):
            break
        out[live] = d + 1
    return out


def sorted_suffixes(text: np.ndarray, budget: int = 256 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Suffixes by falling first symbol: (symbol, positions in rank order, prefixes with the one before).

    `text` holds symbols 2.. for bytes, 1 for separators and one 0 at its end. The order is that of the
    first DEPTH symbols at least. The LMS substrings are sorted by a first induction and named; the
    string of names is sorted in turn (its suffixes need at most DEPTH / 2 names, so ranks are doubled
    log2 times), and the order comes back as seeds of the final induction.
    """
    s_type = _types(text)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(kind)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    parts = [pos[is_lms[pos]] for _, pos, _ in _induce(text, s_type, seeds, np.zeros(len(seeds), np.uint8), budget)]
    order = np.concatenate(parts[::-1])
    where = np.searchsorted(lms, order)
    length = np.append(np.diff(lms), 1) + 1
    size = length[where]
    same = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    d = 0
    while len(live):  # equal LMS substrings get one name
        live = live[size[live] > d]
        if not len(live):
            break
        equal = text[np.minimum(order[live] + d, len(text) - 1)] == text[np.minimum(order[live + 1] + d, len(text) - 1)]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
    rank = np.empty(len(lms), np.int64)
    rank[where] = np.cumsum(np.concatenate(([0], ~same)))
    span = 1
    while span * 2 <= DEPTH and rank.max(initial=0) + 1 < len(rank):
        after = np.append(rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64))[: len(rank)]
        pair = rank * (len(rank) + 1) + after
        _, rank = np.unique(pair, return_inverse=True)
        span *= 2
    seeds = lms[np.argsort(rank, kind="stable")]
    prefixes = np.concatenate(([np.uint8(0)], _common(text, seeds[:-1], seeds[1:], DEPTH))) if len(seeds) else np.zeros(0, np.uint8)
    yield from _induce(text, s_type, seeds, prefixes, budget)
