"""External induced sorting of suffixes with common-prefix values.

A string ends with symbol 0, which occurs nowhere else. Its left-most S-type suffixes are sorted first: their substrings
by one induction, which names them, and the string of names by recursion (or, once it fits in memory, by doubling). All
other suffixes are induced from them: L-type ones bucket by bucket upwards, S-type ones downwards.

What waits for a bucket is a tuple of a position and the length of the prefix that it shares with the tuple before it (at
most ``depth``), packed into one integer. Tuples lie in queues by symbol that go to an unnamed scratch file beyond their
share of memory; the string, names and flags are mapped from scratch files beyond theirs. A block of at most ``chunk``
tuples is in memory at a time. A tuple's predecessor shares one symbol more with the one emitted to the same bucket before
it than the least that the tuples between them share; the least so far is kept for every symbol.

The queues come out in order, so that neighbours in the suffix order and what they share are a stream, never an array.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes for queues and arrays that stay in memory, and tuples of a block.
MEMORY = 4 << 20
CHUNK = 1 << 16
_LOW = (1 << 16) - 1
#: Symbols that pairs are compared over one by one, and a place beyond any text.
_NEAR, _NONE = 24, 1 << 40


def scratch(n: int, kind, memory: int) -> np.ndarray:
    """An array in memory, or mapped from a file without a name if it is larger than a share of the memory."""
    if n * np.dtype(kind).itemsize <= memory // 4:
        return np.empty(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Queues:
    """Tuples by symbol, first in first out; ``take`` gives the head, ``take_last`` the tail."""

    def __init__(self, memory: int):
        self.blocks: dict[int, list] = {}
        self.memory, self.held, self.file, self.spilled = memory, 0, None, 0

    def put(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(block.tobytes())
            self.spilled += block.nbytes
            self.blocks.setdefault(symbol, []).append((at, len(block)))
        else:
            self.held += block.nbytes
            self.blocks.setdefault(symbol, []).append(block)

    def _cut(self, block, start: int, end: int) -> np.ndarray:
        if isinstance(block, tuple):
            self.file.seek(block[0] + 8 * start)
            return np.frombuffer(self.file.read(8 * (end - start)), np.int64)
        return block[start:end]

    def _rest(self, block, start: int, end: int):
        return (block[0] + 8 * start, end - start) if isinstance(block, tuple) else block[start:end]

    def take(self, symbol: int, most: int, last: bool = False) -> np.ndarray | None:
        """Up to ``most`` of a symbol's tuples, or None."""
        blocks = self.blocks.get(symbol)
        if not blocks:
            return None
        got, n = [], 0
        while blocks and n < most:
            block = blocks.pop() if last else blocks.pop(0)
            size = block[1] if isinstance(block, tuple) else len(block)
            use = min(size, most - n)
            got.append(self._cut(block, size - use, size) if last else self._cut(block, 0, use))
            if not isinstance(block, tuple):
                self.held -= 8 * use
            if use < size:
                rest = self._rest(block, 0, size - use) if last else self._rest(block, use, size)
                blocks.append(rest) if last else blocks.insert(0, rest)
            n += use
        return got[0] if len(got) == 1 else np.concatenate(got[::-1] if last else got)

    def close(self) -> None:
        self.blocks.clear()
        if self.file:
            self.file.close()


def _pack(pos: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return pos.astype(np.int64) << 16 | shared


def _compare(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, out: np.ndarray, active: np.ndarray, upto: int) -> np.ndarray:
    """Adds to ``out`` what the active pairs share beyond it; those that share ``upto`` symbols and more are given back."""
    width, last, open_ = 8, len(text) - 1, []
    while len(active):
        at = out[active, None] + np.arange(width)
        same = text[np.minimum(a[active, None] + at, last)] == text[np.minimum(b[active, None] + at, last)]
        run = np.where(same.all(1), width, np.argmin(same, 1))
        out[active] += run
        active = active[(run == width) & (out[active] < most[active])]
        open_.append(active[out[active] >= upto])
        active, width = active[out[active] < upto], min(2 * width, 32)
    return np.concatenate(open_) if open_ else active


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share, up to ``most`` of each pair.

    Of pairs that lie equally far apart each is compared up to where the next one begins; if it shares all that, the next
    one tells the rest. So the long common prefixes of a repeat's suffixes are not compared over and over."""
    out = np.zeros(len(a), np.int64)
    active = _compare(text, a, b, most, out, np.arange(len(a)), _NEAR)
    if not len(active):
        return np.minimum(out, most)
    active = active[np.lexsort((a[active], b[active] - a[active]))]
    x, apart = a[active], b[active] - a[active]
    step, end = np.diff(x), x + most[active]
    # the next one begins within what is compared of this one, and goes as far
    linked = np.append((np.diff(apart) == 0) & (step > 0) & (x[1:] <= end[:-1]) & (end[1:] >= end[:-1]), False)
    ends = active[~linked]
    _compare(text, a, b, most, out, ends, _LOW + 1)
    unlike = np.zeros(len(active), np.int64)  # the first place known where a pair differs
    unlike[~linked] = x[~linked] + out[ends]
    own = np.flatnonzero(linked)
    for block in np.split(own, np.flatnonzero(np.diff(np.cumsum(step[own]) // CHUNK)) + 1) if len(own) else []:
        size = step[block]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(x[block] + out[active[block]] - begin, size)
        other = np.minimum(at + np.repeat(apart[block], size), len(text) - 1)
        same = text[np.minimum(at, len(text) - 1)] == text[other]
        unlike[block] = np.minimum.reduceat(np.where(same, _NONE, at), begin)
    run = np.cumsum(np.r_[0, ~linked[:-1]])  # the last of a run knows its place, so that no run sees another's
    place = np.minimum.accumulate((unlike + run * (2 * _NONE))[::-1])[::-1] - run * (2 * _NONE)
    out[active] = place - x
    return np.minimum(out, most)


class _Least:
    """Least of any range of a block, by minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 1 << len(self.rows) <= len(values):
            row, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(row[:-half], row[half:]))
        self.table = np.full((len(self.rows), len(values)), _LOW, np.int64)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From low to high, both included."""
        k = np.log2(high - low + 1).astype(np.int64)
        return np.minimum(self.table[k, low], self.table[k, high + 1 - (np.int64(1) << k)])


class _Emitter:
    """Deals predecessors to their buckets, with what they share with the one dealt to the bucket before."""

    def __init__(self, symbols: int, depth: int, with_shared: bool):
        self.depth = depth
        self.least = np.full(symbols, depth, np.int64) if with_shared else None

    def emit(self, queue: Queues, symbols: np.ndarray, pos: np.ndarray, index: np.ndarray, shared: np.ndarray) -> None:
        """symbols and pos of the predecessors of the block's tuples at ``index``; shared of the whole block."""
        order = np.argsort(symbols, kind="stable")
        symbols, pos, index = symbols[order], pos[order], index[order]
        first = np.ones(len(symbols), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        value = np.zeros(len(symbols), np.int64)
        if self.least is not None:
            table = _Least(shared)
            if len(symbols):
                low = np.where(first, 0, np.r_[0, index[:-1] + 1])
                value = table.of(low, index)
                value[first] = np.minimum(value[first], self.least[symbols[first]])
                value = np.minimum(value + 1, self.depth)
            np.minimum(self.least, shared.min(), out=self.least)
            if len(symbols):
                last = np.append(first[1:], True)
                tail, owner = index[last] + 1, symbols[last]
                open_ = tail < len(shared)
                self.least[owner] = self.depth
                self.least[owner[open_]] = table.of(tail[open_], np.full(open_.sum(), len(shared) - 1))
        if not len(symbols):
            return
        begin = np.flatnonzero(first)
        packed = _pack(pos, value)
        for a, b in zip(begin, np.append(begin[1:], len(symbols)), strict=True):
            queue.put(int(symbols[a]), packed[a:b])


def _induce(text: np.ndarray, seeds: Queues, used: np.ndarray, symbols: int, depth: int, memory: int, chunk: int, with_shared: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, shared with the position before) of all suffixes, from the greatest to the least.
    ``used``: the symbols that occur, in order."""
    larger, smaller, ordered = Queues(memory // 4), Queues(memory // 4), Queues(memory // 4)
    most = np.array([depth])

    def border(a: int, b: int) -> int:
        return int(shared_prefix(text, np.array([a]), np.array([b]), most)[0]) if with_shared else 0

    emitter = _Emitter(symbols, depth, with_shared)
    for c in used.tolist():
        before = None  # the tuple of this bucket that was read last
        for queue in (larger, seeds):
            entered = False
            while (block := queue.take(c, chunk)) is not None:
                pos, shared = block >> 16, block & _LOW
                if not entered:
                    shared = shared.copy()
                    shared[0] = 0 if before is None else border(before, pos[0])
                    entered = True
                before = pos[-1]
                if queue is larger:
                    ordered.put(c, _pack(pos, shared))
                index = np.flatnonzero(pos > 0)
                symbol = np.asarray(text[pos[index] - 1])
                keep = symbol >= c if queue is larger else symbol > c
                emitter.emit(larger, symbol[keep], pos[index[keep]] - 1, index[keep], shared)
    emitter = _Emitter(symbols, depth, with_shared)
    smaller.put(0, _pack(np.array([len(text) - 1]), np.zeros(1, np.int64)))
    for c in used[::-1].tolist():
        before = following = None  # what the tuple read last shares with the next one of its queue
        for queue in (smaller, ordered):
            entered = False
            while (block := queue.take(c, chunk, last=queue is ordered)) is not None:
                if queue is ordered:  # what a tuple shares with the lesser one before it belongs to that one now
                    block = block[::-1]
                    pos, own = block >> 16, block & _LOW
                    shared = np.r_[following if entered else 0, own[:-1]]
                    following = own[-1]
                else:
                    pos, shared = block >> 16, block & _LOW
                if not entered:
                    shared = shared.copy()
                    shared[0] = 0 if before is None else border(before, pos[0])
                    entered = True
                before = pos[-1]
                yield pos, shared
                index = np.flatnonzero(pos > 0)
                symbol = np.asarray(text[pos[index] - 1])
                keep = symbol <= c if queue is smaller else symbol < c
                emitter.emit(smaller, symbol[keep], pos[index[keep]] - 1, index[keep], shared)
    for q in (larger, smaller, ordered):
        q.close()


def leftmost(text: np.ndarray, memory: int, chunk: int) -> np.ndarray:
    """Positions of the left-most S-type suffixes, by blocks from the right."""
    n = len(text)
    found = []
    small_right, symbol_right = True, int(text[n - 1])
    for end in range(n - 1, 0, -chunk):
        start = max(0, end - chunk)
        own = np.asarray(text[start:end]).astype(np.int64)
        step = np.append(own[1:], symbol_right) - own
        turn = np.where(step != 0, np.arange(len(own)), len(own))
        turn = np.minimum.accumulate(turn[::-1])[::-1]
        small = np.append(step > 0, small_right)[turn]
        right = np.append(small[1:], small_right)
        found.append(start + np.flatnonzero(right & ~small)[::-1] + 1)
        small_right, symbol_right = bool(small[0]), int(own[0])
    total = sum(map(len, found))
    out, at = scratch(total, np.int64, memory), total
    for block in found:
        out[at - len(block) : at] = block[::-1]
        at -= len(block)
    return out


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by at least their first ``depth`` names."""
    rank, h, n = np.asarray(names).astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if h >= depth or new[-1] == n - 1:
            return order


def _used(text: np.ndarray, symbols: int, chunk: int) -> np.ndarray:
    there = np.zeros(symbols, bool)
    for start in range(0, len(text), chunk):
        there[text[start : start + chunk]] = True
    return np.flatnonzero(there)


def _seeded(text: np.ndarray, order: Iterator[np.ndarray] | np.ndarray, depth: int, memory: int, chunk: int, with_shared: bool) -> Queues:
    """Queues of the positions in order, with what each shares with the one before."""
    seeds, before = Queues(memory // 4), None
    for start in range(0, len(order), chunk):
        pos = np.asarray(order[start : start + chunk])
        symbol, shared = np.asarray(text[pos]), np.zeros(len(pos), np.int64)
        if with_shared:
            left = np.r_[pos[:1] if before is None else before, pos[:-1]]
            shared = shared_prefix(text, left, pos, np.full(len(pos), depth))
            before = pos[-1]
        rank = np.argsort(symbol, kind="stable")
        pos, symbol, shared = pos[rank], symbol[rank], shared[rank]
        cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        packed = _pack(pos, shared)
        for a, b in zip(cuts, np.append(cuts[1:], len(pos)), strict=True):
            seeds.put(int(symbol[a]), packed[a:b])
    return seeds


def suffixes(text: np.ndarray, symbols: int, depth: int, memory: int = MEMORY, chunk: int = CHUNK, with_shared: bool = True, levels: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, shared) of all suffixes from the greatest to the least, in order of at least their first
    ``depth`` symbols; shared (at most ``depth``) is what a suffix has in common with the one before it in the stream.
    ``levels`` is given the number of names of each recursion."""
    if depth > _LOW:
        raise ValueError(f"common prefixes over {_LOW} symbols are not kept")
    used = _used(text, symbols, chunk)
    seats = leftmost(text, memory, chunk)
    if len(seats) > 1:
        # substrings from one left-most suffix to the next, by an induction from unsorted seeds
        by_substring = scratch(len(seats), np.int64, memory)
        at = len(seats)
        seeds = _seeded(text, seats, depth, memory, chunk, False)
        for pos, _ in _induce(text, seeds, used, symbols, depth, memory, chunk, False):
            place = np.minimum(np.searchsorted(seats, pos), len(seats) - 1)
            place = place[seats[place] == pos]
            by_substring[at - len(place) : at] = place[::-1]
            at -= len(place)
        seeds.close()
        names, name, before = scratch(len(seats), np.int64, memory), -1, None
        for start in range(0, len(seats), chunk):
            place = np.asarray(by_substring[start : start + chunk])
            left = np.r_[place[:1] if before is None else before, place[:-1]]
            size = lambda k: np.asarray(seats[np.minimum(k + 1, len(seats) - 1)]) + 1 - np.asarray(seats[k])
            a, b = size(left), size(place)
            unlike = (a != b) | (shared_prefix(text, np.asarray(seats[left]), np.asarray(seats[place]), np.minimum(a, b)) < b)
            unlike[0] |= before is None
            number = name + np.cumsum(unlike)
            names[place] = number
            name, before = int(number[-1]), place[-1]
        if levels is not None:
            levels.append(name + 1)
        if name + 1 < len(seats):
            # a left-most substring has at least two symbols that the next one doesn't
            need = depth // 2 + 2
            if 32 * len(seats) <= memory:
                order = _doubling(names, need)
            else:
                order, at = scratch(len(seats), np.int64, memory), len(seats)
                for pos, _ in suffixes(names, name + 1, min(need, _LOW), memory, chunk, False, levels):
                    order[at - len(pos) : at] = pos[::-1]
                    at -= len(pos)
            by_substring = order
        final = scratch(len(seats), np.int64, memory)
        for start in range(0, len(seats), chunk):
            final[start : start + chunk] = seats[by_substring[start : start + chunk]]
        seats = final
    seeds = _seeded(text, seats, depth, memory, chunk, with_shared)
    yield from _induce(text, seeds, used, symbols, depth, memory, chunk, with_shared)
    seeds.close()
