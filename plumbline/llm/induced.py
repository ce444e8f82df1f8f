"""External induced suffix sorting of one shard: suffixes in order, with common-prefix values up to a bound.

As in external-memory induced sorting (Bingmann, Fischer and Osipov 2013), only the left-most suffixes of ascending runs
are sorted, by names and recursion; all others are induced from them by two sweeps. A sweep takes suffix tuples (position,
common-prefix value) out of a priority queue in the order of their first character and puts in the tuples of the
suffixes that begin one character earlier. The queue hands out a whole character at a time, so a sweep works on arrays.

Text, queues, seeds and orders lie in files of a folder given by the caller; memory holds `memory` queued tuples and the
one character being worked on. A reduced text of at most `inner` names is sorted in memory by prefix doubling instead.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator

import numpy as np

MEMORY, INNER = 8_000_000, 1_000_000
#: Arrays of up to so many bytes stay in memory; queue runs never do.
SMALL = 64_000_000


def on_disk(folder: str, name: str, n: int, dtype) -> np.ndarray:
    """A new array in a file of the folder."""
    if not n:
        return np.zeros(0, dtype)
    return np.memmap(os.path.join(folder, f"{name}-{uuid.uuid4().hex}"), dtype, "w+", shape=(n,))


def array(folder: str, name: str, n: int, dtype) -> np.ndarray:
    """A new array of zeros: in memory if it is small, else in a file of the folder."""
    return np.zeros(n, dtype) if n * np.dtype(dtype).itemsize <= SMALL else on_disk(folder, name, n, dtype)


class DiskQueue:
    """Priority queue of tuples (character; position, common prefix), first in first out within a character.

    Beyond `memory` tuples everything held is written as one run, ordered by character; runs are older than what is in
    memory, so taking a character from run after run keeps the order of arrival.
    """

    def __init__(self, folder: str, memory: int, descending: bool):
        self.folder, self.memory, self.sign = folder, memory, -1 if descending else 1
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size, self.runs, self.keys, self.known = 0, [], [], set()

    def put(self, chars: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
        """Tuples grouped by ascending character, in order of arrival within one."""
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(chars)], strict=True):
            key = int(chars[low])
            if key not in self.known:
                self.known.add(key)
                heapq.heappush(self.keys, self.sign * key)
            self.held.setdefault(key, []).append((positions[low:high], common[low:high]))
        self.size += len(chars)
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        places, at = {}, 0
        rows, values = on_disk(self.folder, "run", self.size, np.int64), on_disk(self.folder, "run", self.size, np.uint8)
        for key in sorted(self.held):
            begin = at
            for p, c in self.held[key]:
                rows[at : at + len(p)], values[at : at + len(p)] = p, c
                at += len(p)
            places[key] = (begin, at)
        self.runs.append((places, rows, values))
        self.held, self.size = {}, 0

    def take(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a character."""
        parts = [(rows[slice(*places[key])], values[slice(*places.pop(key))]) for places, rows, values in self.runs if key in places]
        own = self.held.pop(key, [])
        self.size -= sum(len(p) for p, _ in own)
        parts += own
        for places, rows, values in self.runs:
            if not places:  # all taken: the files can go
                os.unlink(rows.filename)
                os.unlink(values.filename)
        self.runs = [r for r in self.runs if r[0]]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def next(self) -> int | None:
        """The character whose turn it is, without taking it."""
        while self.keys and (key := self.sign * self.keys[0]) not in self.held and not any(key in r[0] for r in self.runs):
            self.known.discard(key)
            heapq.heappop(self.keys)
        return self.sign * self.keys[0] if self.keys else None


def run_starts(text: np.ndarray) -> np.ndarray:
    """Positions where an ascending run begins (S* suffixes); found block by block from the end."""
    n, out, block = len(text), [], 1 << 22
    ascends_after = False  # type of the suffix after the block: the last one descends to the end mark
    for low in range(max(0, (n - 1) // block * block), -1, -block):
        part = text[low : min(low + block + 1, n)]
        m = min(block, n - low)
        step = np.sign(part[1:].astype(np.int64) - part[:-1].astype(np.int64))[:m]
        if len(step) < m:
            step = np.append(step, -1)
        where = np.where(step != 0, np.arange(m), m)
        decides = np.minimum.accumulate(where[::-1])[::-1]
        ascends = np.where(decides < m, np.append(step, 1 if ascends_after else -1)[decides] > 0, ascends_after)
        before = text[low - 1] if low else None
        first = np.flatnonzero(ascends[1:] & ~ascends[:-1]) + 1 + low
        out.append(first)
        if low and ascends[0] and before > part[0]:  # equal characters have the type of their successor
            out.append(np.array([low]))
        ascends_after = bool(ascends[0])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, at most `bound`."""
    out, live, n = np.zeros(len(a), np.uint8), np.arange(len(a)), len(text)
    for k in range(bound):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] = k + 1
    return out


class _Sweep:
    """Puts the predecessors of processed suffixes into a queue, with their common-prefix values."""

    def __init__(self, text: np.ndarray, queue: DiskQueue, bound: int, up: bool):
        self.text, self.queue, self.bound, self.up = text, queue, bound, up
        self.least: dict[int, int] = {}  # smallest value since the last tuple of a character
        self.floor = bound

    def process(self, char: int, positions: np.ndarray, common: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queues the predecessors; those of the same character are returned, as they come next. strict: only others count."""
        before = positions - 1
        there = before >= 0
        chars = np.full(len(before), -1, np.int64)
        chars[there] = self.text[before[there]]
        fits = there & ((chars > char if strict else chars >= char) if self.up else (chars < char if strict else chars <= char))
        index = np.flatnonzero(fits)
        order = index[np.argsort(chars[index], kind="stable")]
        own = chars[order]
        values = self._values(common, order, own) if self.bound else np.zeros(len(order), np.uint8)
        same = own == char
        if not same.all():
            self.queue.put(own[~same], before[order[~same]], values[~same])
        return before[order[same]], values[same]

    def _values(self, common: np.ndarray, order: np.ndarray, own: np.ndarray) -> np.ndarray:
        out, m = np.zeros(len(order), np.uint8), len(common)
        lowest = int(common.min()) if m else self.bound
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        ends = {}
        for low, high in zip([0, *cuts], [*cuts, len(own)], strict=True) if len(own) else ():
            rows, key = order[low:high], int(own[low])
            begin = np.concatenate([[0], rows + 1])
            parts = np.minimum.reduceat(np.append(common, np.uint8(self.bound)), begin)
            got = parts[:-1].astype(np.int64)
            got[0] = min(got[0], self.least.get(key, 0))
            out[low:high] = np.minimum(got + 1, self.bound)
            ends[key] = int(parts[-1]) if rows[-1] + 1 < m else self.bound
        for key in self.least:
            self.least[key] = min(self.least[key], lowest)
        self.least.update(ends)
        return out


def sweeps(text: np.ndarray, seeds: np.ndarray, folder: str, bound: int = 0, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both sweeps. Yields, from the last character to the first, all its suffixes in ascending order and the common
    prefix (at most `bound`) of each with the one before, 0 for the first. `seeds` are the S* suffixes in order."""
    n = len(text)
    if not n:
        return
    seed_common = np.zeros(len(seeds), np.uint8)
    if bound:
        for low in range(1, len(seeds), 1 << 20):
            high = min(len(seeds), low + (1 << 20))
            seed_common[low:high] = common_prefix(text, seeds[low - 1 : high - 1], seeds[low:high], bound)
    seed_chars = text[seeds] if len(seeds) else np.zeros(0, text.dtype)
    cuts = np.concatenate([[0], np.flatnonzero(seed_chars[1:] != seed_chars[:-1]) + 1, [len(seeds)]]).astype(np.int64) if len(seeds) else np.zeros(1, np.int64)
    seed_range = {int(seed_chars[a]): (int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    queue = DiskQueue(folder, memory, descending=False)
    sweep = _Sweep(text, queue, bound, up=True)
    queue.put(text[n - 1 :].astype(np.int64), np.array([n - 1]), np.zeros(1, np.uint8))
    falling, count = array(folder, "falling", n, np.int64), 0
    falling_common = array(folder, "falling", n, np.uint8)
    falling_range: dict[int, tuple[int, int]] = {}
    waiting = sorted(seed_range, reverse=True)
    while True:
        char = queue.next()
        if waiting and (char is None or waiting[-1] < char):
            char = waiting[-1]
        if char is None:
            break
        begin, last = count, None
        batch, common = queue.take(char)
        if len(batch):
            common[0] = 0
        while len(batch):
            falling[count : count + len(batch)], falling_common[count : count + len(batch)] = batch, common
            count += len(batch)
            last = batch[-1:]
            batch, common = sweep.process(char, batch, common, strict=False)
        falling_range[char] = (begin, count)
        if waiting and waiting[-1] == char:
            a, b = seed_range[waiting.pop()]
            common = seed_common[a:b].copy()
            common[0] = common_prefix(text, last, seeds[a : a + 1], bound)[0] if bound and last is not None else 0
            sweep.process(char, seeds[a:b], common, strict=True)

    queue = DiskQueue(folder, memory, descending=True)
    sweep = _Sweep(text, queue, bound, up=False)
    waiting = sorted(k for k, (a, b) in falling_range.items() if b > a)
    while True:
        char = queue.next()
        if waiting and (char is None or waiting[-1] > char):
            char = waiting[-1]
        if char is None:
            break
        parts, values, last = [], [], None
        batch, common = queue.take(char)
        if len(batch):
            common[0] = 0
        while len(batch):
            parts.append(batch)
            values.append(common)
            last = batch[-1:]
            batch, common = sweep.process(char, batch, common, strict=False)
        rising = np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int64)
        rising_common = np.concatenate(values)[::-1] if parts else np.zeros(0, np.uint8)  # with the one after
        down, down_common, join = np.zeros(0, np.int64), np.zeros(0, np.uint8), 0
        if waiting and waiting[-1] == char:
            a, b = falling_range[waiting.pop()]
            down, down_common = np.array(falling[a:b]), np.array(falling_common[a:b])
            if bound and last is not None:
                join = int(common_prefix(text, down[-1:], last, bound)[0])
            backwards = np.concatenate([[join], down_common[:0:-1]]).astype(np.uint8)
            sweep.process(char, down[::-1], backwards, strict=True)
        between = np.concatenate([[join if len(down) else 0], rising_common[:-1]]).astype(np.uint8) if len(rising) else rising_common
        yield np.concatenate([down, rising]), np.concatenate([down_common, between])


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a short sequence, in memory."""
    rank, n, reach = names.astype(np.int64), len(names), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == n:
            return np.argsort(rank, kind="stable")
        reach *= 2


def seeds_in_order(text: np.ndarray, folder: str, memory: int = MEMORY, inner: int = INNER) -> np.ndarray:
    """All S* suffixes in order: their substrings are sorted by a first pair of sweeps, named, and the names sorted by recursion."""
    starts = run_starts(text)
    if len(starts) < 2:
        return starts
    is_start = array(folder, "starts", len(text), bool)
    is_start[starts] = True
    chars = text[starts]
    rough = starts[np.argsort(chars, kind="stable")]
    found = [p[is_start[p]][::-1] for p, _ in sweeps(text, rough, folder, 0, memory)]
    order = np.concatenate(found)[::-1]
    # A substring ends with the next start; equal neighbours have equal length and content.
    number = array(folder, "numbers", len(text), np.int64)
    number[starts] = np.arange(len(starts))
    ends = np.append(starts[1:], len(text) - 1)
    size = (ends - starts)[number[order]]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    offset = 0
    while len(same):
        here = size[same] >= offset
        new[same[~here]] = False
        same = same[here]
        same = same[text[order[same - 1] + offset] == text[order[same] + offset]]
        offset += 1
    new[np.isin(order, starts[-1])] = True  # the last one ends with the end mark
    after_last = np.flatnonzero(order == starts[-1])[0] + 1
    if after_last < len(new):
        new[after_last] = True
    names = array(folder, "names", len(starts), np.int64)
    names[number[order]] = np.cumsum(new) - 1
    if new.all():
        return order
    if len(names) <= inner:
        ranks = _doubling(names)
    else:
        below = seeds_in_order(names, folder, memory, inner)
        ranks = np.concatenate([p[::-1] for p, _ in sweeps(names, below, folder, 0, memory)])[::-1]
    return starts[ranks]


def suffixes(text: np.ndarray, folder: str, bound: int, memory: int = MEMORY, inner: int = INNER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes, character by character from the last to the first; see sweeps."""
    yield from sweeps(text, seeds_in_order(text, folder, memory, inner), folder, bound, memory)
