"""The order of all suffixes of a shard by induced sorting.

Suffixes that are less than the one before them in the text (leftmost-S) are sorted first: their substrings get names by one
induction, and the names, doubled in length round after round, give their order. A second induction carries that order
to all suffixes. Each induction moves batches of suffixes through 256 queues, one for each first byte, which together are a priority
queue; a queue that grows beyond MEMORY_ITEMS keeps its batches in an unlinked file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes that all queues of a shard hold in memory; more go to disk.
MEMORY_ITEMS = 16_000_000
#: Suffixes in a batch.
BATCH = 1 << 20


class Queue:
    """Positions, first in, first out, also while they are being read; those beyond the room that all queues share go to a file."""

    def __init__(self, room: list[int]):
        self.room, self.memory, self.file, self.filed = room, [], None, 0

    def put(self, batch: np.ndarray) -> None:
        if self.file is None and self.room[0] >= len(batch):
            self.room[0] -= len(batch)
            self.memory.append(batch)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(8 * self.filed)
        self.file.write(batch.astype(np.int64).tobytes())
        self.filed += len(batch)

    def _read(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(8 * start)
        return np.frombuffer(self.file.read(8 * (stop - start)), np.int64)

    def __iter__(self) -> Iterator[np.ndarray]:
        """What has been put so far, as few batches as can be, until nothing more comes."""
        seen = 0
        while seen < len(self.memory):
            new = self.memory[seen:]
            seen += len(new)
            yield np.concatenate(new)
        seen = 0
        while seen < self.filed:
            stop = min(self.filed, seen + BATCH)
            yield self._read(seen, stop)
            seen = stop

    def backwards(self) -> Iterator[np.ndarray]:
        for stop in range(self.filed, 0, -BATCH):
            yield self._read(max(0, stop - BATCH), stop)[::-1]
        if self.memory:
            yield np.concatenate(self.memory)[::-1]


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one. The end of the text is less than any byte."""
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if n else np.zeros(0, np.int64)
    rises = np.append(text[change[:-1]] < text[change[:-1] + 1], False) if n else np.zeros(0, bool)
    return np.repeat(rises, np.diff(np.append(-1, change)))


def _deal(batch: np.ndarray, text: np.ndarray, wanted: np.ndarray, queues: list[Queue]) -> None:
    """Puts the suffixes before those of the batch, where wanted, into the queues of their first bytes, in order."""
    for at in range(0, len(batch), BATCH):
        before = batch[at : at + BATCH] - 1
        before = before[before >= 0]
        before = before[wanted[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            sorted_, first = before[order], first[order]
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                queues[first[a]].put(sorted_[a:b])


def induce(text: np.ndarray, s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-S ones in theirs; if those are sorted by first byte alone, all are sorted by their substrings up to the next one."""
    room = [MEMORY_ITEMS]
    low, high = [Queue(room) for _ in range(256)], [Queue(room) for _ in range(256)]
    n = len(text)
    bounds = np.searchsorted(text[seeds], np.arange(257)) if len(seeds) else np.zeros(257, np.int64)
    low[text[n - 1]].put(np.array([n - 1]))
    for c in range(256):
        for batch in low[c]:
            _deal(batch, text, ~s, low)
        _deal(seeds[bounds[c] : bounds[c + 1]], text, ~s, low)
    for c in reversed(range(256)):
        for batch in high[c]:
            _deal(batch, text, s, high)
        for batch in low[c].backwards():
            _deal(batch, text, s, high)
    out = np.empty(n, np.int64)
    at = 0
    for c in range(256):
        for batch in low[c]:
            out[at : at + len(batch)] = batch
            at += len(batch)
        for batch in high[c].backwards():
            out[at : at + len(batch)] = batch
            at += len(batch)
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes from a and from b are equal."""
    out = np.ones(len(a), bool)
    open_, k = np.arange(len(a)), 0
    while len(open_):
        open_ = open_[length[open_] > k]
        equal = text[a[open_] + k] == text[b[open_] + k]
        out[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The positions of text (bytes) in the order of their suffixes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    s = s_types(text)
    left = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(left):
        return induce(text, s, left)
    rough = induce(text, s, left[np.argsort(text[left], kind="stable")])
    is_left = np.zeros(n, bool)
    is_left[left] = True
    rough = rough[is_left[rough]]
    # Names: equal for equal substrings, from one leftmost-S suffix to the next, both first bytes included.
    place = np.searchsorted(left, rough)
    length = np.append(np.diff(left) + 1, n - left[-1])[place]
    new = np.ones(len(rough), bool)
    alike = np.flatnonzero(length[1:] == length[:-1])
    alike = alike[(place[alike] != len(left) - 1) & (place[alike + 1] != len(left) - 1)]
    new[1 + alike] = ~_same(text, rough[alike], rough[alike + 1], length[alike])
    name = np.empty(len(left), np.int64)
    name[place] = np.cumsum(new)  # from 1; 0 is the end
    order, width = place, 1
    while name.max() < len(left):
        after = np.zeros(len(left), np.int64)
        after[: -width or None] = name[width:] if width < len(left) else 0
        key = name * (len(left) + 1) + after
        order = np.argsort(key, kind="stable")
        name[order] = np.cumsum(np.append(True, np.diff(key[order]) != 0))
        width *= 2
    order = np.empty(len(left), np.int64)
    order[name - 1] = np.arange(len(left))
    return induce(text, s, left[order])


