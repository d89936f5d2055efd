"""Runs of repeated words, by the Lyndon arrays of the words of a text under an order and its reverse.

Phase one of Baier's suffix sorter alone is needed: suffixes in groups of equal prefixes, the greatest group first, each of which moves
the suffixes before its own into new groups. A group that comes up stays, and the length of its prefix is the longest Lyndon
word at each of its suffixes. Every run holds such a word (its root) of one order or the other at one of its places; so a root that
extends to both sides, by the longest common extensions (LCE), to twice its length is a run, and there are no others.

A run of LEAST words or more repeats at least LEAST / 2 words in a row at the distance of its period. So only stretches of words
whose windows of that many words occur elsewhere in the text can be or touch a run; each stretch is sorted by itself. That loses no run.

Defined results
- A null or empty text has no words and no runs. Words stand between ASCII white space and are compared as they are. Repeated rows are judged
  one by one. An empty table gives an empty result. Very long texts are read whole, in time about linear in their words. Other columns pass through; one
  with the name of an output column (whatever the case) is an error. A text stays within its row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import pieces, refuse, unused, utf8

#: Words that a run has at least.
LEAST = 12
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def lyndon(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place of ranks (0, 1, ... up to the greatest); the end is less than any of them."""
    n, kinds = len(ranks), max(ranks, default=-1) + 1
    # Groups by number: their places (those that have moved on are told by `of`), the length of their prefix, the next lesser and the next greater one.
    held: list[list[int]] = [[] for _ in range(kinds)]
    for i, r in enumerate(ranks):
        held[r].append(i)
    of, width = list(ranks), [1] * kinds
    less, greater = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    # The nearest place to the left, from 1, itself included, that has not been in a group that came up; 0 is none.
    left = list(range(n + 1))
    out = [0] * n
    group = kinds - 1
    while group >= 0:
        members = [i for i in held[group] if of[i] == group]
        held[group], long_ = members, width[group]
        for i in members:
            out[i] = long_
            left[i + 1] = i
        counts: dict[int, int] = {}
        for i in members:
            j = i
            while left[j] != j:
                left[j] = j = left[left[j]]
            if j:
                counts[j - 1] = counts.get(j - 1, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in counts.items():
            by_count.setdefault(k, []).append(j)
        # More copies of this group's prefix make a greater suffix: each new group goes right above the old one, the most copies first.
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:
                old = of[j]
                if old not in moved:
                    new = moved[old] = len(held)
                    held.append([])
                    width.append(width[old] + k * long_)
                    above = greater[old]
                    less.append(old)
                    greater.append(above)
                    greater[old] = new
                    if above < len(less) - 1:
                        less[above] = new
                held[moved[old]].append(j)
                of[j] = moved[old]
        held[group] = []
        group = less[group]
    return out


class Extensions:
    """Names of all windows of 1, 2, 4, ... words: equal windows have equal names."""

    def __init__(self, words: np.ndarray):
        self.n, self.names = len(words), [words.astype(np.int32)]
        while 2 << len(self.names) - 1 <= self.n:
            half, last = 1 << len(self.names) - 1, self.names[-1].astype(np.int64)
            self.names.append(np.unique(last[:-half] * (self.n + 1) + last[half:], return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on are those from b on; a < b."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for k in reversed(range(len(self.names))):
            at = np.flatnonzero(b + (1 << k) <= self.n)
            at = at[self.names[k][a[at]] == self.names[k][b[at]]]
            a[at] += 1 << k
            b[at] += 1 << k
        return a - first

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a are those before b; a < b."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for k in reversed(range(len(self.names))):
            at = np.flatnonzero(a >= 1 << k)
            at = at[self.names[k][a[at] - (1 << k)] == self.names[k][b[at] - (1 << k)]]
            a[at] -= 1 << k
            b[at] -= 1 << k
        return first - a


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The rows (start, period, length) of all runs of least words or more, in order; words are 0, 1, ..."""
    n = len(words)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    extend = Extensions(words)
    found = []
    for ranks in (words, words.max() - words):
        root = np.array(lyndon(ranks.tolist()), np.int64)
        start = np.arange(n)
        start, root = start[start + root < n + 1], root[start + root < n + 1]
        right, left = extend.right(start, start + root), extend.left(start, start + root)
        length = left + root + right
        ok = (length >= 2 * root) & (length >= least)
        found.append(np.stack([start - left, root, length], 1)[ok])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words (as hashes) that hold all runs whole, each with its neighbours in none."""
    n, wide = len(words), least // 2
    if n < least:
        return []
    with np.errstate(over="ignore"):
        grams = np.zeros(n - wide + 1, np.uint64)
        for k in range(wide):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : n - wide + 1 + k]
            grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(same):
        return []
    near = np.full(len(grams), n, np.int64)
    gap = order[same + 1] - order[same]
    near[order[same]] = gap
    near[order[same + 1]] = np.minimum(near[order[same + 1]], gap)
    at = np.flatnonzero(near < n)
    while len(at):
        # Windows that touch or overlap make a stretch; a period in it is half of it at most.
        cuts = np.flatnonzero(np.diff(at) > wide) + 1
        firsts, lasts = np.append(0, cuts), np.append(cuts, len(at))
        long_ = at[lasts - 1] + wide - at[firsts]
        stays = 2 * near[at] <= np.repeat(long_, lasts - firsts)
        if stays.all():
            return [(int(at[a]), int(at[b - 1]) + wide) for a, b in zip(firsts, lasts, strict=True) if at[b - 1] + wide - at[a] >= least]
        at = at[stays]
    return []


def runs_in(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words, by start and period."""
    out = []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for a, b in _stretches(hashes, least):
        named: dict[bytes, int] = {}
        ids = np.fromiter((named.setdefault(w, len(named)) for w in words[a:b]), np.int64, b - a)
        out += [(a + s, length, period) for s, period, length in runs_of(ids, least).tolist()]
    return out


def _look(batches: Iterator[pa.RecordBatch], text: str, least: int, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text):
        data, bounds = utf8(batch.column(text))
        raw = data.tobytes()
        found, kept = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            words = raw[a:b].split()
            runs = runs_in(words, least)
            if runs:
                drop = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with ``runs``, an array of (start, length, period) in words from 0, by start and period, and ``collapsed``: the words, joined by one space, without
    those that any run holds after its first period."""
    refuse(df, "runs", "collapsed")
    read = unused("_read", df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    names = schema.names
    return df.withColumn(read, F.coalesce(F.col(text), F.lit(""))).mapInArrow(lambda batches: _look(batches, read, least, kind, names), schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length, of these the one with the smallest start, then period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
