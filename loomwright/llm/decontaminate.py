"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Both sides keep, from every SPAN - K + 1
neighbouring K-grams, the one with the least hash, so that each shared run of SPAN words shares a kept K-gram. Kept K-grams of
the documents are looked up among those of the benchmark, and each hit is extended, word by word, to the longest shared run.
Items of fewer than SPAN words count where they occur whole; they are looked up by their first words.

Defined results
- A null or empty text has no words: nothing hit, not contaminated. An item without words hits nothing. One without an id hits, but is
  never listed.
- Repeated rows are judged one by one; items with equal texts are all listed; a repeated item is listed once. An empty
  benchmark hits nothing. Other columns of the documents pass through.
- A benchmark of up to BLOCK_BYTES travels to the executors whole; fingerprints of a larger one are joined with those of the documents, which
  gives the same result.
- Very long texts are read whole. A column with the name of an output column (whatever the case) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import pieces, refuse, saved, unused, utf8

SPAN, K = 13, 5
#: Bytes of benchmark text that are broadcast, at most.
BLOCK_BYTES = 32_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of many texts: folded bytes, each word's start, end, hash and text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = _FOLD[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IS_WORD[self.data]
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        cuts = bounds[1:-1][bounds[1:-1] < len(data)]
        first[cuts] |= inside[:-1][cuts]
        last = inside[:-1] & ~inside[1:]
        last[cuts[cuts > 0] - 1] |= inside[:-1][cuts[cuts > 0] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, bounds)  # of the words of each text
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A polynomial over each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        total = np.zeros(len(self.start), np.uint64)
        at, power, k = np.arange(len(self.start)), np.uint64(1), 0
        pending = at
        while len(pending):  # one round for each letter place; few words are long
            total[pending] += (self.data[self.start[pending] + k].astype(np.uint64) + np.uint64(1)) * power
            k += 1
            if k == 64:
                break
            with np.errstate(over="ignore"):
                power = power * _ODD
            pending = pending[length[pending] > k]
        for i in np.flatnonzero(length > 64):  # the rest of very long words
            total[i] += np.frombuffer(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        return _mixed(total + length.astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, across texts too."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out + self.hash[j : j + n]) * _ODD
        return _mixed(out)

    @cached_property
    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the K-grams that are least in some run of SPAN words; found once."""
        grams, wide = self.grams(K), SPAN - K + 1
        n = len(grams) - wide + 1
        if n <= 0:
            return np.zeros(0, np.int64), grams[:0]
        least = grams[:n].copy()
        for j in range(1, wide):
            np.minimum(least, grams[j : j + n], out=least)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        within = owner[:n] == owner[SPAN - 1 : SPAN - 1 + n]  # runs across texts select nothing
        kept = np.zeros(len(grams), bool)
        for j in range(wide):
            kept[j : j + n] |= (grams[j : j + n] == least) & within
        at = np.flatnonzero(kept)
        return at, grams[at]

    def same(self, i: int, other: Words, j: int) -> bool:
        return self.hash[i] == other.hash[j] and self.data[self.start[i] : self.end[i]].tobytes() == other.data[other.start[j] : other.end[j]].tobytes()


class BenchmarkIndex:
    """Fingerprints of benchmark items, sorted by hash."""

    def __init__(self, ids: list[str | None], texts: list[str]):
        self.ids = ids
        self.words = Words(*utf8(pa.array(texts, pa.large_string())))
        self.sizes = np.diff(self.words.bounds)
        at, grams = self.words.winnowed
        order = np.argsort(grams, kind="stable")
        self.hashes, self.at = grams[order], at[order]
        self.item = np.repeat(np.arange(len(ids)), self.sizes)
        self.short = {}  # size -> sorted hashes of whole items, and the items
        for size in np.unique(self.sizes[(self.sizes > 0) & (self.sizes < SPAN)]):
            items = np.flatnonzero(self.sizes == size)
            hashes = self.words.grams(int(size))[self.words.bounds[items]]
            order = np.argsort(hashes, kind="stable")
            self.short[int(size)] = hashes[order], items[order]

    def hits(self, docs: Words) -> list[tuple[int, int, int, int]]:
        """(document, first word, end, item) of each shared run of SPAN words or more, and of each whole shorter item."""
        found: list[tuple[int, int, int, int]] = []
        at, grams = docs.winnowed
        low, high = np.searchsorted(self.hashes, grams), np.searchsorted(self.hashes, grams, "right")
        hit = np.flatnonzero(high > low)
        reached: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the last run
        covered: dict[int, tuple[int, int]] = {}  # item -> the last run of SPAN words or more
        places: dict[int, list[tuple[int, list[int]]]] = {}  # a hash's items, each with its places
        for k in hit:
            p, at_hash = int(at[k]), int(low[k])
            doc = int(np.searchsorted(docs.bounds, p, "right")) - 1
            first, stop = int(docs.bounds[doc]), int(docs.bounds[doc + 1])
            if at_hash not in places:
                by_item: dict[int, list[int]] = {}
                for q in np.sort(self.at[low[k] : high[k]]).tolist():
                    by_item.setdefault(int(self.item[q]), []).append(q)
                places[at_hash] = list(by_item.items())
            for item, several in places[at_hash]:
                begin, over = int(self.words.bounds[item]), int(self.words.bounds[item + 1])
                for q in several:
                    # Where the item has been found in all runs of SPAN words that hold this gram, no other diagonal adds a word.
                    s, t = covered.get(item, (stop, 0))
                    if max(first, p - SPAN + K) >= s and min(stop, p + SPAN) <= t:
                        break
                    if reached.get((item, p - q), -1) > p:
                        continue
                    i, j = p, q
                    while i > first and j > begin and docs.same(i - 1, self.words, j - 1):
                        i, j = i - 1, j - 1
                    e, f = p, q
                    while e < stop and f < over and docs.same(e, self.words, f):
                        e, f = e + 1, f + 1
                    reached[item, p - q] = max(e, p + 1)
                    if e - i >= SPAN:
                        found.append((doc, i - first, e - first, item))
                        covered[item] = (i, e) if not s <= i <= t else (s, max(e, t))
        for size, (hashes, items) in self.short.items():
            grams = docs.grams(size)
            low, high = np.searchsorted(hashes, grams), np.searchsorted(hashes, grams, "right")
            for p in np.flatnonzero(high > low).tolist():
                doc = int(np.searchsorted(docs.bounds, p, "right")) - 1
                if p + size > docs.bounds[doc + 1]:
                    continue
                for item in items[low[p] : high[p]].tolist():
                    q = int(self.words.bounds[item])
                    if all(docs.same(p + d, self.words, q + d) for d in range(size)):
                        found.append((doc, p - int(docs.bounds[doc]), p + size - int(docs.bounds[doc]), item))
        return found


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words (long), hit_spans (array of word ranges, merged) and hit_items (item ids, sorted as strings)."""
    refuse(df, "n_words", "hit_spans", "hit_items", "n_hit", "contaminated")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).dropna(subset="t").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0)).alias("n")).first()["n"]
    if total > block_bytes:
        return _joined(df, items, text)
    rows = items.collect()
    shared = df.sparkSession.sparkContext.broadcast(BenchmarkIndex([r["i"] for r in rows], [r["t"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in pieces(batches, text):
            docs = Words(*utf8(batch.column(text)))
            ranges: list[list] = [[] for _ in range(batch.num_rows)]
            found: list[set] = [set() for _ in range(batch.num_rows)]
            for doc, i, e, item in index.hits(docs):
                ranges[doc].append((i, e))
                if index.ids[item] is not None:
                    found[doc].add(index.ids[item])
            new = [pa.array(np.diff(docs.bounds), pa.int64()), pa.array(list(map(_merged, ranges)), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(list(map(sorted, found)), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_words", "hit_spans", "hit_items"])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]))


def _prints(rows: DataFrame, key: str, sizes: list[int], items: bool) -> DataFrame:
    """(key, size, gram), once each: the kept K-grams (size 0); of items of fewer than SPAN words the whole, by their size; of documents all grams of these sizes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            words = Words(*utf8(batch.column("t")))
            n = np.diff(words.bounds)
            of, size, gram = [], [], []

            def add(at: np.ndarray, k: int, grams: np.ndarray) -> None:
                of.append(np.searchsorted(words.bounds, at, "right") - 1)
                size.append(np.full(len(at), k))
                gram.append(grams)

            add(words.winnowed[0], 0, words.winnowed[1])
            for k in sizes:
                grams = words.grams(k)
                at = words.bounds[:-1][n == k] if items else np.arange(len(grams))
                owner = np.searchsorted(words.bounds, at, "right") - 1
                at = at[at + k <= words.bounds[owner + 1]]
                add(at, k, grams[at])
            table = pd.DataFrame({"row": np.concatenate(of), "size": np.concatenate(size), "gram": np.concatenate(gram).view(np.int64)}).drop_duplicates()
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(table["row"])), pa.array(table["size"], pa.int32()), pa.array(table["gram"], pa.int64())], names=[key, "size", "gram"])

    return rows.select(key, "t").mapInArrow(scan, f"{key} long, size int, gram long")


def _joined(df: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """find_contamination by a join of fingerprints: documents and items that share one are then compared, an item at a time."""
    doc, n_words, spans, ids = "_doc", "n_words", "hit_spans", "hit_items"
    doc = unused(doc, df.columns)
    docs = saved(df.withColumn(doc, F.monotonically_increasing_id()), "decontaminate-documents")
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tests = saved(items.groupBy("t").agg(F.collect_set("i").alias("ids")).withColumn("item", F.monotonically_increasing_id()), "decontaminate-items")
    short = range(1, SPAN)
    of_items = saved(_prints(tests, "item", list(short), items=True), "decontaminate-fingerprints")
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect() if r["size"])  # less than SPAN of them
    pairs = _prints(texts, "doc", sizes, items=False).join(of_items, ["size", "gram"]).select("doc", "item").distinct()
    # Each document comes before the items to compare it with; a task holds one document and one item.
    asked = pairs.join(tests, "item").select("doc", F.lit(1).alias("place"), "t", "ids")
    first = texts.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", F.lit(0).alias("place"), "t", F.lit(None).cast("array<string>").alias("ids"))
    both = first.unionByName(asked).repartition("doc").sortWithinPartitions("doc", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            of, ranges, listed = [], [], []
            for key, place, t, names in zip(*(batch.column(c).to_pylist() for c in ("doc", "place", "t", "ids")), strict=True):
                if not place:
                    words = Words(*utf8(pa.array([t], pa.large_string())))
                elif hits := BenchmarkIndex([""], [t]).hits(words):
                    of.append(key)
                    ranges.append(_merged([h[1:3] for h in hits]))
                    listed.append(names)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(listed, pa.list_(pa.string()))], names=["doc", "spans", "ids"])

    hit = both.mapInArrow(compare, T.StructType([T.StructField("doc", T.LongType()), T.StructField("spans", SPANS), T.StructField("ids", T.ArrayType(T.StringType()))]))
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
    fold = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), grown(a, x)).otherwise(F.concat(a, F.array(x)))
    found = hit.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("l"))
    found = found.select(F.col("doc").alias(doc), F.aggregate("s", F.array().cast(SPANS), fold).alias("s"), "l")
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    out = docs.join(found, doc, "left")
    return out.select(*df.columns, words.alias(n_words), F.coalesce("s", F.array().cast(SPANS)).alias(spans), F.coalesce("l", F.array().cast("array<string>")).alias(ids))


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """find_contamination with n_hit (words inside a span) and contaminated: some word hit, and 5 % of the words or more."""
    out = find_contamination(df, benchmark, text, **options)
    out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of df that are not contaminated, with the columns of df."""
    names = {c: unused(f"_in_{c}", df.columns) for c in df.columns if c.lower() in ("n_words", "hit_spans", "hit_items", "n_hit", "contaminated")}
    back = {v: k for k, v in names.items()}
    judged = contamination(df.withColumnsRenamed(names), benchmark, names.get(text, text), **options)
    return judged.filter(~F.col("contaminated")).select(*[F.col(names.get(c, c)).alias(back.get(c, c)) for c in df.columns])
