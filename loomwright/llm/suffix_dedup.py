"""Removal of repeated byte strings by suffix sorting of shards.

A byte goes if a string of SPAN bytes that covers it starts anywhere else too, in the same document or in another.

- The least hash of the GRAM-byte strings inside each SPAN-byte string is its anchor, the same wherever the string occurs.
  Strings whose anchor occurs once occur once; they need no sorting.
- Around each anchor that repeats, the neighbouring strings with that anchor are cut out as one context, so that equal strings
  are in contexts of equal anchors. Contexts that are equal as a whole are repeated as a whole and collapse.
- The different contexts are dealt to shards by their anchors. A shard sorts all its suffixes by induction and compares neighbours
  in that order over SPAN bytes. Shards are kept small, so that they are sorted in memory.
- An anchor with very many different contexts would fill a shard by itself. Their strings are named by 128-bit hashes and counted instead.

Defined results
- A null or empty text has no bytes. Repeated rows are documents of their own, and remove each other's long strings. Matches never
  cross documents. An empty table gives an empty result. Very long texts are read whole. Other columns pass through; one with the name of
  an output column (whatever the case) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import pieces, refuse, saved, spread_join, unused, utf8
from loomwright.llm.suffix_order import suffix_order

SPAN, GRAM = 400, 64
#: Anchors that are broadcast, at most (8 bytes each); beyond that they reach their documents by a join.
BROADCAST_ANCHORS = 2_000_000
#: Different contexts beyond which an anchor is hot; bytes of contexts that a shard sorts at a time, about.
HOT_CONTEXTS, SHARD_BYTES = 2_000, 8 << 20
#: Windows compared at a time.
BLOCK = 1 << 14

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER, _OTHER_INVERSE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
RANGES = "array<struct<start:long,end:long>>"


def _sliding(x: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over each width neighbours."""
    out, have = x, 1
    while 2 * have <= width:
        out = ufunc(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return ufunc(out[: len(out) - rest], out[rest:]) if rest else out


def gram_hashes(data: np.ndarray, gram: int, base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE) -> np.ndarray:
    with np.errstate(over="ignore"):
        n = len(data)
        powers = np.cumprod(np.full(n, base, np.uint64))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)
        part = sums[gram - 1 :].copy()
        part[1:] -= sums[: n - gram]
        x = part * np.cumprod(np.full(n - gram + 1, inverse, np.uint64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) | np.uint64(1)


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): of each anchor, in order, the first and last start of the neighbouring strings whose anchor it is.

    The anchor of a string is its last gram of the least hash.
    """
    if len(data) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(data, gram)
    wide = span - gram + 1
    least = _sliding(grams, wide, np.minimum)
    padded = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, wide, np.maximum) == grams)
    at = np.searchsorted(chosen, np.arange(wide - 1, len(grams)), "right") - 1
    open_ = np.arange(len(at))
    while len(open_):
        open_ = open_[grams[chosen[at[open_]]] != least[open_]]
        at[open_] -= 1
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return grams[chosen[at[first]]], first, np.append(first[1:], len(at)) - 1


def _documents(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, g, h (two hashes of the text) and t: rows of equal id and text have equal results."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("g"), F.xxhash64(F.lit(1), t).alias("h"), t.alias("t"))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    data, bounds = utf8(batch.column(column))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield data[a:b]


def repeated_anchors(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor): those that occur twice or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            found = [anchors(x, span, gram)[0] for x in _texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["anchor"])

    return documents.select("t").mapInArrow(scan, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("anchor")


def contexts(documents: DataFrame, repeated: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, g, h, anchor, a, b, starts, bytes): the different contexts of repeated anchors in each document, by two hashes of their bytes, and where they start."""
    n = repeated.count()
    if n <= BROADCAST_ANCHORS:
        live = documents.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column("anchor").to_numpy()))
        rows = documents.withColumn("live", F.lit(None).cast("array<long>"))
    else:
        live = None
        every = documents.mapInArrow(lambda batches: _anchor_rows(batches, span, gram), T.StructType([*documents.drop("t").schema.fields, T.StructField("anchor", T.LongType())]))
        listed = every.distinct().join(repeated, "anchor").groupBy("id", "g", "h").agg(F.collect_list("anchor").alias("live"))
        listed = listed.select(F.col("id").alias("i"), F.col("g").alias("k"), F.col("h").alias("l"), "live")
        rows = documents.join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("g") == F.col("k")) & (F.col("h") == F.col("l"))).select("id", "g", "h", "t", "live")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            out: list[tuple] = []
            lives = batch.column("live").to_pylist()
            for row, data in enumerate(_texts(batch, "t")):
                hashes, first, last = anchors(data, span, gram)
                signed = hashes.view(np.int64)
                known = live.value if live is not None else np.sort(np.array(lives[row] or [], np.int64))
                if not len(known) or not len(signed):
                    continue
                held = known[np.minimum(np.searchsorted(known, signed), len(known) - 1)] == signed
                raw, met = data.tobytes(), {}
                for k in np.flatnonzero(held).tolist():
                    part = raw[first[k] : last[k] + span]
                    met.setdefault((int(signed[k]), part), []).append(int(first[k]))
                for (anchor, part), starts in met.items():
                    digest = np.frombuffer(hashlib.blake2b(part, digest_size=16).digest(), np.int64)
                    out.append((row, anchor, int(digest[0]), int(digest[1]), starts, part))
            of, *rest = zip(*out, strict=True) if out else ([],) * 6
            chosen = pa.array(of, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(chosen) for c in ("id", "g", "h")), *(pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True))], names=["id", "g", "h", "anchor", "a", "b", "starts", "bytes"])

    kind = documents.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, g long, h long, anchor long, a long, b long, starts array<long>, bytes binary")


def _anchor_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "t"):
        found = [anchors(x, span, gram)[0] for x in _texts(batch, "t")]
        of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("id", "g", "h")), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["id", "g", "h", "anchor"])


def repeated_windows(text: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """For each position of text, the contexts one after another up to ends, whether the span bytes from there lie in one context and occur again."""
    room = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(text))
    order = suffix_order(text)
    order = order[room[order] >= span]
    again = np.zeros(len(text), bool)
    if len(order) < 2:
        return again
    windows = np.lib.stride_tricks.sliding_window_view(text, span)
    for at in range(0, len(order) - 1, BLOCK):
        part = order[at : at + BLOCK + 1]
        rows = windows[part]
        equal = (rows[1:] == rows[:-1]).all(axis=1)
        again[part[1:][equal]] = again[part[:-1][equal]] = True
    return again


def _runs(covered: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def sort_shards(found: DataFrame, span: int) -> DataFrame:
    """(anchor, a, b, ranges): what is repeated of each different context, as ranges of its bytes.

    A task takes its anchors in order, as many whole ones to a shard as SHARD_BYTES hold, or one alone: one with more than HOT_CONTEXTS different
    contexts goes to hot_ranges.
    """
    distinct = found.groupBy("anchor", "a", "b").agg(F.sum(F.size("starts")).alias("n"), F.first("bytes").alias("bytes"))
    crowded = found.select("anchor", "a", "b").distinct().groupBy("anchor").agg(F.count("*").alias("different")).filter(F.col("different") > HOT_CONTEXTS)
    hot = saved(crowded.select("anchor"), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        named = F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot
        return _sorted_shards(distinct.join(named, "anchor", "left_anti"), span).unionByName(hot_ranges(distinct.join(named, "anchor", "left_semi"), span))
    return _sorted_shards(distinct, span)


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in order of their anchors as tables of whole anchors, of about limit bytes each."""
    kept, held = [], 0
    for batch in pieces(batches, "bytes", max(1, limit // 4)):
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        if kept and held > limit:
            # The shard ends where the anchor changes.
            open_ = kept[-1].column("anchor")[-1].as_py()
            k = int(np.searchsorted(anchor != open_, True)) if anchor[0] == open_ else 0
            if k < len(anchor):
                yield pa.Table.from_batches([*kept, batch.slice(0, k)])
                kept, held, batch = [], 0, batch.slice(k)
        kept.append(batch)
        held += int(utf8(batch.column("bytes"))[1][-1])
    if kept:
        yield pa.Table.from_batches(kept)


def _sorted_shards(distinct: DataFrame, span: int) -> DataFrame:
    kind, limit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), SHARD_BYTES

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, limit):
            yield from _sorted_shard(table, span, kind)

    dealt = distinct.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(sort, f"anchor long, a long, b long, ranges {RANGES}")


def _sorted_shard(table: pa.Table, span: int, kind: pa.DataType) -> list[pa.RecordBatch]:
    whole = table.column("n").to_numpy() > 1
    anchor = table.column("anchor").to_numpy()
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero((size[group] > 1))  # others have no context to be compared with
    ranges: list = [None] * table.num_rows
    if len(chosen) and not whole[chosen].all():
        data, bounds = utf8(table.column("bytes").take(pa.array(chosen)))
        again = repeated_windows(data, bounds[1:], span)
        for k, a, b in zip(chosen.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            starts = np.flatnonzero(again[a:b])
            if len(starts) and not whole[k]:
                covered = np.zeros(b - a + 1, np.int64)
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + span, -1)
                ranges[k] = _runs(np.cumsum(covered)[:-1] > 0)
    for k in np.flatnonzero(whole).tolist():
        ranges[k] = [{"start": 0, "end": len(table.column("bytes")[k].as_py())}]
    kept = pa.array([k for k, r in enumerate(ranges) if r], pa.int64())
    out = pa.table({c: table.column(c).take(kept) for c in ("anchor", "a", "b")} | {"ranges": pa.array([r for r in ranges if r], kind)})
    return out.combine_chunks().to_batches()


def hot_ranges(distinct: DataFrame, span: int) -> DataFrame:
    """(anchor, a, b, ranges) for contexts of hot anchors: the windows whose 128-bit hashes occur twice or more; equal ones are counted before they
    are shuffled."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes"):
            found = [(gram_hashes(x, span), gram_hashes(x, span, _OTHER, _OTHER_INVERSE)) for x in _texts(batch, "bytes")]
            of, at = np.repeat(np.arange(len(found)), [len(x) for x, _ in found]), np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x, _ in found]])
            wa, wb = (np.concatenate([np.zeros(0, np.uint64), *[x[k] for x in found]]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in ("anchor", "a", "b", "n")), pa.array(wa), pa.array(wb), pa.array(at)], names=["anchor", "a", "b", "n", "wa", "wb", "at"])

    windows = distinct.mapInArrow(name, "anchor long, a long, b long, n long, wa long, wb long, at long").withColumn("w", F.struct("wa", "wb"))
    counted = windows.groupBy("w").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).filter(F.col("times") > 1)
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    again = spread_join(windows.select("anchor", "a", "b", "w", "at"), total, counted.select("w", "rows"), "w", "rows")
    return again.groupBy("anchor", "a", "b").agg(F.transform(F.collect_list("at"), lambda k: F.struct(k.alias("start"), (k + span).alias("end"))).alias("ranges"))


def find_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, g, h, ranges): byte ranges to remove, by document; ranges may overlap."""
    documents = _documents(df, text, doc_id)
    repeated = saved(repeated_anchors(documents, span, gram), "anchors")
    found = saved(contexts(documents, repeated, span, gram), "contexts")
    ranges = sort_shards(found.select("anchor", "a", "b", "starts", "bytes"), span)
    placed = found.select("id", "g", "h", "anchor", "a", "b", "starts").join(ranges, ["anchor", "a", "b"]).select("id", "g", "h", "ranges", F.explode("starts").alias("at"))
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("at")).alias("start"), (r["end"] + F.col("at")).alias("end")))
    return placed.select("id", "g", "h", moved.alias("ranges")).groupBy("id", "g", "h").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """df with spans (removed byte ranges, merged), kept (binary: the bytes that stay) and n_bytes."""
    refuse(df, "spans", "kept", "n_bytes")
    g, h, i, k, l, ranges = (unused(x, df.columns) for x in ("_g", "_h", "_i", "_k", "_l", "_ranges"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({g: F.xxhash64(t), h: F.xxhash64(F.lit(1), t)})
    found = find_repeats(df, text, doc_id, span, gram).select(F.col("id").alias(i), F.col("g").alias(k), F.col("h").alias(l), F.col("ranges").alias(ranges))
    joined = rows.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(g) == F.col(k)) & (F.col(h) == F.col(l)), "left").select(*df.columns, ranges)

    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            lists = batch.column(ranges).to_pylist()
            spans, kept, sizes = [], [], []
            for data, removed in zip(_texts(batch, text), lists, strict=True):
                sizes.append(len(data))
                if not removed:
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                for r in removed:
                    edge[r["start"]] += 1
                    edge[r["end"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans.append(_runs(gone))
                kept.append(data[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], names=[*names, "spans", "kept", "n_bytes"])

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return joined.mapInArrow(cut, T.StructType([*df.schema.fields, T.StructField("spans", spans_type), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
