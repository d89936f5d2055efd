"""Mixture-controlled packing: deficit round-robin over source queues fills windows of a fixed number of tokens.

All tokens of the corpus form one row of windows without padding. Each source is a queue of tokens. The row is cut into lanes, one for a task:
by the targets, a lane has a stretch of every queue, from where the lane before it left off, so that a source is owed at a lane's start what
all lanes before it leave it, and no more. A window may begin in one lane and end in the next. In each window every source earns its share of the
places; a source is served what it is owed, and what it is still owed (or was given too much) is carried to the next window.
What is left at the very end, less than a window, is cut into lengths that are powers of two.

Defined results
- A null text is an empty document: its end token alone. A null source is a source of its own. Repeated rows are packed
  once each. Texts longer than a window are cut. Empty tables give an empty result.
- Very long texts are encoded whole and cut wherever a window ends. The result has columns of its own, so that no name can clash.
- Targets are the sources' shares of the corpus unless given. A given target without tokens, or tokens without a target,
  do not stop the packing: what is there fills the windows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import pieces, saved, utf8

WINDOW = 2048
END = 1
#: Tokens in a lane on average: what one task holds at a time.
LANE_TOKENS = 4_000_000
#: A source that is owed less than this waits for a later window, unless nobody is owed more; never more than a window's share of the
#: smallest source, so that every source is in every window.
LEAST_PIECE = 256
#: Pairs of a source and a partition that are broadcast, at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_OFFSETS = 500_000

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"

class Encoder:
    """Token ids of texts, as the tokenizer of a tokenizers file gives them. Files of plain byte-level pairs go through a faster library
    with the file's own pairs, which gives the same ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.pairs = self._byte_pairs(spec) if plain else None

    def _byte_pairs(self, spec: dict):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letter[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.pairs is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return np.array(self.pairs.encode_ordinary(text), self.kind).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_table(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, n, ids, before): each document's ids and the end token, as little-endian numbers of 2 or 4 bytes, and how many tokens of
    its source come before it in its partition."""
    kind = df.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END], encode.kind).tobytes()
        so_far: Counter = Counter()
        for batch in pieces(batches, "_text"):
            data, bounds = utf8(batch.column("_text"))
            raw = data.tobytes()
            ids = [encode(raw[a:b].decode()) + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes, before = [len(x) // encode.kind.itemsize for x in ids], []
            for of, n in zip(batch.column("source").to_pylist(), sizes, strict=True):
                before.append(so_far[of])
                so_far[of] += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(before, pa.int64())], names=["doc_id", "source", "n", "ids", "before"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"), F.col(text).alias("_text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, source string, n long, ids binary, before long")


class Places:
    """Where the place pos of the row of all tokens lies: windows, then the powers of two that the rest is cut into."""

    def __init__(self, total: int, window: int):
        self.window, self.whole = window, total // window * window
        rest = total - self.whole
        self.tails, at = [], self.whole
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tails.append((at, 1 << bit))
                at += 1 << bit

    def __call__(self, pos: int) -> tuple[int, int, int]:
        """Sequence, offset, and places from there to the sequence's end."""
        if pos < self.whole:
            return pos // self.window, pos % self.window, self.window - pos % self.window
        k, (at, size) = next((k, x) for k, x in enumerate(self.tails) if pos < x[0] + x[1])
        return self.whole // self.window + k, pos - at, at + size - pos


def fill(queues: dict[str, list[tuple[int, int, int]]], share: dict[str, float], pos: int, places: Places, least: int) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin over one lane: (document, start, length, sequence, offset) of each piece.

    queues: (document, first token, end) in order, by source; share: of each source in the lane, which begins at place pos.
    """
    waiting = {s: list(reversed(q)) for s, q in queues.items() if q}
    owed = dict.fromkeys(waiting, 0.0)
    out = []
    while waiting:
        sequence, offset, room = places(pos)
        for s in waiting:
            owed[s] += share[s] * room

        def serve(s: str, n: int) -> None:
            """The next n tokens of s, or as many as it has, to this sequence."""
            nonlocal room, offset, pos
            while n and s in waiting:
                doc, at, end = waiting[s].pop()
                m = min(n, end - at)
                out.append((doc, at, m, sequence, offset))
                owed[s] -= m
                n, room, offset, pos = n - m, room - m, offset + m, pos + m
                if at + m < end:
                    waiting[s].append((doc, at + m, end))
                elif not waiting[s]:
                    del waiting[s]

        by_debt = sorted(waiting, key=lambda s: (-owed[s], s))
        for s in by_debt:
            if owed[s] < least:
                break
            serve(s, min(room, int(owed[s])))
        for s in sorted(by_debt, key=lambda s: (-owed[s], s)):
            if not room:
                break
            serve(s, room)  # what fractions and small debts leave
    return out


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", source: str = "source", targets: dict[str, float] | None = None, window: int = WINDOW, lane_tokens: int = LANE_TOKENS, least_piece: int = LEAST_PIECE) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and source.

    targets: share of the tokens by source; the shares in df if not given.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    # What stands before a document in its queue is counted within the partitions that write them, and then over the partitions.
    tokens = saved(token_table(df, tokenizer, text, doc_id, source).withColumn("part", F.spark_partition_id()), "tokens")
    held = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(held.select("source", "part", F.coalesce(earlier, F.lit(0)).alias("earlier")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    sources, lanes, total, v_at = _schedule(held, targets, lane_tokens)
    least = max(1, min(least_piece, int(sources.agg(F.min(F.when(F.col("rate") > 0, F.col("rate")))).first()[0] * window))) if total else 1
    cut = lambda k: F.when(k >= lanes, F.col("all")).otherwise(F.least(F.col("all"), F.floor(F.greatest(F.lit(0.0), v_at(k) - F.col("begin")) * F.col("rate"))))

    lane_starts = sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("at")).withColumns({"lo": cut(F.col("at")), "hi": cut(F.col("at") + 1)})
    first = F.sum("lo").over(Window.partitionBy("at"))
    plan = lane_starts.select("at", "source", (F.col("hi") - F.col("lo")).alias("held"), first.alias("first")).filter("held > 0").withColumnRenamed("source", "of")

    placed = tokens.join(offsets, ["source", "part"]).join(sources, "source").withColumn("from", F.col("earlier") + F.col("before"))
    # The lanes whose stretches meet the document: its first and last tokens are looked up among the cuts, by halving.
    lane_of = lambda x: _last_cut(x, cut, lanes)
    placed = placed.withColumns({"k0": lane_of(F.col("from")), "k1": lane_of(F.col("from") + F.col("n") - 1)})
    dealt = placed.withColumn("lane", F.explode(F.sequence("k0", "k1"))).withColumns({"lo": F.greatest(F.lit(0), cut(F.col("lane")) - F.col("from")), "hi": F.least(F.col("n"), cut(F.col("lane") + 1) - F.col("from"))})
    # A lane gets the ids of its own stretch alone, however long the document is.
    width = F.octet_length("ids") / F.col("n")
    own = F.substring("ids", (F.col("lo") * width + 1).cast("int"), ((F.col("hi") - F.col("lo")) * width).cast("int"))
    dealt = dealt.filter("lo < hi").select("lane", "doc_id", "source", "n", own.alias("ids"), "from", "lo", "hi")
    places = Places(total, window)

    def one_lane(docs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["source", "from"], kind="stable", ignore_index=True)
        los, his = docs["lo"].tolist(), docs["hi"].tolist()
        queues: dict[str, list] = {}
        for k, (s, lo, hi) in enumerate(zip(docs["source"], los, his, strict=True)):
            queues.setdefault(s, []).append((k, lo, hi))
        found = fill(queues, dict(zip(state["of"], state["held"] / state["held"].sum(), strict=True)), int(state["first"].iloc[0]), places, least)
        wide = [memoryview(np.frombuffer(x, f"<u{len(x) // (hi - lo)}").astype("<u4")) for x, lo, hi in zip(docs["ids"], los, his, strict=True)]
        rows = pd.DataFrame(found, columns=["doc", "start", "length", "sequence_id", "offset"], dtype="int64")
        crcs = [zlib.crc32(wide[doc][a - los[doc] : a - los[doc] + n]) for doc, a, n, _, _ in found]
        of = docs.loc[rows["doc"]].reset_index(drop=True)
        return pd.DataFrame({"doc_id": of["doc_id"], "start": rows["start"], "length": rows["length"], "ids_crc32": crcs, "doc_tokens": of["n"], "sequence_id": rows["sequence_id"], "offset": rows["offset"], "source": of["source"].where(of["source"] != "\0", None)})

    return dealt.groupBy("lane").cogroup(plan.groupBy("at")).applyInPandas(one_lane, PIECES.format(kind))


def _last_cut(x: Column, cut: Callable[[Column], Column], lanes: int) -> Column:
    """The last lane whose cut is not after token x: a search by halving, in as many steps as lanes has bits."""
    step = lambda low, k: F.when((low + k < lanes) & (cut(low + k) <= x), low + k).otherwise(low)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, lanes.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, k: step(low, k))


def _schedule(held: DataFrame, targets: dict[str, float] | None, lane_tokens: int) -> tuple[DataFrame, int, int, Callable[[Column], Column]]:
    """Sources (source, all, rate, begin), lanes, tokens, and the time at which a lane begins.

    Time passes with the tokens that the targets are made of: from begin on, a source gives rate tokens a unit until it has given all. Once some
    have, the rest fills the lanes, and what has no target comes last. The table of sources is one row for each.
    """
    of_source = held.groupBy("source").agg(F.sum("n").alias("all"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    lanes = max(1, -(-total // lane_tokens))
    if targets is None:
        return of_source.select("source", "all", (F.col("all") / F.lit(max(total, 1))).alias("rate"), F.lit(0.0).alias("begin")), lanes, total, lambda k: k * F.lit(total / lanes)
    goal = held.sparkSession.createDataFrame([(s, float(x) / sum(targets.values())) for s, x in targets.items() if x > 0], "source string, goal double")
    known = [(r["all"], r["goal"]) for r in of_source.join(goal, "source").collect()]  # no more rows than targets
    last = max((n / g for n, g in known), default=0.0)
    rest = total - sum(n for n, _ in known)
    met = of_source.join(goal, "source", "left")
    sources = met.select("source", "all", F.coalesce("goal", F.col("all") / F.lit(max(rest, 1))).alias("rate"), F.when(F.col("goal").isNull(), last).otherwise(0.0).alias("begin"))
    times = sorted({0.0, *(n / g for n, g in known), last + rest})
    given = [sum(min(n, g * t) for n, g in known) + max(0.0, t - last) for t in times]
    legs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(t).alias("t"), F.lit((u - t) / (q - p) if q > p else 0.0).alias("slope")) for p, q, t, u in zip(given, [*given[1:], given[-1]], times, [*times[1:], times[-1]], strict=True)])

    def v_at(k: Column) -> Column:
        p = k * F.lit(total / lanes)
        return F.aggregate(legs, F.lit(0.0), lambda v, x: F.when(x["p"] <= p, x["t"] + (p - x["p"]) * x["slope"]).otherwise(v))

    return sources, lanes, total, v_at
