"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 2 bits share a value within one bit of both. Every distinct fingerprint therefore emits itself and
its 64 one-bit variants; those that meet on a variant are linked. A variant can be met by at most 65 fingerprints, so no
group is large however often a text is copied. Within a group neighbours in order are linked, which connects the same
fingerprints as all pairs would, since any two that meet on a variant are within the radius.

``keep_first`` takes texts as near-duplicates whose sets of five-word shingles have a Jaccard similarity of LIKE = 0.8 or more, and loses no such pair.

- Fingerprints of 128 bits in four parts, of the sets of words, come first: each part emits its own ball of half of RADIUS. In a group each member is held
  against the first one and the three before it, so that families of any size are linked in linear time; links are verified by the shingles.
- What they leave open is met exactly: the first shingles of texts in different components (prefix filter), then the shingles themselves. Texts of one component make no
  pair. Two large families that share shingles and are not alike do meet in all pairs.

Defined results
- Null and empty texts have fingerprint zero and link like any other. Equal texts have equal fingerprints, so copies
  collapse before any comparison. A null id never names a component unless all its ids are null (then it is null).
- For keep_first, texts of the same words in lower case are equal, those without a word too; a text of fewer than five words has one shingle, the whole.
- Very long texts are read whole. Columns pass through with_fingerprints and keep_first; the former refuses a clash with the one it adds.
- Repeated rows are rows of the same component; the deduplication keeps exactly one row of each component: the least id,
  nulls last, then the row that comes first in the table read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import checkpointed, pieces, refuse, saved, spread_join, unused, utf8

#: Words in a shingle, and the seed of its XXH64.
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ.
RADIUS = 2
#: Near-duplicates for keep_first: words in a shingle, and the least similarity as a fraction.
LIKE_SHINGLE, LIKE = 5, (4, 5)
#: What the fingerprints try first: bits of all parts in which a pair may differ, members of a group before each one that it is held against.
LIKE_BITS, LIKE_BEFORE = 26, 3
PARTS, PART_BITS = 4, 32
#: Which of so many texts are counted for the order of shingles; one in more of them than FREQUENT comes last; those that do, at most (8 bytes each are broadcast).
COUNTED, FREQUENT, FREQUENT_KEYS = 16, 50, 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is in over half of the hashes of text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    n = max(1, len(words) - shingle + 1)
    begin, end = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begin, end, strict=True)), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """df with the fingerprint as a signed 64-bit number."""
    refuse(df, name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, bounds = utf8(batch.column(text))
            raw = data.tobytes()
            prints = [fingerprint(raw[a:b], shingle) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            column = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def hex_of(fingerprint_: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint_)), 16, "0")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, for distinct fingerprints (column f): enough links to connect all that a chain of links connects."""
    flips = F.array(F.col("f"), *[F.col("f").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(64)])
    balls = prints.select("f", F.explode(flips).alias("v"))
    before = F.lag("f").over(Window.partitionBy("v").orderBy("f"))
    met = balls.select(before.alias("a"), F.col("f").alias("b")).filter(F.col("a").isNotNull())
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): the least node of its component.

    Alternates large-star and small-star steps, which halve distances however long a chain is; each round is checkpointed.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        before = mark
        edges = checkpointed(_star(_star(edges, mark[0], large=True), mark[0], large=False))
        mark = _mark(edges)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Links each node's neighbours to the least of them: those greater than the node (large), or those not greater (small). n: edges, about."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    met = spread_join(both, 2 * n, least, "u", "n")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each of df: id, fingerprint (number) and component, the least id that a chain of links reaches."""
    rows = checkpointed(with_fingerprints(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")), "_t", "f").select("_id", "f"))
    prints = checkpointed(rows.groupBy("f").agg(F.min("_id").alias("first"), F.count("*").alias("n")))
    size = prints.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    roots = components(links(prints.select("f")))
    rooted = prints.join(roots, prints["f"] == roots["node"], "left").select("f", "first", "n", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    named = checkpointed(spread_join(rooted, size["prints"], least, "root", "m").select("f", "n", "component"))
    return spread_join(rows, size["rows"], named, "f", "n").select(F.col("_id").alias(doc_id), F.col("f").alias("fingerprint"), "component")


def word_print(words: list[bytes]) -> tuple[bytes, list[int]]:
    """(name, parts): a 128-bit name of the words in order, and the fingerprint of their set in PARTS signed numbers of PART_BITS bits."""
    name = xxhash.xxh128_digest(b" ".join(words), SEED)
    if not words:
        return name, [0] * PARTS
    distinct = set(words)
    digest = xxhash.xxh128_digest
    hashes = np.frombuffer(b"".join([digest(w, SEED) for w in distinct]), np.uint8).reshape(len(distinct), PARTS * PART_BITS // 8)
    counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return name, np.packbits(2 * counts > len(distinct)).view(np.int32).tolist()


def shingles(words: list[bytes], size: int = LIKE_SHINGLE) -> np.ndarray:
    """The hashes of the set of shingles, in order."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    begin, end = [0, *(ends[: n - 1] + 1).tolist()], ends[len(words) - n :].tolist() or [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begin, end, strict=True)), np.uint64, n)).view(np.int64)


def _each(df: DataFrame, text: str, kinds: list[tuple[str, T.DataType]], value: Callable[[list[bytes]], tuple]) -> DataFrame:
    """df without text and with columns that value(words of the text in lower case) gives."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [f for f in df.schema.fields if f.name != text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, bounds = utf8(batch.column(text))
            raw = data.tobytes()
            found = [value(raw[a:b].lower().split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            new = [pa.array([x[k] for x in found], to_arrow_type(kind)) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *new], names=[*(f.name for f in fields), *(name for name, _ in kinds)])

    return df.mapInArrow(scan, T.StructType([*fields, *(T.StructField(*x) for x in kinds)]))


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, of prints (k, parts): pairs that meet in the ball of a part and differ in LIKE_BITS at most."""
    own = lambda p: F.col("parts")[p].cast("long").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    flips = [own(p).bitwiseXOR(F.lit(flip)) + F.lit(p << PART_BITS) for p in range(PARTS) for flip in (0, *(1 << b for b in range(PART_BITS)))]
    balls = prints.select("k", F.explode(F.array(*flips)).alias("v"))
    group = Window.partitionBy("v").orderBy("k")
    others = [F.first("k").over(group.rowsBetween(Window.unboundedPreceding, 0)), *(F.lag("k", n).over(group) for n in range(1, LIKE_BEFORE + 1))]
    met = balls.withColumn("others", F.array(*others)).filter(F.col("others")[0] < F.col("k"))
    met = met.select(F.explode(F.array_distinct(F.array_compact("others"))).alias("a"), F.col("k").alias("b")).distinct()
    sides = met.join(prints.select(F.col("k").alias("a"), F.col("parts").alias("x")), "a").join(prints.select(F.col("k").alias("b"), F.col("parts").alias("y")), "b")
    # The bits of a negative number are counted as those of a long one.
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit((1 << PART_BITS) - 1)))), F.lit(0), lambda s, n: s + n)
    return sides.filter(bits <= LIKE_BITS).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (k, text) are alike by their shingles. Only texts of pairs are read into shingles."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    sets = saved(_each(texts.join(wanted, "k", "left_semi").select("k", "text"), "text", [("s", T.ArrayType(T.LongType()))], lambda words: (shingles(words),)), "simhash-shingles")
    met = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    p, q = LIKE
    return met.filter((p + q) * F.size(F.array_intersect("x", "y")) >= p * (F.size("x") + F.size("y"))).select("a", "b")


def first_shingles(texts: DataFrame, last: np.ndarray | None = None) -> DataFrame:
    """(s, k, root, n) of texts (k, root, text): of its n shingles those of which a text that is alike must have one (all but LIKE of them, and one more), in
    the order of their hashes, but those of last at the end; without last every one."""
    p, q = LIKE
    late = None if last is None else texts.sparkSession.sparkContext.broadcast(last)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            raw, found, sizes = data.tobytes(), [np.zeros(0, np.int64)], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                s = shingles(raw[a:b].lower().split())
                sizes.append(len(s))
                if late is not None:
                    moved = np.isin(s, late.value)
                    s = np.concatenate([s[~moved], s[moved]])[: len(s) + p * len(s) // -q + 1]
                found.append(s)
            lengths = [len(s) for s in found[1:]]
            of = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("k").take(of), batch.column("root").take(of), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], names=["s", "k", "root", "n"])

    return texts.select("k", "root", "text").mapInArrow(scan, "s long, k long, root long, n int")


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that come last in the order, so that a passage of very many texts makes no groups of them. No result depends on the order: some texts are counted alone."""
    counted = first_shingles(texts.filter(F.pmod(F.xxhash64("k"), F.lit(COUNTED)) == 0)).groupBy("s").agg(F.count("*").alias("m")).filter(F.col("m") > FREQUENT)
    most = saved(counted, "simhash-frequent").orderBy(F.desc("m"), "s").limit(FREQUENT_KEYS)
    return np.sort(most.toArrow().column("s").to_numpy())


def open_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) of texts (k, root, text): those of different roots that may be alike; no other two of different roots are.

    Two sets that are alike share one of their first shingles (prefix filter), and so many of them that what comes after the first ones of either set can make
    up the rest. A shingle in texts of one root makes no pair; in others the texts of the commonest root are held against the rest alone.
    """
    group = Window.partitionBy("s")
    rows = first_shingles(texts, frequent_shingles(texts)).withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)})
    mixed = saved(rows.filter(F.col("low") < F.col("high")).drop("low", "high"), "simhash-mixed")
    mains = mixed.groupBy("s", "root").agg(F.count("*").alias("m")).groupBy("s").agg(F.max_by("root", "m").alias("main"))
    left, right = (mixed.select("s", *[F.col(c).alias(f"{side}{c}") for c in ("k", "root", "n")]) for side in ("l_", "r_"))
    left = left.join(mains, "s").filter(F.col("l_root") != F.col("main"))
    p, q = LIKE
    once = (F.col("r_root") == F.col("main")) | (F.col("l_k") < F.col("r_k"))
    sizes = q * F.least("l_n", "r_n") >= p * F.greatest("l_n", "r_n")
    met = left.join(right, "s").filter((F.col("l_root") != F.col("r_root")) & once & sizes)
    met = met.groupBy(F.least("l_k", "r_k").alias("a"), F.greatest("l_k", "r_k").alias("b")).agg(F.count("*").alias("both"), F.min(F.least("l_n", "r_n")).alias("n"), F.max(F.greatest("l_n", "r_n")).alias("m"))
    most = F.col("both") + F.ceil(p * F.col("m") / q) - 1
    return saved(met.filter((p + q) * most >= p * (F.col("n") + F.col("m"))).select("a", "b"), "simhash-open")


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without near-duplicates: one row of each component stays."""
    key, held = unused("_key", df.columns), unused("_held", [*df.columns, "_key"])
    table = saved(df.withColumn(key, F.monotonically_increasing_id()), "simhash")
    plain = table.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.col(key).alias("k")).alias("row"))
    rows = _each(plain, "text", [("name", T.BinaryType()), ("parts", T.ArrayType(T.IntegerType()))], word_print)
    # Equal texts collapse; the first row stands for them.
    prints = checkpointed(rows.groupBy("name").agg(F.min("row").alias("first"), F.min("k").alias("k"), F.first("parts").alias("parts")))
    pairs = saved(candidates(prints.select("k", "parts")), "simhash-candidates")
    roots = checkpointed(components(verified(pairs, plain.select("k", "text"))))
    named = prints.join(roots, prints["k"] == roots["node"], "left").select("k", F.coalesce("root", "k").alias("root"))
    rest = saved(verified(open_pairs(plain.select("k", "text").join(named, "k")), plain.select("k", "text")), "simhash-rest")
    if not rest.isEmpty():
        roots = components(roots.filter("node > root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    first = prints.join(roots, prints["k"] == roots["node"], "left").groupBy(F.coalesce("root", "k")).agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.k").alias(held))
    return table.join(kept, table[key] == kept[held], "left_semi").select(*df.columns)
