"""Line deduplication by an exact set-similarity join of native expressions.

A line is the set of its words. Two lines match if the Jaccard similarity of their sets is SIMILAR or more. A line is removed
if a line before it, anywhere in the corpus, matches it; before means: the lesser doc_id, then the earlier line.

- Lines with equal sets collapse first; each set stands where it occurs first. Its later occurrences are removed.
- The words of each set are ordered from rare to frequent, by counts over all documents folded into BUCKETS counters. Of matching sets,
  the larger one has among its first words (prefix) one of the fewer first words (short prefix) of the smaller one. Only pairs that can
  still reach the similarity, by their sizes (length filter) and by signatures of 64 bits, or 128 if both are large, are compared, on
  the words themselves.
- First each set of crowded words meets one set alone: of the earliest and the last before it in their groups, the likeliest to match.
  That settles families of many variants of a line in linear time. The sets that this leaves open meet all earlier sets.

Defined results
- Lines without a word are never removed. A null text has one empty line.
- Rows with the same doc_id and the same text are one document: neither loses lines to the other, both keep the same. Rows
  with the same doc_id and other texts are told apart by a hash of the text. A null doc_id comes after all others.
- Very long texts are compared whole. An empty table gives an empty result. Other columns pass through dedup_lines, whatever their names;
  line_report has columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import let, saved, unused, words_of

#: Least Jaccard similarity of matching lines, as a fraction.
SIMILAR = (4, 5)
BUCKETS = 1 << 18
#: Rarity of words whose groups are crowded (the count of their counter is 255 or more).
CROWDED = 32
#: Sets of more words have signatures of 128 bits, which too few differences of 64 bits would not tell apart.
LARGE = 96
#: Candidate lines whose places are broadcast, at most (about 60 bytes each); beyond that their texts are joined by a shuffle.
BROADCAST_LINES = 500_000


def line_words(line: Column) -> Column:
    return F.array_distinct(_words(line))


def _words(line: Column) -> Column:
    """Lines whose words are parted by single spaces, as most are, take the faster way."""
    odd = line.startswith(" ") | line.endswith(" ") | (line == "") | F.contains(line, F.lit("  ")) | line.rlike(r"[\x09-\x0D]")
    return F.when(odd, words_of(line)).otherwise(F.split(line, " "))


def eligible(line: Column) -> Column:
    """One word at least; most lines begin with one."""
    return (line >= "!") | line.rlike(r"[^\x20\x09-\x0D]")


def _documents(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, h (of the text) and t of each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def _rarity(documents: DataFrame) -> Column:
    """Counts of all words, folded into BUCKETS counters: a byte for each, rising with the logarithm. Its size is fixed.

    The array is a scalar subquery, so that no plan spells it out."""
    words = documents.select(F.explode(F.split(F.replace("t", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    buckets = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    every = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    step = F.least(F.floor(4 * F.log2(1 + F.coalesce("n", F.lit(0)))), F.lit(126)).cast("byte")
    counts = every.join(buckets, "b", "left").select(F.struct("b", step.alias("c")).alias("x"))
    return counts.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]).alias("c")).scalar()


def _bucket(hashed: Column) -> Column:
    """The counter of a word, by its hash."""
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ordered(words: Column, counts: Column) -> Column:
    """The set of the words, from rare to frequent: for each its rarity in the upper byte, and 56 bits of its hash."""
    rarity = lambda x: F.coalesce(F.get(counts, _bucket(x)), F.lit(0).cast("byte")).cast("long")
    key = lambda x: F.shiftleft(rarity(x), 56).bitwiseOR(F.shiftrightunsigned(x, 8))
    return F.array_distinct(F.sort_array(F.transform(F.transform(words, lambda w: F.xxhash64(w)), key)))


def _prefix(ordered: Column) -> Column:
    """The rarest words of a set, by 31 bits and a sign (negative: crowded), of which a matching set must have one: all but SIMILAR of them, and one more."""
    p, q = SIMILAR
    size = F.size(ordered)
    sign = lambda x: F.when(x >= F.lit(CROWDED << 56), F.lit(1 << 31)).otherwise(F.lit(0).cast("long"))
    return F.transform(F.slice(ordered, F.lit(1), size - F.ceil(size * p / q).cast("int") + 1), lambda x: (x.bitwiseAND(F.lit((1 << 31) - 1)) - sign(x)).cast("int"))


def _signature(ordered: Column) -> tuple[Column, Column]:
    """64 bits, each flipped by the words that fall on it: two sets differ in as many words at least as their signatures in bits. For a LARGE set,
    also those bits as half of the words flip them, which with the other half make 128 bits."""
    # A shift takes the last six bits of its distance alone.
    flip = lambda one, x: F.call_function("shiftleft", one, F.shiftrightunsigned(x, 40).cast("int"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bits = F.aggregate(ordered, none, lambda s, x: s.bitwiseXOR(flip(one, x)))
    half = F.aggregate(ordered, none, lambda s, x: s.bitwiseXOR(flip(F.shiftrightunsigned(x, 46).bitwiseAND(one), x)))
    return bits, F.when(F.size(ordered) > LARGE, half).otherwise(none)


def line_sets(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The distinct sets of the eligible lines, where each occurs first: s (rising from first to last), id, h, line, n, bits and half (the signature), prefix.

    Hashes stand for the words; two 64-bit hashes of all its words in order name a set.
    """
    documents = _documents(df, text, doc_id)
    # Lines become rows before their words are looked at, so that sorting and hashing sets is compiled code.
    lines = documents.select("id", "h", F.posexplode(F.split("t", "\n", -1)).alias("line", "l")).filter(eligible(F.col("l")))
    lines = lines.withColumn("counts", _rarity(documents)).select("id", "h", "line", _ordered(_words(F.col("l")), F.col("counts")).alias("w"))
    bits, half = _signature(F.col("w"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h", "line", F.size("w").alias("n"), bits.alias("bits"), half.alias("half"), _prefix(F.col("w")).alias("prefix"))
    sets = lines.select(F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b"), first.alias("first")).groupBy("a", "b").agg(F.min("first").alias("first")).select("first.*")
    sets = sets.orderBy("none", "id", "h", "line").select(F.monotonically_increasing_id().alias("s"), "id", "h", "line", "n", "bits", "half", "prefix")
    return saved(sets, "lines")


def _may_match(a: str, b: str) -> Column:
    """Of two sets (what stands before the names n, bits and half of their columns): no more differences in the signatures than they may have, and length filter."""
    p, q = SIMILAR
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    few = lambda bits: (p + q) * bits <= (q - p) * (n + m)
    differ, half = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in ("bits", "half"))
    both = few(F.bit_count(half) + F.bit_count(half.bitwiseXOR(differ)))
    # What rejects most comes first.
    return few(F.bit_count(differ)) & (q * F.least(n, m) >= p * F.greatest(n, m)) & ((F.least(n, m) <= LARGE) | both)


def _verified(pairs: DataFrame, sets: DataFrame, df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The distinct a of the pairs (a, b) whose lines match."""
    pairs = saved(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    places = saved(sets.join(wanted, "s", "left_semi").select("s", "id", "h", "line"), "places")
    by_document = places.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_list(F.struct("line", "s")).alias("at"))
    near = F.broadcast(by_document) if places.count() <= BROADCAST_LINES else by_document
    met = _documents(df, text, doc_id).join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    lines = F.split("t", "\n", -1)
    found = saved(met.select(F.inline(let(lines, lambda all_: F.transform("at", lambda x: F.struct(x["s"].alias("s"), all_[x["line"]].alias("l")))))), "found")
    both = pairs.join(found.select(F.col("s").alias("a"), F.col("l").alias("la")), "a").join(found.select(F.col("s").alias("b"), F.col("l").alias("lb")), "b")
    p, q = SIMILAR
    alike = lambda x, y: (p + q) * F.size(F.array_intersect(x, y)) >= p * (F.size(x) + F.size(y))
    match = let(line_words(F.col("la")), lambda x: let(line_words(F.col("lb")), lambda y: alike(x, y)))
    return both.filter(match).select(F.col("a").alias("s")).distinct()


def matched_sets(df: DataFrame, sets: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """s of each set that an earlier set matches."""

    fields = ("s", "n", "bits", "half")
    p, q = SIMILAR
    # A smaller set matches its equals alone, which have collapsed: one word more is too much for it.
    sets = sets.filter((q - p) * F.col("n") >= p)
    # The short prefix: before its first word in common with a set that is not smaller, a set may miss no more words than these.
    short = F.slice("prefix", F.lit(1), F.floor((q - p) * F.col("n") / (p + q)).cast("int") + 1)
    # By its crowded words, each set first meets one other: of the earliest and the last before it in their groups, the one whose signature is nearest.
    # The groups of other words are small, so that all their pairs are few for each row.
    group = Window.partitionBy("word").orderBy("s")
    earliest = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sets.select(*fields, F.explode(short).alias("word")).filter(F.col("word") < 0).select(*fields, *[F.first(c).over(earliest).alias(f"first_{c}") for c in fields], *[F.lag(c).over(group).alias(f"last_{c}") for c in fields])
    differ = lambda e: F.bit_count(F.col("bits").bitwiseXOR(F.col(f"{e}bits")))
    near = [F.when((F.col("s") > F.col(f"{e}s")) & _may_match("", e), F.struct(differ(e).alias("d"), F.col(f"{e}s").alias("b"))) for e in ("last_", "first_")]
    met = met.select(F.col("s").alias("a"), F.least(*near).alias("near")).filter(F.col("near").isNotNull())
    nearest = met.groupBy("a").agg(F.min("near").alias("near")).select("a", "near.b")
    settled = saved(_verified(nearest, sets, df, text, doc_id), "settled")
    flagged = sets.join(settled.withColumn("open", F.lit(0)), "s", "left").withColumn("open", F.coalesce("open", F.lit(1)))
    large, small = (flagged.select(F.explode(words).alias("word"), *[F.col(c).alias(f"{side}{c}") for c in (*fields, "open")]) for side, words in (("l_", F.col("prefix")), ("r_", short)))
    # Of equal sizes, the earlier one counts as the smaller. The later one of a pair looks for a match, if it is open.
    smaller = (F.col("r_n") < F.col("l_n")) | ((F.col("r_n") == F.col("l_n")) & (F.col("r_s") < F.col("l_s")))
    open_ = F.when(F.col("l_s") > F.col("r_s"), F.col("l_open")).otherwise(F.col("r_open")) == 1
    pairs = large.join(small, "word").filter(_may_match("l_", "r_") & smaller & open_)
    return settled.union(_verified(pairs.select(F.greatest("l_s", "r_s").alias("a"), F.least("l_s", "r_s").alias("b")), sets, df, text, doc_id))


def kept_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, h, kept): the places of the eligible lines that stay, by document."""
    sets = line_sets(df, text, doc_id)
    stay = sets.join(matched_sets(df, sets, text, doc_id), "s", "left_anti")
    return stay.groupBy("id", "h").agg(F.sort_array(F.collect_list("line")).alias("kept"))


def line_report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row of df: its id, n_lines, and removed, the places of the lines that the deduplication removes."""
    lines = F.split("t", "\n", -1)
    places = F.transform(lines, lambda x, i: F.when(eligible(x), i))
    rows = _documents(df, text, doc_id).select("id", "h", places.alias("places"))
    kept = kept_lines(df, text, doc_id).select(F.col("id").alias("i"), F.col("h").alias("g"), "kept")
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    removed = F.array_except(F.array_compact("places"), F.coalesce("kept", F.array().cast("array<int>")))
    return out.select(F.col("id").alias(doc_id), F.size("places").alias("n_lines"), removed.alias("removed"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with its texts less the lines that an earlier line matches."""
    h, i, g, kept = (unused(x, df.columns) for x in ("_h", "_i", "_g", "_kept"))
    rows = df.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    stay = kept_lines(df, text, doc_id).select(F.col("id").alias(i), F.col("h").alias(g), F.col("kept").alias(kept))
    out = rows.join(stay, F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(h) == F.col(g)), "left")
    # Marks of kept places and the lines, sorted together: a kept line comes right after its mark.
    marks = F.transform(F.coalesce(F.col(kept), F.array().cast("array<int>")), lambda k: F.struct(k.alias("k"), F.lit(0).alias("line"), F.lit("").alias("l")))
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, k: F.struct(k.alias("k"), F.lit(1).alias("line"), x.alias("l")))

    def stays(all_: Column) -> Column:
        marked = lambda j: F.coalesce(F.get(all_, j - 1)["line"] == 0, F.lit(False))
        return F.filter(all_, lambda x, j: (x["line"] == 1) & (marked(j) | ~eligible(x["l"])))

    kept_text = F.array_join(F.transform(let(F.sort_array(F.concat(marks, lines)), stays), lambda x: x["l"]), "\n")
    return out.withColumn(text, kept_text).select(*df.columns)
