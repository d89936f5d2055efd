"""Personal data: patterns find the protected entities; corpus co-occurrence finds the terms that give them away.

Entities are addresses, numbers of cards and telephones, and secrets: values set to a name whose own characters hold much information.

A term is a word without the punctuation around it. For each term of a document with an entity, however far from it, whole documents
are counted: those with the term, with the entity, with both. The term discloses the entity if its pointwise mutual information with
it exceeds the information of the entity's generalisation (its kind), and the entity is likelier than not where the term is.
One text alone shows nothing, however often it was copied: LEAST_TEXTS different texts must have both. Such terms are marked in
every document that holds the entity, and ``sanitise`` replaces entities and terms by their generalisation.

Defined results
- A null or empty text has no spans. Repeated rows are judged one by one and count as documents. Equal texts are one text.
- Spans count code points, ends exclusive. Spans of one kind never overlap; those of different kinds may. A term inside an
  entity's span is not marked. An empty table gives an empty result. Very long texts are read whole. Other columns pass through; one
  with the name of an output column (whatever the case) is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import SPACE, pieces, refuse, saved, unused, utf8

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What is set to a name, such as token = "...": letters and digits mixed, of SECRET_BITS of information at least.
SETTING = re.compile(r"""[:=][\x20\t]{0,3}["']?(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])([A-Za-z0-9][A-Za-z0-9+/_-]{15,})""")
NAMED = re.compile(r"""[A-Za-z0-9_]["']?[\x20\t]{0,3}\Z""")
SECRET_BITS = 48
WORDS = re.compile(rf"[^{SPACE}]+")
#: Stripped from both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}|#*$%&<>"
#: Terms that are broadcast, at most (8 bytes each), so that the others are not counted at all; beyond that they meet in a join.
BROADCAST_TERMS = 2_000_000
#: Texts in which a term needs to be with an entity; least share of its documents.
LEAST_TEXTS, LEAST_SHARE = 2, 0.5

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octets(address: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in address.split("."))


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind as in KINDS, secrets last, then by start."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    if "=" in text or ":" in text:
        found += [(SECRET, *m.span(1)) for m in SETTING.finditer(text) if NAMED.search(text[max(0, m.start() - 5) : m.start()]) and information(m[1]) >= SECRET_BITS]
    return found


def information(text: str) -> float:
    """Bits in text, by the frequencies of its own characters."""
    n = len(text)
    return sum(-c * math.log2(c / n) for c in Counter(text).values())


def _hash(x: str) -> int:
    """As Spark's xxhash64 of the string."""
    n = xxhash.xxh64_intdigest(x.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def _terms(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in WORDS.finditer(text):
        word = m[0].lstrip(PUNCTUATION)
        start = m.end() - len(word)
        word = word.rstrip(PUNCTUATION)
        if len(word) > 1:
            out.append((word, start, start + len(word)))
    return out


def _scan(batches: Iterator[pa.RecordBatch], text: str, spans: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text):
        data, bounds = utf8(batch.column(text))
        raw = data.tobytes()
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in entities(raw[a:b].decode())] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans])


def find_entities(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with the array of the patterns' spans."""
    return df.mapInArrow(lambda batches: _scan(batches, text, spans), T.StructType([*df.schema.fields, T.StructField(spans, SPAN)]))


def term_hashes(text: Column) -> Column:
    """The hashes of the text's distinct terms, as _hash(word) of _terms."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.char_length(w) > 1), lambda w: F.xxhash64(w)))


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def term_documents(df: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term): over all documents, how many hold each wanted term (by its hash)."""
    return df.select(F.explode(term_hashes(F.col(text))).alias("term")).join(_small(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing_terms(found: DataFrame, corpus: DataFrame, text: str, spans: str, key: str) -> DataFrame:
    """(key, terms): hashes of the terms that disclose an entity of the row. found: the rows with entities, by a unique key.

    Counts over the rows with entities bound those over all documents from below. Pairs that fail by them already are left out early.
    """
    value = F.substring(F.col(text), (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    value = F.when(F.col("s.kind").isin("email", "ip"), F.lower(value)).when(F.col("s.kind") == SECRET, value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    spelt = found.select(F.explode(spans).alias("s"), F.col(key).alias("k"), text)
    per_entity = saved(spelt.select("k", F.col("s.kind").alias("kind"), F.xxhash64(F.concat_ws(":", F.col("s.kind"), value)).alias("entity"), F.xxhash64(text).alias("whole")).distinct(), "pii-entities")
    with_kind = per_entity.select("k", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n_kind"))
    several = F.col("one") != F.col("other")  # two different texts at least
    with_entity = per_entity.groupBy("entity", "kind").agg(F.count("*").alias("n_entity"), F.min("whole").alias("one"), F.max("whole").alias("other"))
    with_entity = saved(with_entity.filter(several).join(with_kind, "kind").select("entity", "n_entity", "n_kind"), "pii-shared")
    held = per_entity.join(with_entity, "entity").select("k", "entity", "n_entity", "whole")
    words = saved(found.select(F.col(key).alias("k"), term_hashes(F.col(text)).alias("terms")), "pii-words")
    low = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_low")).filter(F.col("n_low") >= LEAST_TEXTS)
    low = saved(low, "pii-low")
    met = words.join(held, "k").select("k", "entity", "n_entity", "whole", F.explode("terms").alias("term"))
    pairs = met.join(_small(low), "term").filter(F.col("n_entity") >= LEAST_SHARE * F.col("n_low"))
    per_pair = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_both"), F.first("n_low").alias("n_low"), F.min("whole").alias("one"), F.max("whole").alias("other"))
    per_pair = per_pair.filter(several & (F.col("n_both") >= LEAST_SHARE * F.col("n_low"))).drop("one", "other").join(with_entity, "entity")
    per_pair = saved(per_pair.filter(F.col("n_both") * F.col("n_kind") > F.col("n_low") * F.col("n_entity")), "pii-terms")
    scored = per_pair.join(term_documents(corpus, per_pair.select("term").distinct(), text), "term").withColumn("n_all", corpus.agg(F.count("*").alias("n_all")).scalar())
    bits = F.log2(F.col("n_all") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    general = F.log2(F.col("n_all") / F.col("n_kind"))
    told = saved(scored.filter((bits > general) & (F.col("n_both") >= LEAST_SHARE * F.col("n_term"))).select("term", "entity"), "pii-told")
    heard = words.select("k", F.explode("terms").alias("term")).join(_small(told), "term")
    return heard.join(held.select("k", "entity"), ["k", "entity"]).groupBy(F.col("k").alias(key)).agg(F.collect_set("term").alias("terms"))


def protect(df: DataFrame, text: str = "text") -> DataFrame:
    """df with spans: the entities, by kind and start, then the disclosing terms by start."""
    refuse(df, "spans")
    key, held, terms = (unused(x, df.columns) for x in ("_key", "_held", "_terms"))
    narrow = df.withColumn(held, F.coalesce(F.col(text), F.lit("")))
    table = find_entities(narrow, held, "spans").withColumn(held, F.when(F.size("spans") > 0, F.col(held)))
    table = saved(table.withColumn(key, F.monotonically_increasing_id()), "pii")
    found = table.filter(F.size("spans") > 0)
    told = disclosing_terms(found, narrow, held, "spans", key).withColumnRenamed("terms", terms)
    # The texts of documents without an entity stay out of the join's shuffle.
    some = found.join(told, key, "left").drop(key)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, held):
            spans = batch.column("spans").to_pylist()
            for k, (t, hashes) in enumerate(zip(batch.column(held).to_pylist(), batch.column(terms).to_pylist(), strict=True)):
                if hashes:
                    taken, wanted = [(s["start"], s["end"]) for s in spans[k]], set(hashes)
                    spans[k] = spans[k] + [{"kind": TERM, "start": s, "end": e} for word, s, e in _terms(t) if _hash(word) in wanted and not any(s < y and x < e for x, y in taken)]
            columns = [pa.array(spans, batch.schema.field("spans").type) if name == "spans" else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*df.columns, "spans"]
    marked = some.mapInArrow(mark, T.StructType([*df.schema.fields, T.StructField("spans", SPAN)]))
    return marked.unionByName(table.filter(F.size("spans") == 0).select(*names))


def of_kind(*kinds: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"].isin(*kinds)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, text: str = "text", out: str = "sanitised") -> DataFrame:
    """protect(df) with each entity and disclosing term of the text replaced by its generalisation, such as [EMAIL]."""

    @F.pandas_udf("string")
    def replace(texts, spans):
        import pandas as pd

        done = []
        for t, found in zip(texts, spans, strict=True):
            if t is None:
                done.append(None)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            done.append("".join(parts) + t[at:])
        return pd.Series(done, dtype=object)

    return protect(df, text).withColumn(out, replace(F.col(text), F.col("spans")))
