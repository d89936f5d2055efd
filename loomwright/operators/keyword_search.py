"""Keyword search: an index of weighted lexemes, BM25 with statistics of the whole corpus, phrases, cover density, and filters after scoring.

The lexemes of a chunk are those of its symbol, of the symbol split at capitals and of its path (weight A, counted twice), then those
of its content and of the content split at capitals. Their positions run on from part to part, so that a phrase may
cross parts. A chunk's length is its number of different lexemes.

A written index lies in folders by a hash of the repository, its postings sorted by repository and lexeme, and with a slice of the lexemes to a file where
there is much text. Each text is read into postings once, and these are shuffled once. A search joins the lexemes of its questions with postings; phrases
are found by positions. No search reads a text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.sources.tables import shared_dir

#: Fixed values of the ranking.
K1, B, PHRASE_BOOST = 1.2, 0.75, 1.5
#: The weight of a position in the symbol or path, and of one in the content, for cover density.
WEIGHT_A, WEIGHT_D = 1.0, 0.1
DIGITS = 6
#: Questions whose terms are held by the driver and broadcast, at most (about 1 kB each); more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Folders of a written index; bytes of text of a folder's share for each slice of its lexemes; rows of a batch.
BUCKETS, SLICE_BYTES, BATCH_ROWS = 64, 256 << 20, 100_000
PARTS = ("postings", "lexicon", "stats")

_WORD = re.compile("[A-Za-z0-9]+")
_CAMEL = re.compile("([a-z0-9])([A-Z])")


@dataclass(frozen=True)
class Index:
    """postings: repo_id, lexeme, chunk_id, n_a, n (occurrences with weight A, and all), positions (from 1), dl, length (all words of the chunk), a_size (how many
    of them have weight A); and one row for each chunk without a lexeme, which has language and file_path.
    lexicon: repo_id, lexeme, df. stats: repo_id, n and avgdl; chunks without a lexeme count with length 0."""

    postings: DataFrame
    lexicon: DataFrame
    stats: DataFrame

    @property
    def documents(self) -> DataFrame:
        return self.postings.filter(F.col("lexeme").isNull()).select("repo_id", "chunk_id", "language", "file_path", "dl", "length", "a_size")


def _words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits."""
    return " ".join(_WORD.findall(text)).lower().split()


def _split(text: str) -> str:
    return _CAMEL.sub(r"\1 \2", text)


def _chunk_words(symbol: str, path: str, content: str) -> tuple[list[str], int]:
    """All words of a chunk in order, and how many of them have weight A."""
    a = _words(f"{symbol} {_split(symbol)} {path}")
    plain = _words(content)
    return a + plain + (_words(_split(content)) if _CAMEL.search(content) else plain), len(a)


def _postings(chunks: DataFrame) -> DataFrame:
    ids = [chunks.schema["repo_id"], chunks.schema["chunk_id"]]
    whole = lambda *names: [T.StructField(c, T.IntegerType()) for c in names]
    texts = [T.StructField(c, T.StringType()) for c in ("language", "file_path")]
    schema = T.StructType([*ids, T.StructField("lexeme", T.StringType()), *whole("n_a", "n"), T.StructField("positions", T.ArrayType(T.IntegerType())), *whole("dl", "length", "a_size"), *texts])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)
        for batch in batches:
            done: list[list] = [[] for _ in arrow]
            for repo, chunk, language, path, symbol, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, a_size = _chunk_words(symbol or "", path or "", content or "")
                at: dict[str, list[int]] = {}
                for k, w in enumerate(words, 1):
                    at.setdefault(w, []).append(k)
                n = len(at) + 1
                n_a = [sum(k <= a_size for k in p) if p[0] <= a_size else 0 for p in at.values()]
                new = ([repo] * n, [chunk] * n, [None, *at], [0, *n_a], [0, *map(len, at.values())], [None, *at.values()], [len(at)] * n, [len(words)] * n, [a_size] * n, [language] + [None] * (n - 1), [path] + [None] * (n - 1))
                for column, values in zip(done, new, strict=True):
                    column += values
                if len(done[0]) >= BATCH_ROWS:
                    yield made(done)
                    done = [[] for _ in arrow]
            yield made(done)

    return chunks.select("repo_id", "chunk_id", "language", "file_path", "symbol", "content").mapInArrow(read, schema)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("repo_id").cast("string")), F.lit(BUCKETS)).cast("int")


def _lexicon(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("lexeme").isNotNull()).groupBy("repo_id", "lexeme").agg(F.count("*").alias("df"))


def _stats(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("lexeme").isNull()).groupBy("repo_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _write(df: DataFrame, path: str, slices: int = 1, mode: str = "error") -> None:
    """df in folders by bucket, sorted by repository and lexeme."""
    rows = df.withColumn("bucket", _bucket())
    if slices > 1:
        rows = rows.withColumn("slice", F.pmod(F.xxhash64(*[c for c in ("lexeme", "chunk_id") if c in df.columns]), F.lit(slices)))
    order = [c for c in ("bucket", "repo_id", "lexeme") if c in rows.columns]
    rows.repartition(*(c for c in ("bucket", "slice") if c in rows.columns)).sortWithinPartitions(*order).drop("slice").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _slices(chunks: DataFrame) -> int:
    return max(1, -(-(chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // (BUCKETS * SLICE_BYTES)))


def index(chunks: DataFrame, path: str | None = None) -> Index:
    """The index of chunks (repo_id, chunk_id, language, file_path, symbol, content); written to path, a folder that driver and executors share, if one is given."""
    postings = _postings(chunks)
    if path is None:
        return Index(postings, _lexicon(postings), _stats(postings))
    spark = chunks.sparkSession
    _write(postings, f"{path}/postings", _slices(chunks))
    # Only one row of each chunk and posting is read again, and little of it.
    written = spark.read.parquet(f"{path}/postings")
    _write(_lexicon(written), f"{path}/lexicon")
    _write(_stats(written), f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was written to path."""
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in PARTS])


def replace(spark: SparkSession, path: str, repositories: list, chunks: DataFrame) -> Index:
    """The index at path with the repositories' chunks in place of what it has of them; without chunks they go. Only the folders of their buckets are written anew.

    Each table is one commit; a search meanwhile can see an old and a new one. repositories: a handful of ids, such as one that was indexed again."""
    ids = spark.createDataFrame([(r,) for r in repositories], T.StructType([chunks.schema["repo_id"]]))
    buckets = sorted({r[0] for r in ids.select(_bucket()).collect()})
    staged = f"{shared_dir(spark)}/replace-{uuid.uuid4().hex}"
    _postings(chunks.join(F.broadcast(ids), "repo_id", "left_semi")).write.parquet(f"{staged}/new")
    new = spark.read.parquet(f"{staged}/new")
    for name, rows in zip(PARTS, (new, _lexicon(new), _stats(new)), strict=True):
        old = spark.read.parquet(f"{path}/{name}").filter(F.col("bucket").isin(buckets)).drop("bucket")
        # A folder cannot be read and written at once.
        old.join(F.broadcast(ids), "repo_id", "left_anti").unionByName(rows).write.parquet(f"{staged}/{name}")
        both = spark.read.schema(old.schema).parquet(f"{staged}/{name}")
        _write(both, f"{path}/{name}", _slices(chunks) if name == "postings" else 1, "overwrite")
        for bucket in set(buckets) - {r[0] for r in both.select(_bucket()).distinct().collect()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/bucket={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return open_index(spark, path)


def question_lexemes(terms: DataFrame) -> DataFrame:
    """(qid, repo_id, lexeme, whole) from questions (qid, repo_id, terms), once each; whole: the lexeme alone is a term."""
    each = F.flatten(F.transform("terms", lambda t: F.concat(F.when(t["whole"].isNotNull(), F.array(F.struct(t["whole"].alias("lexeme"), F.lit(True).alias("whole")))).otherwise(F.array().cast("array<struct<lexeme:string,whole:boolean>>")), F.transform(t["phrase"], lambda w: F.struct(w.alias("lexeme"), F.lit(False).alias("whole"))))))
    return terms.select("qid", "repo_id", F.inline(each)).groupBy("qid", "repo_id", "lexeme").agg(F.max("whole").alias("whole"))


def question_phrases(terms: DataFrame) -> DataFrame:
    """(qid, repo_id, phrase), once each."""
    return terms.select("qid", "repo_id", F.explode(F.transform("terms", lambda t: t["phrase"])).alias("phrase")).filter(F.size("phrase") > 0).distinct()


def _held(terms: DataFrame) -> tuple[DataFrame, bool]:
    """(terms, small): the terms of questions, held by the driver if there are few enough, so that they are found once; small says so."""
    rows = terms.select("qid", "repo_id", "terms")
    found = rows.limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS:
        return terms, False
    return terms.sparkSession.createDataFrame(found, rows.schema), True


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def term_frequency(indexed: Index, wanted: DataFrame) -> DataFrame:
    """repo_id, chunk_id, dl, lexeme and tf (weight A counts twice), for lexemes that some question of the repository has."""
    asked = wanted.select("repo_id", "lexeme").distinct()
    return indexed.postings.join(asked, ["repo_id", "lexeme"], "left_semi").select("repo_id", "chunk_id", "dl", "lexeme", (F.col("n") + F.col("n_a")).alias("tf"))


def bm25(indexed: Index, terms: DataFrame, small: bool = False) -> DataFrame:
    """(qid, repo_id, chunk_id, score, whole), unfiltered: the statistics see every chunk of the repository. whole: some term of one word matches. small: the terms may be broadcast."""
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = indexed.lexicon.select("repo_id", "lexeme", "df").join(_hint(question_lexemes(terms), small), ["repo_id", "lexeme"])
    known = known.join(indexed.stats.select("repo_id", F.col("n").alias("n_docs"), "avgdl"), "repo_id")
    met = indexed.postings.join(_hint(known.select("qid", "repo_id", "lexeme", "whole", "avgdl", weight.alias("weight")), small), ["repo_id", "lexeme"])
    tf = F.col("n") + F.col("n_a")
    part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("qid", "repo_id", "chunk_id").agg(F.sum(part).alias("score"), F.max("whole").alias("whole"))


def phrase_starts(words: Column, phrase: Column) -> Column:
    """The places, from 1, at which the words of phrase stand next to each other."""
    n = F.size(phrase)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.get(words, i - 1) == phrase[0])
    return F.filter(starts, lambda i: (n > 0) & (F.size(words) >= n) & (F.slice(words, i, n) == phrase))


def phrase_hits(indexed: Index, phrases: DataFrame, small: bool = False) -> DataFrame:
    """(qid, repo_id, chunk_id, phrase, starts, length, a_size) of chunks that have a phrase of (qid, repo_id, phrase), by the positions of its words.

    A chunk counts once it has every word of the phrase; the places where the phrase can begin are then those that all its words allow."""
    words = phrases.select("qid", "repo_id", "phrase", F.posexplode("phrase").alias("offset", "lexeme"))
    met = indexed.postings.join(_hint(words, small), ["repo_id", "lexeme"])
    begin = F.transform("positions", lambda p: p - F.col("offset"))
    by = met.groupBy("qid", "repo_id", "chunk_id", "phrase").agg(F.collect_list(begin).alias("begin"), F.first("length").alias("length"), F.first("a_size").alias("a_size"))
    starts = F.aggregate("begin", F.col("begin")[0], lambda kept, more: F.array_intersect(kept, more))
    found = by.filter(F.size("begin") == F.size("phrase")).withColumn("starts", F.array_sort(starts)).drop("begin")
    return found.filter(F.size("starts") > 0)


def _filtered(scored: DataFrame, indexed: Index, languages: list[str] | None, path_prefix: str) -> DataFrame:
    """scored less the chunks that the filters remove; scores stay."""
    if not (path_prefix or languages):
        return scored
    held = indexed.documents.filter(F.col("file_path").startswith(path_prefix)) if path_prefix else indexed.documents
    held = held.filter(F.col("language").isin(languages)) if languages else held
    return scored.join(held.select("repo_id", "chunk_id"), ["repo_id", "chunk_id"], "left_semi")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def search(indexed: Index, terms: DataFrame, k: int = 20, languages: list[str] | None = None, path_prefix: str = "") -> DataFrame:
    """(qid, rank, chunk_id, score): boosted where any term matches as a whole; the filters remove chunks, they never change a score."""
    terms, small = _held(terms)
    scored = bm25(indexed, terms, small)
    boosted = F.col("whole")
    kept = _filtered(scored, indexed, languages, path_prefix)
    phrases = question_phrases(terms)
    if not small or not phrases.isEmpty():
        phrased = phrase_hits(indexed, phrases, small).select("qid", "chunk_id").distinct().withColumn("phrased", F.lit(True))
        kept = kept.join(phrased, ["qid", "chunk_id"], "left")
        boosted = boosted | F.coalesce("phrased", F.lit(False))
    score = F.round(F.col("score") * F.when(boosted, PHRASE_BOOST).otherwise(1.0), DIGITS)
    return _ranked(kept.select("qid", "chunk_id", score.alias("score")), k)


def cover_density(indexed: Index, terms: DataFrame, k: int = 20, languages: list[str] | None = None, path_prefix: str = "") -> DataFrame:
    """(qid, rank, chunk_id, score): cover density of a question whose terms are alternatives, over 1 + the logarithm of the chunk's words.

    Every shortest cover counts the number of its positions over the sum of their reciprocal weights. For alternatives a cover is one
    occurrence of a word that is a term, or of a whole phrase. Terms that share words with a phrase count besides it.
    """
    terms, small = _held(terms)
    whole = question_lexemes(terms).filter("whole").drop("whole")
    met = indexed.postings.join(_hint(whole, small), ["repo_id", "lexeme"])
    found = met.select("qid", "repo_id", "chunk_id", "length", (WEIGHT_A * F.col("n_a") + WEIGHT_D * (F.col("n") - F.col("n_a"))).alias("gain"))
    phrases = question_phrases(terms)
    if not small or not phrases.isEmpty():
        n = F.size("phrase")
        # Of the n words from place i on, those up to a_size have weight A.
        in_a = lambda i: F.greatest(F.lit(0), F.least(n, F.col("a_size") - i + 1))
        cover = lambda i: n / (in_a(i) / F.lit(WEIGHT_A) + (n - in_a(i)) / F.lit(WEIGHT_D))
        gain = F.aggregate("starts", F.lit(0.0), lambda s, i: s + cover(i))
        found = found.unionByName(phrase_hits(indexed, phrases, small).select("qid", "repo_id", "chunk_id", "length", gain.alias("gain")))
    total = found.groupBy("qid", "repo_id", "chunk_id", "length").agg(F.sum("gain").alias("gain"))
    kept = _filtered(total, indexed, languages, path_prefix)
    return _ranked(kept.select("qid", "chunk_id", F.round(F.col("gain") / F.log(1.0 + F.col("length")), DIGITS).alias("score")), k)
