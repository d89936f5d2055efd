"""Queries over the given tables, one for each operator, with the SQL that must give the same rows.

The tables stand in for those of a code search: documents are chunks (source: repository, lang: language), benchmark items are
questions, embeddings are vectors, events are job events or requests, conversations are blocks of context.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import answers, text, vectors
from loomwright.operators import chunks, fusion, keyword_search, metrics, prompts, vector_search
from loomwright.plans import ask
from loomwright.sources import tables
from loomwright.sources.tables import table
from loomwright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks."""
    path = F.concat_ws("/", "source", F.concat("lang", F.lit(".md")))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"), path.alias("file_path"), F.lit(None).cast("string").alias("symbol"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question to one repository, with its terms."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo_id"), "text")
    return asked.select("qid", "repo_id", "text", answers.question_terms("text").alias("terms"))


_INDEXES: dict[tuple[str, str], keyword_search.Index] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> keyword_search.Index:
    """The keyword index of documents, written to the shared folder once a session and read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = keyword_search.index(documents(spark, sf_dir), f"{tables.shared_dir(spark)}/keyword-{uuid.uuid4().hex}")
    return _INDEXES[key]


# Vector search ------------------------------------------------------------------------------------------------------

NEAREST_SQL = """
SELECT qid, CAST(rank AS INTEGER) AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
    SELECT q.vec_id AS qid, r.vec_id AS id, round(list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 {where}))
WHERE rank <= {k}
"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, labels: list[int] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    held = rows if labels is None else rows.filter(F.col("label").isin(labels))
    return vector_search.nearest(asked, held, k)


@query(NEAREST_SQL.format(where="", k=10))
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10)


@query(NEAREST_SQL.format(where="AND r.label IN (1, 2, 3)", k=20))
def vector_nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 20, [1, 2, 3])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding)::BIGINT AS dimension, list_aggregate(list_transform(embedding::DOUBLE[], lambda x: abs(x)), 'max') > 0 AS usable FROM embeddings")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dimension"), vectors.is_usable(F.col("embedding"), 64).alias("usable"))


@query(
    """
SELECT qid, CAST(rank AS INTEGER) AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
    SELECT q.vec_id AS qid, r.vec_id AS id, round(list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 20 = 0))
WHERE rank <= 10
"""
)
def vector_nearest_in_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question meets the vectors of its own corpus alone; labels stand for corpora."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "embedding", "label")
    return vector_search.nearest(asked, rows, 10, scope="label")


@query("SELECT vec_id, len(embedding)::BIGINT AS dimension, round(embedding[1]::DOUBLE, 7) AS first, round(embedding[-1]::DOUBLE, 7) AS last, round(list_aggregate(embedding::DOUBLE[], 'max'), 7) AS greatest, true AS same FROM embeddings")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read back from their literals: where they begin and end, their greatest number, and whether they are as they were."""
    e = table(spark, sf_dir, "embeddings").withColumn("read", vectors.from_literal(vectors.to_literal(F.col("embedding"))))
    at = lambda k: F.round(F.element_at("read", k).cast("double"), 7)
    return e.select("vec_id", F.size("read").cast("long").alias("dimension"), at(1).alias("first"), at(-1).alias("last"), F.round(F.array_max("read").cast("double"), 7).alias("greatest"), (F.col("read") == F.col("embedding")).alias("same"))


# Keyword search -----------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in sorted(answers.STOPWORDS))
#: Benchmark texts have no quotes, underscores or capitals inside words, so that each question is a set of words.
INDEX_SQL = rf"""
d AS (SELECT source AS repo_id, doc_id AS chunk_id, lang, concat_ws('/', source, lang || '.md') AS file_path, coalesce(text, '') AS t,
             regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS camel FROM documents),
ix AS (SELECT repo_id, chunk_id, lang, file_path, regexp_extract_all(lower(regexp_replace(file_path, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS a,
              list_concat(regexp_extract_all(lower(regexp_replace(t, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+'), regexp_extract_all(lower(regexp_replace(camel, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')) AS rest FROM d),
dl AS (SELECT repo_id, chunk_id, len(list_distinct(list_concat(a, rest))) AS dl FROM ix),
st AS (SELECT repo_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY repo_id),
q AS (SELECT DISTINCT item_id AS qid, 'src' || (item_id % 20) AS repo_id, lower(w) AS lexeme FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark) WHERE lower(w) NOT IN ({STOP})),
tok AS (SELECT repo_id, chunk_id, unnest(a) AS lexeme, 2 AS w FROM ix UNION ALL SELECT repo_id, chunk_id, unnest(rest), 1 FROM ix),
tf AS (SELECT repo_id, chunk_id, lexeme, sum(w) AS tf FROM tok SEMI JOIN q USING (repo_id, lexeme) GROUP BY ALL),
df AS (SELECT repo_id, lexeme, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT qid, repo_id, chunk_id, round(1.5 * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (repo_id, lexeme) JOIN st USING (repo_id) JOIN dl USING (repo_id, chunk_id) JOIN q USING (repo_id, lexeme) GROUP BY ALL),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM sc),
english AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM sc JOIN ix USING (repo_id, chunk_id) WHERE lang = 'en')
"""
BM25_SQL = f"WITH {INDEX_SQL} SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM ranked WHERE rank <= 20"


@query(f"WITH {INDEX_SQL} SELECT repo_id, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM st")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = keyword_index(spark, sf_dir).stats
    return stats.select("repo_id", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {INDEX_SQL} SELECT repo_id, lexeme, df::BIGINT AS df, total::BIGINT AS total FROM df JOIN (SELECT repo_id, lexeme, sum(tf) AS total FROM tf GROUP BY ALL) USING (repo_id, lexeme)")
def lexeme_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = keyword_search.term_frequency(keyword_index(spark, sf_dir), keyword_search.question_lexemes(questions(spark, sf_dir)))
    return tf.groupBy("repo_id", "lexeme").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(BM25_SQL)
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search.search(keyword_index(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {INDEX_SQL} SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM english WHERE rank <= 20")
def keyword_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language filter removes chunks and leaves scores alone."""
    return keyword_search.search(keyword_index(spark, sf_dir), questions(spark, sf_dir), languages=["en"])


@query(
    f"""WITH {INDEX_SQL}, occ AS (SELECT repo_id, chunk_id, unnest(a) AS lexeme, 1.0::DOUBLE AS w FROM ix UNION ALL SELECT repo_id, chunk_id, unnest(rest), 0.1 FROM ix),
cd AS (SELECT qid, chunk_id, round(sum(w) / ln(1 + any_value(len(a) + len(rest))), 6) AS score FROM occ JOIN q USING (repo_id, lexeme) JOIN ix USING (repo_id, chunk_id) GROUP BY ALL)
SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM cd) WHERE rank <= 20"""
)
def keyword_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search.cover_density(keyword_index(spark, sf_dir), questions(spark, sf_dir))


#: A question of two words in quotes, two with an underscore and two as camelCase, from the words of each item.
PHRASED = """concat('"', w[0], ' ', w[1], '" ', w[2], '_', w[3], ' ', w[4], upper(substr(w[5], 1, 1)), substr(w[5], 2))"""


@query(
    f"""WITH {INDEX_SQL}, b AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS repo_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z]+')) >= 6),
lx AS (SELECT DISTINCT qid, repo_id, unnest([w[1], w[2], w[3], w[4], w[5], w[6], w[5] || w[6]]) AS lexeme FROM b),
wd AS (SELECT repo_id, chunk_id, ' ' || array_to_string(list_concat(a, rest), ' ') || ' ' AS s FROM ix),
tf2 AS (SELECT repo_id, chunk_id, lexeme, sum(w) AS tf FROM tok SEMI JOIN lx USING (repo_id, lexeme) GROUP BY ALL),
df2 AS (SELECT repo_id, lexeme, count(*) AS df FROM tf2 GROUP BY ALL),
sc2 AS (SELECT qid, repo_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf2 JOIN df2 USING (repo_id, lexeme) JOIN st USING (repo_id) JOIN dl USING (repo_id, chunk_id) JOIN lx USING (repo_id, lexeme) GROUP BY ALL),
bo AS (SELECT qid, chunk_id, round(score * CASE WHEN contains(s, ' ' || w[1] || ' ' || w[2] || ' ') OR contains(s, ' ' || w[3] || ' ' || w[4] || ' ') OR contains(s, ' ' || w[5] || ' ' || w[6] || ' ') OR contains(s, ' ' || w[5] || w[6] || ' ') THEN 1.5 ELSE 1 END, 6) AS score
       FROM sc2 JOIN wd USING (repo_id, chunk_id) JOIN b USING (qid, repo_id))
SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bo) WHERE rank <= 20"""
)
def keyword_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with quoted, snake_case and camelCase parts: a chunk with the words of one next to each other is boosted."""
    words = F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)").alias("w")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo_id"), words).filter(F.size("w") >= 6)
    return keyword_search.search(keyword_index(spark, sf_dir), asked.select("qid", "repo_id", answers.question_terms(F.expr(PHRASED)).alias("terms")))


@query(
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT item_id, w AS p, w[1] AS lexeme, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) > 0),
x AS (SELECT doc_id, w, i, w[i] AS lexeme FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d))
SELECT item_id, count(DISTINCT doc_id) AS n FROM x JOIN p USING (lexeme) WHERE w[i : i + n - 1] = p GROUP BY item_id
"""
)
def phrase_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have the words of each question next to each other. Documents with a question's first word are looked at."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.lexemes(F.col("text")).alias("w"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", text.lexemes(F.col("text")).alias("p")).filter(F.size("p") > 0)
    first = rows.select("doc_id", F.explode(F.array_distinct("w")).alias("lexeme")).join(asked.select("item_id", F.col("p")[0].alias("lexeme")), "lexeme")
    met = first.select("doc_id", "item_id").join(rows, "doc_id").join(asked, "item_id").filter(F.size(keyword_search.phrase_starts(F.col("w"), F.col("p"))) > 0)
    return met.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))


# Fusion and reordering ----------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A vector list and a keyword list for each question; embeddings are paired with documents by number alone."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = table(spark, sf_dir, "benchmark").select("item_id").join(rows, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("qid"), "embedding")
    near = vector_search.nearest(asked, rows, 20).withColumnRenamed("id", "chunk_id")
    return near, keyword_bm25(spark, sf_dir)


LISTS_SQL = f"""
WITH {INDEX_SQL},
v AS (SELECT qid, id AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
  SELECT q.vec_id AS qid, r.vec_id AS id, round(list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS distance
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings r)) WHERE rank <= 20),
k AS (SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 20),
f AS (SELECT qid, chunk_id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(0.75 / (60 + k.rank), 0), 9) AS fused_score FROM v FULL JOIN k USING (qid, chunk_id)),
fr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, chunk_id) AS rank, chunk_id, fused_score FROM f)
"""


@query(LISTS_SQL + " SELECT qid, CAST(rank AS INTEGER) AS rank, chunk_id, fused_score FROM fr WHERE rank <= 8")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(*_lists(spark, sf_dir))


@query(
    LISTS_SQL
    + """, b AS (SELECT qid, rank, chunk_id FROM fr WHERE rank <= 20),
said AS (SELECT qid, rank AS place, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS said FROM b WHERE chunk_id % 3 = 0)
SELECT qid, CAST(new AS INTEGER) AS rank, chunk_id FROM (
  SELECT b.qid, chunk_id, row_number() OVER (PARTITION BY b.qid ORDER BY b.rank > 10, (CASE WHEN b.rank <= 10 THEN said END) IS NULL, CASE WHEN b.rank <= 10 THEN said END, b.rank) AS new
  FROM b LEFT JOIN said ON b.qid = said.qid AND b.rank = said.place) WHERE new <= 8"""
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model names the chunks with ids divisible by three, in order of their ids."""
    base = fusion.fuse(*_lists(spark, sf_dir), top=20).select("qid", "rank", "chunk_id")
    named = base.filter("chunk_id % 3 = 0").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "rank"))).alias("all"))
    told = named.select("qid", F.transform("all", lambda x: x["rank"] - 1).alias("ranking"))
    return fusion.rerank(base, told, depth=10, top=8)


@query(
    LISTS_SQL
    + " SELECT f.qid, f.chunk_id, CAST(v.rank AS INTEGER) AS vector, CAST(k.rank AS INTEGER) AS keyword FROM fr f LEFT JOIN v USING (qid, chunk_id) LEFT JOIN k USING (qid, chunk_id) WHERE f.rank <= 8"
)
def places_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _lists(spark, sf_dir)
    return fusion.places({"vector": near, "keyword": words}, fusion.fuse(near, words).select("qid", "chunk_id"))


# Evaluation ---------------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a question's repository that share its first word at least twice are relevant, on four lines of each, every fifth as context alone."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), F.element_at(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1).alias("w"))
    words = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(text.lexemes(F.col("text"))).alias("w"))
    met = words.join(asked, ["source", "w"]).groupBy("qid", "doc_id").agg(F.count("*").alias("n")).filter("n >= 2")
    start = (F.col("doc_id") % 12 + 1).cast("int")
    return met.select("qid", F.col("doc_id").alias("label"), F.col("doc_id").cast("string").alias("file"), start.alias("start"), (start + 3).alias("end"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("grade"))


def _spans(found: DataFrame) -> DataFrame:
    """A retrieved list with a span of five lines for each chunk."""
    start = (F.col("chunk_id") % 3 + 5).cast("int")
    return found.select("qid", "rank", F.col("chunk_id").cast("string").alias("file"), start.alias("start"), (start + 4).alias("end"))


def _run(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test").alias("split"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo"))
    labels = _labels(spark, sf_dir)
    return metrics.scores(asked, metrics.hits(_spans(found), labels), labels)


SCORES_SQL = rf"""
WITH {INDEX_SQL},
ask AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS repo, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, regexp_extract_all(lower(text), '[a-z0-9]+')[1] AS w FROM benchmark),
lab AS (SELECT DISTINCT qid, doc_id, doc_id % 12 + 1 AS s, doc_id % 12 + 4 AS e, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS grade FROM ask JOIN documents ON source = repo WHERE len(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+'), lambda x: x = w)) >= 2),
want AS (SELECT qid, count(*) AS wanted FROM lab WHERE grade = 2 GROUP BY qid)
"""


def _scores_sql(name: str, ranked: str) -> str:
    return f"""
{name}_hit AS (SELECT qid, min(rank) AS first, count(*) FILTER (rank <= 8) AS covered FROM {ranked} JOIN lab ON {ranked}.qid = lab.qid AND chunk_id = doc_id AND grade = 2 AND s <= chunk_id % 3 + 9 AND chunk_id % 3 + 5 <= e WHERE rank <= 20 GROUP BY {ranked}.qid),
{name} AS (SELECT ask.qid, split, repo, coalesce(first, 0) AS first, {", ".join(f"(coalesce(first, 0) BETWEEN 1 AND {k})::DOUBLE AS recall_{k}" for k in metrics.RECALL_AT)},
  CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 / first END AS reciprocal, coalesce(covered / wanted, 0.0) AS coverage FROM ask LEFT JOIN {name}_hit h ON ask.qid = h.qid LEFT JOIN want ON ask.qid = want.qid)"""


RUNS_SQL = SCORES_SQL + "," + _scores_sql("run", "ranked").replace("SELECT qid, min", "SELECT ranked.qid, min") + "," + _scores_sql("base", "english").replace("SELECT qid, min", "SELECT english.qid, min")
MEANS = [*(f"recall_{k}" for k in metrics.RECALL_AT), "reciprocal", "coverage"]


@query(RUNS_SQL + f" SELECT qid, split, repo, CAST(first AS INTEGER) AS first, {', '.join(f'round({m}, 6) AS {m}' for m in MEANS)} FROM run")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, keyword_bm25(spark, sf_dir))
    return out.select("qid", "split", "repo", "first", *[F.round(m, 6).alias(m) for m in MEANS])


@query(
    RUNS_SQL
    + f""" SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(repo) = 0 THEN 'repo' ELSE 'all' END AS dimension, coalesce(split, repo, 'all') AS value, count(*) AS n,
{', '.join(f'round(avg({m}), 6) AS {m}' for m in MEANS)} FROM run GROUP BY GROUPING SETS ((), (split), (repo))"""
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(_run(spark, sf_dir, keyword_bm25(spark, sf_dir)), ["split", "repo"])
    return out.select("dimension", "value", "n", *[F.round(m, 6).alias(m) for m in MEANS])


@query(
    RUNS_SQL
    + """ SELECT run.qid, CAST(run.first AS INTEGER) AS first, CAST(base.first AS INTEGER) AS base_first,
CASE WHEN coalesce(nullif(run.first, 0), 1073741824) < coalesce(nullif(base.first, 0), 1073741824) THEN 'better' WHEN coalesce(nullif(run.first, 0), 1073741824) > coalesce(nullif(base.first, 0), 1073741824) THEN 'worse' ELSE 'unchanged' END AS change
FROM run JOIN base ON run.qid = base.qid"""
)
def evaluation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compared(_run(spark, sf_dir, keyword_bm25(spark, sf_dir)), _run(spark, sf_dir, keyword_bm25_filtered(spark, sf_dir)))


@query(
    f"""WITH {INDEX_SQL}, a AS (SELECT * FROM ranked WHERE rank <= 20), b AS (SELECT * FROM english WHERE rank <= 20),
m AS (SELECT coalesce(a.qid, b.qid) AS qid, min(coalesce(a.rank, b.rank)) FILTER (a.chunk_id IS DISTINCT FROM b.chunk_id) AS differs FROM a FULL JOIN b ON a.qid = b.qid AND a.rank = b.rank GROUP BY 1)
SELECT qid, differs IS NULL AS same, CAST(differs AS INTEGER) AS differs_at FROM m"""
)
def run_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.same_lists(keyword_bm25(spark, sf_dir), keyword_bm25_filtered(spark, sf_dir))


@query(
    SCORES_SQL
    + """ SELECT r.qid, CAST(r.rank AS INTEGER) AS rank, coalesce(max(grade), 0)::INTEGER AS grade FROM ranked r
LEFT JOIN lab ON r.qid = lab.qid AND chunk_id = doc_id AND s <= chunk_id % 3 + 9 AND chunk_id % 3 + 5 <= e WHERE r.rank <= 20 GROUP BY r.qid, r.rank"""
)
def best_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best grade that each retrieved span reaches."""
    ranked = _spans(keyword_bm25(spark, sf_dir))
    return metrics.best_grades(ranked, metrics.hits(ranked, _labels(spark, sf_dir)))


@query(RUNS_SQL + f" SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in MEANS)} FROM run WHERE split = 'dev' AND qid % 8 <> 6")
def evaluation_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the answerable questions of the development split; every eighth question stands for one without an answer."""
    asked = _run(spark, sf_dir, keyword_bm25(spark, sf_dir)).withColumn("kind", F.when(F.col("qid") % 8 == 6, "unanswerable").otherwise("where"))
    out = metrics.summary(metrics.answerable(metrics.of_split(asked, "dev")), [])
    return out.select("dimension", "value", "n", *[F.round(m, 6).alias(m) for m in MEANS])


@query(
    RUNS_SQL
    + f""", b AS (SELECT split, repo, {", ".join(f"run.{m} AS {m}, base.{m} AS base_{m}" for m in MEANS)} FROM run JOIN base USING (qid, split, repo) WHERE qid % 3 <> 0)
SELECT CASE WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS dimension, coalesce(split, 'all') AS value, count(*) AS n,
{", ".join(f"round(CASE WHEN abs(avg({m}) - avg(base_{m})) < 0.0005 THEN 0.0 ELSE avg({m}) - avg(base_{m}) END, 6) + 0.0 AS {m}" for m in MEANS)} FROM b GROUP BY GROUPING SETS ((), (split))"""
)
def evaluation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the means of two runs over the questions that both scored; the second lacks every third."""
    run, base = _run(spark, sf_dir, keyword_bm25(spark, sf_dir)), _run(spark, sf_dir, keyword_bm25_filtered(spark, sf_dir)).filter("qid % 3 <> 0")
    out = metrics.paired(run, base, ["split"])
    return out.select("dimension", "value", "n", *[(F.round(m, 6) + 0.0).alias(m) for m in MEANS])


@query(
    RUNS_SQL
    + """, p AS (SELECT run.qid, run.first <> base.first AS changed, run.recall_8 = 1 AS passed, base.recall_3 = 1 AS base_passed FROM run JOIN base ON run.qid = base.qid)
SELECT qid, why FROM (SELECT qid, CASE WHEN changed THEN 'changed' WHEN NOT passed OR NOT base_passed THEN 'failed' ELSE 'spot check' END AS why FROM p)
QUALIFY why <> 'spot check' OR row_number() OVER (PARTITION BY why ORDER BY qid) <= 3"""
)
def pairs_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that a reader looks at: changed ones, failed ones, and three that neither changed nor failed."""
    run, base = _run(spark, sf_dir, keyword_bm25(spark, sf_dir)), _run(spark, sf_dir, keyword_bm25_filtered(spark, sf_dir))
    both = run.select("qid", F.col("first").alias("now"), (F.col("recall_8") == 1).alias("passed")).join(base.select("qid", F.col("first").alias("then"), (F.col("recall_3") == 1).alias("base_passed")), "qid")
    return metrics.to_review(both.select("qid", (F.col("now") != F.col("then")).alias("changed"), "passed", "base_passed"), 3)


@query(
    """
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source, 'all') AS value, count(*) FILTER (quality = 1) AS passed, count(*) AS asked
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))
"""
)
def pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good labels stand for answers that pass."""
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return metrics.pass_counts(met.select("lang", "source", (F.col("quality") == 1).alias("passed")), ["lang", "source"])


@query(
    """
WITH c AS (SELECT event_type = 'view' AS cached, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'unparseable' ELSE 'error' END END AS fallback FROM events)
SELECT CASE WHEN cached THEN 'cache hits' ELSE 'calls' END AS counter, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'fallback: ' || fallback, count(*) FROM c WHERE fallback IS NOT NULL GROUP BY 1
"""
)
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a reranker: views come from the cache, errors fall back for one of three reasons."""
    reason = F.element_at(F.array(F.lit("timeout"), F.lit("unparseable"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("cached"), F.when(F.col("event_type") == "error", reason).alias("fallback"))
    return metrics.fallback_counts(calls)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, max(value) AS p100, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = metrics.group_percentiles(e, "event_type", "value", {"p50": 50, "p90": 90, "p100": 100}, "middle")
    return found.withColumn("middle", F.round("middle", 6))


@query("SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def label_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counted = met.groupBy("lang").pivot("quality", [0, 1]).count().fillna(0)
    return counted.select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))


# Chunks -------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("text").alias("language"), "text")


LINES_SQL = """
f AS (SELECT doc_id AS file, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents),
g AS (SELECT file, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM f),
l AS (SELECT file, i AS n, a[i] AS line FROM (SELECT file, a, unnest(range(1, len(a) + 1)) AS i FROM g))
"""


@query(
    f"""WITH {LINES_SQL}, b AS (SELECT file, len(a) AS n FROM g WHERE len(a) > 0),
w AS (SELECT file, n, unnest(range(0, greatest(ceil((n - 5) / 4.0), 0)::BIGINT + 1)) AS i FROM b)
SELECT file, CAST(1 + i * 4 AS INTEGER) AS s, CAST(least(n, i * 4 + 5) AS INTEGER) AS e FROM w"""
)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5 lines that overlap by 1."""
    n = chunks.lines(_files(spark, sf_dir)).groupBy("file").agg(F.max("n").alias("n"))
    return n.select("file", F.inline(chunks.windows(F.lit(1), F.col("n"), 5, 1)))


@query(
    f"""WITH {LINES_SQL}, taken AS (SELECT file, n FROM l WHERE length(line) > 200),
free AS (SELECT file, n, line, n - row_number() OVER (PARTITION BY file ORDER BY n) AS run FROM l ANTI JOIN taken USING (file, n)),
r AS (SELECT file, min(n) AS s, max(n) AS e, count(*) AS solid FROM free WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY file, run)
SELECT r.file, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM r WHERE solid >= CASE WHEN file IN (SELECT file FROM taken) THEN 3 ELSE 1 END"""
)
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines between lines of over 200 characters."""
    of = chunks.lines(_files(spark, sf_dir))
    long_ = of.filter(F.length("line") > 200).select("file", F.col("n").alias("start"), F.col("n").alias("end"))
    return chunks.gaps(of, long_)


@query(
    rf"""WITH RECURSIVE {LINES_SQL},
marks AS (SELECT file, n, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS m, trim(line, e' \t\n\x0B\f\r') AS alone, row_number() OVER (PARTITION BY file ORDER BY n) AS i FROM l WHERE regexp_matches(line, '^ {{0,3}}(`{{3,}}|~{{3,}})')),
st AS (SELECT file, i, n, m AS open FROM marks WHERE i = 1 UNION ALL
       SELECT k.file, k.i, k.n, CASE WHEN open = '' THEN m WHEN left(m, 1) = left(open, 1) AND length(m) >= length(open) AND alone = m THEN '' ELSE open END FROM st JOIN marks k ON k.file = st.file AND k.i = st.i + 1),
x AS (SELECT l.file, l.n, line, coalesce(open, '') AS open FROM l ASOF LEFT JOIN st ON l.file = st.file AND l.n > st.n),
h AS (SELECT file, n, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$', 2), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')) AS title
      FROM x WHERE open = '' AND regexp_matches(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$')),
path AS (SELECT h.file, h.n, string_agg(a.title, ' > ' ORDER BY a.n) AS symbol FROM h JOIN h a ON a.file = h.file AND (a.n = h.n OR a.n < h.n AND a.level < h.level AND NOT EXISTS (SELECT 1 FROM h b WHERE b.file = h.file AND b.n > a.n AND b.n < h.n AND b.level <= a.level)) GROUP BY ALL),
s AS (SELECT l.file, l.n, line, h.n AS head FROM l ASOF LEFT JOIN h ON l.file = h.file AND l.n >= h.n),
body AS (SELECT file, head, min(n) AS first, max(n) AS last FROM s WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY file, head HAVING head IS NULL OR count(*) > 1),
w AS (SELECT file, head, first, last, unnest(range(0, greatest(ceil((last - first + 1 - 20) / 18.0), 0)::BIGINT + 1)) AS i FROM body),
c AS (SELECT w.file, head, first + i * 18 AS s, least(last, first + i * 18 + 19) AS e, array_to_string(a[s : e], chr(10)) AS content FROM w JOIN g ON w.file = g.file),
k AS (SELECT *, row_number() OVER (PARTITION BY file, head ORDER BY s) AS part, count(*) OVER (PARTITION BY file, head) AS parts FROM c WHERE regexp_matches(content, '[^ \t-\r]'))
SELECT k.file::VARCHAR AS file, symbol, 'doc' AS kind, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end",
       sha256('File: ' || k.file || chr(10) || 'Language: markdown' || chr(10) || 'Symbol: ' || coalesce(symbol, '(none)') || chr(10) || 'Kind: doc' || CASE WHEN parts > 1 THEN chr(10) || 'Part: ' || part || '/' || parts ELSE '' END || chr(10) || '---' || chr(10) || content) AS text_hash
FROM k LEFT JOIN path ON path.file = k.file AND path.n = head"""
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file, in chunks of at most 20 lines."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("markdown").alias("language"), "text")
    return chunks.chunk(files, 20, 2).select("file", "symbol", "kind", "start", "end", "text_hash")


#: A document within code of three languages: its lines stand in strings, comments and templates, beside lines that only look like declarations.
CODE_FILES = {
    "python": 'note = """\n@T\ndef fake():\n"""\n\n# about @I\n@deco(\n    @I,\n)\ndef f@I(\n    a,\n):\n    return """\n@T\n"""\nclass C@I:\n    x = (\n0)\n    def m(self): return [\n]\n',
    "go": "package a\n\n/* about\n@T\n*/\nfunc (s *S@I) Run(\n\ta int,\n) string {\n\treturn `\n@T\n}\n`\n}\ntype (\n\tA@I struct {\n\t\tx int\n\t}\n\t// says\n\tB@I interface{ M() }\n)\ntype D@I = string\n",
    "typescript": "const note = `\n@T\nfunction fake() {\n`;\nexport default function (\n  a: string,\n): string\n{\n  return `${[`}`, a].join()}\n@T\n`;\n}\n@Part({\n  n: @I,\n})\nexport class W@I {\n  // goes\n  go(): void {\n  }\n}\n",
}


@query(
    """WITH d AS (SELECT doc_id AS i, doc_id % 3 AS m, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS k FROM documents),
s AS (SELECT i, unnest(CASE m
  WHEN 0 THEN [{s: 'f' || i, kind: 'function', a: k + 5, b: 2 * k + 13}, {s: 'C' || i, kind: 'class', a: 2 * k + 14, b: 2 * k + 16}, {s: 'C' || i || '.m', kind: 'method', a: 2 * k + 17, b: 2 * k + 18}]
  WHEN 1 THEN [{s: 'S' || i || '.Run', kind: 'method', a: 3, b: 2 * k + 11}, {s: 'A' || i, kind: 'struct', a: 2 * k + 13, b: 2 * k + 15}, {s: 'B' || i, kind: 'interface', a: 2 * k + 16, b: 2 * k + 17}, {s: 'D' || i, kind: 'type', a: 2 * k + 19, b: 2 * k + 19}]
  ELSE [{s: 'default', kind: 'function', a: k + 4, b: 2 * k + 10}, {s: 'W' || i, kind: 'class', a: 2 * k + 11, b: 2 * k + 14}, {s: 'W' || i || '.go', kind: 'method', a: 2 * k + 15, b: 2 * k + 17}] END) AS p FROM d)
SELECT i AS file, p.s AS symbol, p.kind AS kind, CAST(p.a AS INTEGER) AS start, CAST(p.b AS INTEGER) AS "end" FROM s"""
)
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of every document within code; classes of over four lines as their members."""
    k = F.col("doc_id")
    text_ = F.translate(F.coalesce("text", F.lit("")), "`\"'\\$*@", "")
    code = [F.replace(F.replace(F.lit(c), F.lit("@I"), k.cast("string")), F.lit("@T"), text_) for c in CODE_FILES.values()]
    language = F.element_at(F.array(*map(F.lit, CODE_FILES)), (k % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(k.alias("file"), language.alias("language"), F.when(k % 3 == 0, code[0]).when(k % 3 == 1, code[1]).otherwise(code[2]).alias("text"))
    return chunks.symbols(chunks.states(files), 4).select("file", F.inline("pieces"))


@query(f"WITH {LINES_SQL} SELECT doc_id, len(a)::BIGINT AS n_lines, (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS counted FROM documents JOIN g ON doc_id = file")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(text.split_lines(F.col("t"))).cast("long").alias("n_lines"), text.line_count(F.col("t")).cast("long").alias("counted"))


@query(
    f"""WITH {LINES_SQL}, solid AS (SELECT file, n FROM l WHERE regexp_matches(line, '[^ \t-\r]')), p AS (SELECT file, min(n) AS first, max(n) AS last FROM solid GROUP BY file),
w AS (SELECT file, first, last, unnest(range(0, greatest(ceil((last - first + 1 - 5) / 4.0), 0)::BIGINT + 1)) AS i FROM p),
c AS (SELECT file, first + i * 4 AS s, least(last, first + i * 4 + 4) AS e FROM w),
k AS (SELECT c.file, array_to_string(a[s : e], chr(10)) AS content FROM c JOIN g ON c.file = g.file WHERE EXISTS (SELECT 1 FROM solid WHERE solid.file = c.file AND n BETWEEN s AND e))
SELECT lang AS language, 'window' AS kind, count(*) AS chunks, count(DISTINCT file) AS files, max(length(content))::BIGINT AS longest FROM k JOIN documents ON doc_id = file GROUP BY lang"""
)
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most five lines, counted by language and kind, with the longest."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("language"), "text")
    return chunks.report(chunks.chunk(files, 5, 1))


# Addresses, paths and files -----------------------------------------------------------------------------------------


#: Pages give addresses of every kind; the same words in either SQL.
ADDRESS = """CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN concat('https://github.com/owner', page_id, '/repo.git') WHEN 2 THEN concat(' HTTPS://GitHub.com/a-b/c_', page_id, '/ ')
WHEN 3 THEN concat('https://github.com/-x/', page_id) WHEN 4 THEN concat('https://github.com/a/b/', page_id) WHEN 5 THEN concat('http://github.com/a/', page_id) WHEN 6 THEN 'https://github.com/a/..'
WHEN 7 THEN concat('https://github.com/a/b?x=', page_id) WHEN 8 THEN ' ' WHEN 9 THEN concat('https://github.com/a/', repeat('b', 200)) WHEN 10 THEN concat('https://github.com/a/-', page_id) ELSE concat('https://', page_id, '.com/a/b') END"""


@query(
    rf"""
WITH p AS (SELECT page_id, trim(coalesce({ADDRESS}, ''), e' \t\n\x0B\f\r') AS s FROM pages),
h AS (SELECT *, lower(split_part(substr(s, 9), '/', 1)) AS host FROM p),
x AS (SELECT *, string_split(regexp_replace(regexp_replace(substr(s, 9 + length(host)), '/$', ''), '\.git$', ''), '/') AS part FROM h),
r AS (SELECT *, CASE WHEN s = '' THEN 'no address' WHEN length(s) > 200 THEN 'over 200 characters'
  WHEN NOT regexp_full_match(s, '[\x21-\x7E]+') OR regexp_matches(s, '[%\\?#]') THEN 'a character that addresses of repositories do not have'
  WHEN NOT starts_with(lower(s), 'https://') THEN 'not an https address' WHEN host <> 'github.com' THEN 'another host' WHEN len(part) <> 3 OR part[1] <> '' THEN 'not the form owner/name'
  WHEN NOT regexp_full_match(part[2], '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?') OR length(part[2]) > 39 THEN 'owner breaks the host''s rule'
  WHEN NOT regexp_full_match(part[3], '[A-Za-z0-9._][A-Za-z0-9._-]*') OR length(part[3]) > 100 OR part[3] IN ('.', '..') THEN 'name breaks the host''s rule' END AS reason FROM x)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN 'https://github.com/' || part[2] || '/' || part[3] END AS url FROM r
"""
)
def repository_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", text.repository_url(F.expr(ADDRESS)).alias("x"))
    return found.select("page_id", "x.reason", "x.url")


@query(
    r"""
WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^[^/]*//[^/]*/', ''), '?', 1), '#', 1) AS path FROM pages)
SELECT page_id, starts_with(path, 'en/') AS english, regexp_matches(lower(path), '(^|/)(test|tests|__tests__|testdata|spec)/') OR regexp_matches(lower(path), '(^|/)conftest\.py$|_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[jt]sx?$') AS test FROM p
"""
)
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.substring_index(F.substring_index(F.regexp_replace("url", "^[^/]*//[^/]*/", ""), "?", 1), "#", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("p")).select("page_id", F.col("p").startswith("en/").alias("english"), text.is_test_path(F.col("p")).alias("test"))


#: Documents as files of every kind; the same words in either SQL.
FILE_PATH = "concat(CASE doc_id % 9 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/node_modules/' ELSE 'src/' END, doc_id, CASE doc_id % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.min.js' WHEN 2 THEN '/go.sum' WHEN 3 THEN '.PY' ELSE '.md' END)"
FILE_TEXT = "CASE WHEN doc_id % 11 = 0 THEN concat('// DO NOT EDIT', text) WHEN doc_id % 13 = 0 THEN concat(text, chr(0)) ELSE text END"


@query(
    f"""
WITH f AS (SELECT {FILE_PATH} AS path, {FILE_TEXT} AS t FROM documents)
SELECT CASE WHEN regexp_matches(path, '^vendor/|/node_modules/') THEN 'ignored_dir' WHEN ends_with(path, '/go.sum') THEN 'lockfile' WHEN ends_with(path, '.min.js') THEN 'generated' WHEN ends_with(path, '.rs') THEN 'unsupported'
  WHEN octet_length(encode(t)) > 4096 THEN 'too_large' WHEN contains(substr(t, 1, 8192), chr(0)) THEN 'binary' WHEN regexp_matches(array_to_string(string_split(t, chr(10))[1:5], chr(10)), 'Code generated|DO NOT EDIT|@generated') THEN 'generated' ELSE 'kept' END AS reason, count(*) AS n
FROM f GROUP BY 1
"""
)
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files, of which those over 4 KB are left out."""
    d = table(spark, sf_dir, "documents").select(F.expr(FILE_PATH).alias("path"), F.expr(FILE_TEXT).alias("t"))
    reason = text.skip_reason(F.col("path"), F.octet_length("t"), F.substring(F.col("t"), 1, 8192), 4096)
    return d.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN -doc_id ELSE doc_id END AS file, doc_id % 3 AS s, doc_id % 5 + 1 AS e, CASE WHEN doc_id % 2 = 0 THEN 'X.the' END AS symbol FROM labels),
z AS (SELECT b.*, len(a) AS size FROM b LEFT JOIN g ON b.file = g.file AND len(a) > 0)
SELECT id, 'no such file' AS problem FROM z WHERE size IS NULL UNION ALL SELECT id, 'lines outside the file' FROM z WHERE s < 1 OR e < s OR e > size
UNION ALL SELECT id, 'symbol not in the lines' FROM z JOIN g ON z.file = g.file WHERE symbol IS NOT NULL AND s >= 1 AND e >= s AND s <= size AND NOT contains(array_to_string(a[s : e], chr(10)), 'the')"""
)
def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a few lines of their documents: some name no document, some lie outside it, some lack their symbol."""
    k = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select(k.alias("id"), F.when(k % 17 == 0, -k).otherwise(k).alias("file"), (k % 3).cast("int").alias("start"), (k % 5 + 1).cast("int").alias("end"), F.when(k % 2 == 0, "X.the").alias("symbol"))
    found = tables.label_problems(labels, chunks.lines(_files(spark, sf_dir)).select("file", "n", "line"))
    return found.select("id", F.substring_index("problem", ":", 1).alias("problem"))


@query(
    """
WITH r AS (SELECT DISTINCT source AS repo_id, right(source, 1) IN ('1', '3', '5') AS waits FROM documents)
SELECT item_id AS qid, CASE WHEN repo_id IS NULL THEN 'not_found' WHEN waits THEN 'not_ready' END AS problem, CASE WHEN repo_id IS NULL THEN 404 WHEN waits THEN 409 END AS status, CASE WHEN repo_id IS NULL THEN 'not_found' WHEN waits THEN 'repo_not_ready' END AS code
FROM benchmark LEFT JOIN r ON repo_id = 'src' || (item_id % 25)
"""
)
def question_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions go to a repository that is absent or not ready, and how that is reported."""
    repositories = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.when(F.col("source").rlike("[135]$"), "indexing").otherwise("ready").alias("status"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 25).alias("repo_id"))
    judged = ask.readiness(asked, repositories).withColumn("said", ask.classified(F.col("problem")))
    return judged.select("qid", "problem", "said.status", "said.code")


@query(
    """
WITH i AS (SELECT s_suppkey, lower('O/' || s_name) AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE 'ready' END AS status, substr(md5(s_name), 1, CASE WHEN s_suppkey % 5 = 0 THEN 9 ELSE 12 END) AS now FROM supplier WHERE s_suppkey % 3 <> 0),
p AS (SELECT 'o/' || s_name AS name, substr(md5(s_name), 1, 12) AS c FROM supplier), m AS (SELECT * FROM p LEFT JOIN i ON key = lower(name))
SELECT name, 'not indexed' AS problem FROM m WHERE key IS NULL UNION ALL SELECT name, 'not ready: ' || status FROM m WHERE status <> 'ready' UNION ALL SELECT name, 'indexed at ' || substr(now, 1, 7) || ', pinned at ' || substr(c, 1, 7) FROM m WHERE now <> c
"""
)
def pinned_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for repositories: a third is not indexed, some failed, some are indexed at another commit."""
    s = table(spark, sf_dir, "supplier").withColumn("commit", F.substring(F.md5("s_name"), 1, 12))
    at = F.when(F.col("s_suppkey") % 5 == 0, F.substring("commit", 1, 9)).otherwise(F.col("commit"))
    indexed = s.filter("s_suppkey % 3 <> 0").select(F.lit("O").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 0, "failed").otherwise("ready").alias("status"), at.alias("commit"))
    return tables.pin_problems(s.select(F.concat(F.lit("o/"), "s_name").alias("name"), "commit"), indexed)


@query("SELECT c_custkey AS repo_id, o_orderkey AS job_id, o_orderstatus AS job_status FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def repository_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories, orders as their jobs."""
    jobs_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("repo_id"), F.col("o_orderstatus").alias("status"))
    return tables.listed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id")), jobs_)


# Caches and the registry --------------------------------------------------------------------------------------------


@query(
    """
WITH d AS (SELECT doc_id, source, sha256(substr(text, 1, 8000)) AS h, length(text) > 8000 AS cut, greatest(1, ceil(length(text) / 2.0))::BIGINT AS tokens FROM documents)
SELECT source, count(*) AS texts, count(DISTINCT h) AS "distinct", count(*) FILTER (cut) AS cut, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source
"""
)
def embedding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.countDistinct(F.sha2(text.embed_cut(F.col("text")), 256)).alias("distinct"),
        F.count_if(F.length("text") > text.MAX_EMBED_CHARS).alias("cut"),
        F.sum(text.token_estimate(F.col("text"))).cast("long").alias("tokens"),
    )


@query(
    """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT h, min(doc_id) AS keeper FROM d WHERE doc_id % 3 = 0 GROUP BY h)
SELECT count(*) FILTER (keeper IS NOT NULL) AS found, count(DISTINCT d.h) FILTER (keeper IS NULL) AS missing, ceil(count(DISTINCT d.h) FILTER (keeper IS NULL) / 64.0)::BIGINT AS requests FROM d LEFT JOIN c ON d.h = c.h
"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every third document are cached."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = d.filter("doc_id % 3 = 0").groupBy("h").agg(F.min("doc_id").alias("keeper"))
    found, missing = tables.cached(d, cache, ["h"])
    a, b = found.agg(F.count("*").alias("found")), missing.agg(F.count("*").alias("missing"), F.ceil(F.count("*") / 64).cast("long").alias("requests"))
    return b.select(a.scalar().alias("found"), "missing", "requests")


@query("SELECT d.doc_id, k.keeper FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS keeper FROM documents GROUP BY 1) k ON sha256(d.text) = k.h")
def vector_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one whose vector it shares: the first of equal text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("keeper")), "h").select("doc_id", "keeper")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_write(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true")
def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return tables.latest(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey")


@query(
    """
WITH a AS (SELECT lower(s_name) AS n, min(s_name) AS name FROM supplier GROUP BY 1), k AS (SELECT lower(s_name) AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'failed' ELSE 'ready' END AS status FROM supplier WHERE s_suppkey % 3 = 0)
SELECT name, CASE WHEN status IS NULL OR status = 'failed' THEN 'queued' ELSE status END AS status, status IS NULL OR status = 'failed' AS queued FROM a LEFT JOIN k USING (n)
"""
)
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    known = s.filter("s_suppkey % 3 = 0").select(F.lit("o").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "failed").otherwise("ready").alias("status"))
    return tables.create_or_get(known, s.select(F.lit("O").alias("owner"), F.col("s_name").alias("name"))).select("name", "status", "queued")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of parents with some child after those with another are taken away."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    gone = orders.join(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    left = table(spark, sf_dir, "customer").select("c_custkey").join(orders.filter("o_orderstatus = 'O'"), "c_custkey", "left_semi")
    return left.join(gone, "c_custkey", "left_anti").distinct()


# Jobs and rates -----------------------------------------------------------------------------------------------------

KINDS = {"signup": "queued", "view": "claimed", "click": "progress", "error": "failed", "purchase": "succeeded"}
STATES_SQL = """
WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'progress' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS kind FROM events),
s AS (SELECT user_id AS key, arg_max(CASE kind WHEN 'claimed' THEN 'running' WHEN 'progress' THEN 'running' ELSE kind END, (ts, event_id)) AS status, count(*) FILTER (kind = 'claimed') AS attempts,
  arg_max(value, (ts, event_id)) FILTER (kind = 'progress') AS progress, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY user_id)
"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events").withColumn("kind", kind)
    return jobs.job_states(e, "user_id", "ts", "event_id", "kind", "value").withColumnRenamed("user_id", "key")


@query(STATES_SQL + " SELECT key, status, attempts::BIGINT AS attempts, progress FROM s")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("key", "status", F.col("attempts").cast("long").alias("attempts"), "progress")


@query(STATES_SQL + " SELECT CAST(row_number() OVER (ORDER BY first_ts, key) AS INTEGER) AS turn, key FROM s WHERE status = 'queued'")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim_order(_jobs(spark, sf_dir)).select("turn", "key")


@query(
    STATES_SQL
    + """, t AS (SELECT key FROM s WHERE status = 'queued' ORDER BY first_ts, key LIMIT 5)
SELECT s.key, CASE WHEN t.key IS NOT NULL THEN 'running' ELSE status END AS status, (attempts + CASE WHEN t.key IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS attempts, CASE WHEN t.key IS NULL THEN progress END AS progress FROM s LEFT JOIN t ON s.key = t.key"""
)
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs after five workers have claimed one each."""
    return jobs.claim(_jobs(spark, sf_dir), 5).select("key", "status", F.col("attempts").cast("long").alias("attempts"), "progress")


@query("SELECT user_id AS key, arg_max(substr(repeat(props, 100), 1, 500), (ts, event_id)) FILTER (event_type = 'error') AS message FROM events GROUP BY user_id")
def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last failure of each job, its message cut."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events").withColumns({"kind": kind, "said": F.repeat("props", F.lit(100))})
    return jobs.job_states(e, "user_id", "ts", "event_id", "kind", "value", "said").select(F.col("user_id").alias("key"), "message")


@query(STATES_SQL + " SELECT key, key AS repo_id, c_mktsegment AS owner, c_name AS name, attempts::BIGINT AS attempts FROM s JOIN customer ON c_custkey = key WHERE status = 'running'")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs with the repository of each; customers stand for repositories."""
    repositories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"))
    return jobs.claimed(_jobs(spark, sf_dir).withColumn("repo_id", F.col("key")), repositories).withColumn("attempts", F.col("attempts").cast("long"))


@query(
    STATES_SQL
    + """, n AS (SELECT max(ts) AS now FROM events)
SELECT key, CASE WHEN status = 'running' AND last_ts < now - INTERVAL 600 SECONDS THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, status = 'running' AND last_ts < now - INTERVAL 600 SECONDS AS stale FROM s, n"""
)
def job_requeue_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return jobs.requeue_stale(_jobs(spark, sf_dir), now).select("key", "status", "stale")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.in_trailing(table(spark, sf_dir, "events"), "event_type", "ts").select("event_id", "in_window")


@query()
def rate_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests a minute for each user."""
    return jobs.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.counts_stream(table(spark, sf_dir, "events"), "ts", "event_type")


# Prompts and answers ------------------------------------------------------------------------------------------------


@query(
    """
WITH c AS (SELECT conv_id, turn, row_number() OVER w AS n, sum(octet_length(encode(text))) OVER w AS running FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_blocks, max(turn) AS last_turn FROM c WHERE n = 1 OR running <= 600 GROUP BY conv_id
"""
)
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that fit into 600 bytes."""
    c = table(spark, sf_dir, "conversations").withColumn("size", F.octet_length("text"))
    kept = prompts.within_budget(c, "size", 600, "conv_id", "turn")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.max("turn").alias("last_turn"))


@query(
    """
WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, text || CASE WHEN turn >= 1 THEN ' [1] see x[2] [' || turn || '] `[3]`.' ELSE ' see x[2] `[3]`.' END AS checked, CASE WHEN turn >= 1 THEN 2 ELSE 4 END AS invalid,
  CASE WHEN turn >= 1 THEN list_distinct_in_order ELSE '' END AS numbers, starts_with(lower(trim(text)), 'not enough evidence in the retrieved code.') AS refused
FROM (SELECT *, CASE WHEN turn = 1 THEN '1' ELSE '1,' || turn END AS list_distinct_in_order FROM c)
"""
)
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, each with markers added, checked against as many blocks as there are turns before: good and bad markers, an index, and one in code."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    marked = F.concat("text", F.lit(" [1][9] see x[2] ["), "turn", F.lit("] [70-2] `[3]`."))
    out = prompts.cite(c.select("conv_id", "turn", marked.alias("answer"), F.col("turn").cast("int").alias("n_blocks")))
    return out.select("conv_id", "turn", F.col("text").alias("checked"), "invalid", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "refused")


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct([3, turn]), lambda x: x NOT IN (1, 2, 5))), ',') AS uncited, array_to_string(list_filter([1, 2, 5], lambda x: x NOT IN (3, turn)), ',') AS unused FROM conversations")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers [3] and [turn] of each text against the citations 1, 2 and 5; an index x[8] is no marker."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("qid"), F.concat("text", F.lit(" [3]["), "turn", F.lit("] x[8]")).alias("answer"), F.array(F.lit(2), F.lit(1), F.lit(5)).alias("numbers"))
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return prompts.marker_problems(c).select("qid.conv_id", "qid.turn", joined("uncited"), joined("unused"))


@query(
    """
WITH RECURSIVE d AS (SELECT source, doc_id, greatest(1, ceil(length(text) / 2.0))::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
b AS (SELECT source, doc_id, r, cost AS used, 1::BIGINT AS n, 0::BIGINT AS batch FROM d WHERE r = 1
  UNION ALL SELECT d.source, d.doc_id, d.r, CASE WHEN b.n >= 8 OR b.used + d.cost > 4000 THEN d.cost ELSE b.used + d.cost END, CASE WHEN b.n >= 8 OR b.used + d.cost > 4000 THEN 1 ELSE b.n + 1 END,
    CASE WHEN b.n >= 8 OR b.used + d.cost > 4000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1)
SELECT source, doc_id, batch FROM b
"""
)
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source in requests of at most 8 texts and 4,000 tokens."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", text.token_estimate(F.col("text")).cast("long").alias("cost"))
    return prompts.request_batches(d, "source", "doc_id", "cost", 8, 4000).select("source", "doc_id", "batch")


@query("SELECT count(*) AS texts, count(DISTINCT sha256(text)) AS \"distinct\", ceil(count(DISTINCT sha256(text)) / 64.0)::BIGINT AS requests, ceil(count(DISTINCT sha256(text)) / 64.0) + 5 <= 100 AS affordable FROM documents")
def budget_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all texts can be embedded with 100 requests left, of which 5 are kept."""
    out = prompts.preflight(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash")), 100, reserve=5)
    return out.withColumn("requests", F.col("requests").cast("long"))


@query("SELECT doc_id, greatest(3, 1 + coalesce(list_aggregate(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x)), 'max'), 0))::BIGINT AS fence, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def block_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.fence(F.col("text"))).cast("long").alias("fence"), text.shortened(F.col("text"), 80).alias("short"))
