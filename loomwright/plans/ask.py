"""The whole way of a batch of questions: terms, two ranked lists, fusion, reordering, prompts, answers and their citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.answers import bytes_cut, question_terms, ranking, rerank_key
from loomwright.functions.text import is_test_path
from loomwright.operators import fusion, keyword_search, prompts, vector_search

#: Texts in, texts or vectors out: a model, or a stand-in for one.
TextModel = Callable[[list[str]], list[str]]
VectorModel = Callable[[list[str]], list[list[float]]]
MODES = ("vector", "keyword", "hybrid", "hybrid_rerank")
#: Blocks of a prompt, at most; bytes of a chunk that a reranker sees.
MOST_TOP, RERANK_BYTES = 50, 2_000


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid_rerank"
    pool: int = fusion.POOL
    depth: int = 20
    top: int = 8
    budget: int = prompts.BUDGET
    languages: tuple[str, ...] = ()
    path_prefix: str = ""
    embed_model: str = ""  # of the questions' vectors; chunks with a column embed_model must all have it

    def __post_init__(self):
        object.__setattr__(self, "top", min(max(self.top, 1), MOST_TOP))
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        vector_search.check_k(self.pool)
        check_filter(list(self.languages), self.path_prefix)


def check_filter(languages: list[str], path_prefix: str) -> None:
    """Raises a ValueError that says what is wrong with a filter."""
    known = {"python", "go", "typescript", "javascript", "markdown"}
    if len(languages) > 10:
        raise ValueError("at most 10 languages")
    if unknown := [x for x in languages if x not in known]:
        raise ValueError(f"unknown language {unknown[0][:40]}")
    if len(path_prefix.encode()) > 200:
        raise ValueError("path prefix is longer than 200 bytes")
    if path_prefix.startswith("/") or "\\" in path_prefix or any(ord(c) < 32 or ord(c) == 127 for c in path_prefix) or ".." in path_prefix.split("/"):
        raise ValueError("path prefix must be relative, without backslashes, control characters or ..")


def check_questions(questions: DataFrame) -> DataFrame:
    """questions trimmed; raises on an empty one or one of over 1,000 characters."""
    out = questions.withColumn("question", F.trim(F.coalesce("question", F.lit(""))))
    if bad := out.filter((F.col("question") == "") | (F.length("question") > 1000)).select("qid").limit(1).collect():
        raise ValueError(f"question {bad[0]['qid']} is empty or longer than 1,000 characters")
    return out


def readiness(questions: DataFrame, repositories: DataFrame) -> DataFrame:
    """questions with problem: not_found without a row in repositories (repo_id, status), not_ready unless its status is ready, else null."""
    known = repositories.groupBy("repo_id").agg(F.max(F.col("status") == "ready").alias("ready"))
    problem = F.when(F.col("ready").isNull(), "not_found").when(~F.col("ready"), "not_ready")
    return questions.join(known, "repo_id", "left").withColumn("problem", problem).drop("ready")


#: How a failure is reported, by its kind: status and code.
FAILURES = {"question_invalid": (400, "invalid_request"), "filter_invalid": (400, "invalid_request"), "not_found": (404, "not_found"), "not_ready": (409, "repo_not_ready"), "model_mismatch": (422, "model_mismatch"), "blocked": (422, "answer_blocked"), "rate_limited": (429, "rate_limited"), "cancelled": (499, "cancelled"), "upstream": (502, "upstream_error"), "timeout": (504, "timeout")}


def classified(failure: Column) -> Column:
    """struct(status, code) of a kind of failure; anything unknown is internal, and none is null."""
    known = F.create_map(*[x for kind, (status, code) in FAILURES.items() for x in (F.lit(kind), F.struct(F.lit(status).alias("status"), F.lit(code).alias("code")))])
    return F.when(failure.isNotNull(), F.coalesce(F.try_element_at(known, failure), F.struct(F.lit(500).alias("status"), F.lit("internal").alias("code"))))


def pending(questions: DataFrame, store: str) -> DataFrame:
    """The questions that have no answer yet in the Parquet folder store; all of them before it exists."""
    answered = _parquet(questions.sparkSession, store, questions.select("qid").schema)
    return questions if answered is None else questions.join(answered, "qid", "left_anti")


def resume(questions: DataFrame, store: str, answer_batch: Callable[[DataFrame], DataFrame], batch: int = 1_000) -> None:
    """Appends the answers of pending questions to store, about batch of them to a commit. A failure stops at its batch: those before it are kept, and a
    later call goes on with what is missing."""
    parts = -(-pending(questions, store).count() // batch)
    for part in range(parts):
        some = questions.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        answer_batch(pending(some, store)).write.mode("append").parquet(store)


def rankings(listed: DataFrame, cache: DataFrame | None, reranker: str, model: TextModel) -> tuple[DataFrame, DataFrame]:
    """(qid, ranking) for lists (qid, question, ids, texts, prompt), and the rows that the cache (cache_key, ranking) should get.

    A key stands for the reranker, the question and the candidates in their order; a model sees only what the cache lacks, each key once, and
    replies without a ranking are neither used nor kept."""
    keyed = listed.withColumn("cache_key", rerank_key(F.lit(reranker), F.col("question"), F.col("ids"), F.col("texts")))
    missing = keyed if cache is None else keyed.join(cache, "cache_key", "left_anti")
    asked = ask_model(missing.dropDuplicates(["cache_key"]).select("cache_key", "prompt", F.size("ids").alias("n")), model)
    new = asked.select("cache_key", ranking("reply", "n").alias("ranking")).filter("ranking IS NOT NULL")
    known = new if cache is None else new.unionByName(cache.select("cache_key", "ranking"))
    return keyed.select("qid", "cache_key").join(known, "cache_key").select("qid", "ranking"), new


def kept_rankings(listed: DataFrame, path: str, reranker: str, model: TextModel) -> DataFrame:
    """rankings() with the Parquet folder path as the cache: what the model says is there before it is used."""
    spark = listed.sparkSession
    held = _parquet(spark, path, "cache_key string, ranking array<int>")
    rankings(listed, held, reranker, model)[1].write.mode("append").parquet(path)
    told = spark.read.schema("cache_key string, ranking array<int>").parquet(path).dropDuplicates(["cache_key"])
    return rankings(listed, told, reranker, lambda asked: ["" for _ in asked])[0]


def _parquet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """The Parquet folder at path; null before it exists."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def embed_stream(texts: DataFrame, cache: str, model: VectorModel, checkpoint: str) -> None:
    """Embeds what a stream of texts has now, a batch at a time: each batch's new vectors are in the Parquet folder cache before the next begins,
    so that a failure loses one batch at most."""

    def one(batch: DataFrame, _: int) -> None:
        known = _parquet(batch.sparkSession, cache, "text_hash string, embedding array<float>")
        wanted = batch.select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
        new = wanted if known is None else wanted.join(known, "text_hash", "left_anti")
        embed_texts(new, None, model).write.mode("append").parquet(cache)

    texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ask_model(rows: DataFrame, model: TextModel, prompt: str = "prompt", out: str = "reply") -> DataFrame:
    """rows with the model's reply to each prompt."""

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{out: model(part[prompt].tolist())})

    return rows.mapInPandas(call, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {out} string")


def embed_texts(texts: DataFrame, cache: DataFrame | None, model: VectorModel, text: str = "text") -> DataFrame:
    """(text_hash, embedding) of all different texts: from the cache (text_hash, embedding) where it has them, else from the model, once each."""
    wanted = texts.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text")).dropDuplicates(["text_hash"])
    missing = wanted if cache is None else wanted.join(cache, "text_hash", "left_anti")

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": model(part["text"].tolist())})

    new = missing.mapInPandas(call, "text_hash string, embedding array<float>")
    return new if cache is None else new.unionByName(cache.join(wanted, "text_hash", "left_semi").select("text_hash", "embedding"))


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, settings: Settings, indexed: keyword_search.Index | None = None) -> DataFrame:
    """(qid, rank, chunk_id) for questions (qid, repo_id, question, embedding), each within its repository, in the mode of the settings
    without reordering. indexed: an index of chunks that was written before."""
    terms = questions.select("qid", "repo_id", question_terms("question").alias("terms"))
    lists = []
    if settings.mode != "keyword":
        held = chunks
        if settings.path_prefix:
            held = held.filter(F.col("file_path").startswith(settings.path_prefix))
        if settings.languages:
            held = held.filter(F.col("language").isin(*settings.languages))
        if settings.embed_model and "embed_model" in chunks.columns:
            vector_search.one_model(chunks.join(questions.select("repo_id"), "repo_id", "left_semi"), settings.embed_model)
        rows = vectors.select("id", "embedding").join(held.select(F.col("chunk_id").alias("id"), "repo_id"), "id")
        lists.append(vector_search.nearest(questions.select("qid", "repo_id", "embedding"), rows, settings.pool, scope="repo_id").select("qid", "rank", F.col("id").alias("chunk_id")))
    if settings.mode != "vector":
        lists.append(keyword_search.search(indexed or keyword_search.index(chunks), terms, settings.pool, list(settings.languages), settings.path_prefix).select("qid", "rank", "chunk_id"))
    if len(lists) == 1:
        return lists[0]
    fused = fusion.fuse(*lists, pool=settings.pool, top=2 * settings.pool)
    # Tests rank lower: their share of the score is cut after the lists are joined with the paths.
    paths = chunks.select("chunk_id", is_test_path(F.col("file_path")).alias("test"))
    marked = fused.join(paths, "chunk_id").withColumn("fused_score", F.col("fused_score") * F.when(F.col("test"), fusion.TEST_PENALTY).otherwise(1.0))
    by = Window.partitionBy("qid").orderBy(F.desc("fused_score"), "chunk_id")
    return marked.withColumn("rank", F.row_number().over(by)).select("qid", "rank", "chunk_id")


def answer(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, model: TextModel, reranker: TextModel | None = None, settings: Settings = Settings(), indexed: keyword_search.Index | None = None, repositories: DataFrame | None = None, cache: str | None = None) -> DataFrame:
    """(qid, answer, numbers, invalid, refused, grounded, problem) for a batch of questions.

    indexed: an index of chunks that was written before. repositories (repo_id, status): questions to one that is missing or not ready get no answer but
    the problem, and no model sees them. cache: a Parquet folder of rankings, which a reranker is asked for once."""
    questions = check_questions(questions)
    refused = None
    if repositories is not None:
        judged = readiness(questions, repositories)
        refused = judged.filter(F.col("problem").isNotNull()).select("qid", "problem")
        questions = judged.filter(F.col("problem").isNull()).drop("problem")
    ranked = retrieve(questions, chunks, vectors, settings, indexed)
    held = chunks.select("chunk_id", F.col("file_path").alias("file"), "start", "end", "symbol", "kind", "language", "content")
    if settings.mode == "hybrid_rerank" and reranker is not None:
        listed = ranked.filter(F.col("rank") <= settings.depth).join(held, "chunk_id").withColumn("content", bytes_cut(F.col("content"), F.lit(RERANK_BYTES))).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "content", "chunk_id"))).alias("all"))
        prompt = F.array_join(F.transform("all", lambda x: F.concat(F.format_string("[%d] ", x["rank"]), x["content"])), "\n").alias("prompt")
        if cache is None:
            replies = ask_model(listed.select("qid", prompt, F.size("all").alias("n")), reranker).select("qid", ranking("reply", "n").alias("ranking")).filter("ranking IS NOT NULL")
        else:
            told = listed.join(questions.select("qid", "question"), "qid").select("qid", "question", F.transform("all", lambda x: x["chunk_id"]).alias("ids"), F.transform("all", lambda x: x["content"]).alias("texts"), prompt)
            replies = kept_rankings(told, cache, getattr(reranker, "name", "reranker"), reranker)
        ranked = fusion.rerank(ranked, replies, settings.depth, settings.top)
    ranked = ranked.filter(F.col("rank") <= settings.top)
    built = prompts.prompts(questions.select("qid", "question"), ranked.join(held, "chunk_id"), settings.budget)
    replied = ask_model(built, model).select("qid", F.col("reply").alias("answer"), "n_blocks")
    out = prompts.cite(replied).select("qid", F.col("text").alias("answer"), "numbers", "invalid", "refused", "grounded", F.lit(None).cast("string").alias("problem"))
    return out if refused is None else out.unionByName(refused, allowMissingColumns=True)
