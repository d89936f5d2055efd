"""Rank fusion of two lists, and the reordering of a list by a model's ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the fusion.
K, WEIGHT, TEST_PENALTY, POOL = 60, 0.75, 0.5, 20
DIGITS = 9


def fuse(vector: DataFrame, keyword: DataFrame, is_test: Column | None = None, k: int = K, weight: float = WEIGHT, penalty: float = TEST_PENALTY, pool: int = POOL, top: int = 8) -> DataFrame:
    """(qid, rank, chunk_id, fused_score) of two lists (qid, rank, chunk_id): the sum of 1 / (k + rank), that of the keyword list times weight; times penalty for tests."""
    lists = vector.filter(F.col("rank") <= pool).select("qid", "chunk_id", (1.0 / (k + F.col("rank"))).alias("part"))
    lists = lists.unionByName(keyword.filter(F.col("rank") <= pool).select("qid", "chunk_id", (weight / (k + F.col("rank"))).alias("part")))
    total = lists.groupBy("qid", "chunk_id").agg(F.sum("part").alias("total"))
    score = F.round(F.col("total") * (F.lit(1.0) if is_test is None else F.when(is_test, penalty).otherwise(1.0)), DIGITS)
    by = Window.partitionBy("qid").orderBy(F.desc("fused_score"), "chunk_id")
    return total.withColumn("fused_score", score).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("qid", "rank", "chunk_id", "fused_score")


def rerank(base: DataFrame, rankings: DataFrame, depth: int = 20, top: int = 8) -> DataFrame:
    """base (qid, rank, chunk_id) with the first depth of each list in the order of rankings (qid, ranking: 0-based places); what a ranking leaves out follows in base order, and a missing ranking changes nothing."""
    told = rankings.select("qid", F.posexplode("ranking").alias("said", "place")).groupBy("qid", "place").agg(F.min("said").alias("said"))
    met = base.join(told.withColumn("rank", F.col("place") + 1), ["qid", "rank"], "left")
    first = F.when(F.col("rank") <= depth, F.col("said"))
    by = Window.partitionBy("qid").orderBy(F.col("rank") > depth, first.isNull(), first, "rank")
    return met.select("qid", "chunk_id", F.row_number().over(by).alias("new_rank")).filter(F.col("new_rank") <= top).withColumnRenamed("new_rank", "rank").select("qid", "rank", "chunk_id")


def places(lists: dict[str, DataFrame], of: DataFrame) -> DataFrame:
    """of (qid, chunk_id) with the rank in each named list; null where a list lacks it."""
    for name, ranked in lists.items():
        of = of.join(ranked.select("qid", "chunk_id", F.col("rank").alias(name)), ["qid", "chunk_id"], "left")
    return of
