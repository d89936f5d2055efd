"""The corpus pipeline: quality rules, line deduplication, SimHash deduplication, benchmark decontamination and packing.

Every stage takes all that the one before it kept, as Parquet, and its decisions take effect. All but the last return the
columns of documents; the last returns the pieces of packed sequences.

Defined results
- A document without text, or with an empty or very short one, is rejected by the quality rules. Null ids, languages and sources stay as they are:
  a null source is a source of its own, and a null id comes after all others. Repeated rows are near-duplicates: one of them stays.
- Very long texts go through every stage whole. An empty table gives an empty result. Further columns pass through all stages but the last,
  whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from loomwright.llm.common import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches."""
    kind = docs.schema["n_chars"].dataType
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(kind))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences in the mixture of the sources."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL has neither the tokenizer nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
