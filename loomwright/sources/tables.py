"""Tables of the corpus: caches keyed by content, the registry of repositories, versioned chunk tables, evaluation sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVAL_SET = "version int, labels_frozen boolean, repositories array<struct<name:string,commit:string>>, questions array<struct<id:string,repo:string,kind:string,split:string,question:string,relevant:array<struct<file:string,start_line:int,end_line:int,grade:int,symbol:string>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one for a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it twice reads the same rows, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found, missing): wanted with what the cache has, and the distinct keys that it lacks."""
    return wanted.join(cache, keys), wanted.select(*keys).distinct().join(cache, keys, "left_anti")


def first_write(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: keys that the cache lacks, one row each."""
    return new.dropDuplicates(keys).join(cache, keys, "left_anti")


def last_write(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by order, such as descending time and id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter("place = 1").drop("place")


def create_or_get(known: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (owner, name) once each, whatever the case, with status and queued: true for new repositories and for failed ones, which are queued again."""
    keyed = asked.select(F.lower("owner").alias("o"), F.lower("name").alias("n"), "owner", "name").groupBy("o", "n").agg(F.min("owner").alias("owner"), F.min("name").alias("name"))
    have = known.select(F.lower("owner").alias("o"), F.lower("name").alias("n"), "status")
    met = keyed.join(have, ["o", "n"], "left")
    queued = F.col("status").isNull() | (F.col("status") == "failed")
    return met.select("owner", "name", F.when(queued, "queued").otherwise(F.col("status")).alias("status"), queued.alias("queued"))


def latest(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """left with the first row of right by order for its key; nulls without one."""
    return left.join(last_write(right, [key], *order), key, "left")


def listed(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """repositories (repo_id, ...), the newest id first, each with the status of its latest job (job_id, repo_id, status)."""
    last = last_write(jobs, ["repo_id"], F.desc("job_id")).select("repo_id", "job_id", F.col("status").alias("job_status"))
    return repositories.join(last, "repo_id", "left").orderBy(F.desc("repo_id"))


def pin_problems(pins: DataFrame, indexed: DataFrame) -> DataFrame:
    """(name, problem) of pins (name: owner/name, commit) against indexed repositories (owner, name, status, commit), whatever the case."""
    have = indexed.select(F.lower(F.concat_ws("/", "owner", "name")).alias("key"), "status", F.col("commit").alias("at"))
    met = pins.select("name", "commit", F.lower("name").alias("key")).join(have, "key", "left")
    other = ~F.col("at").eqNullSafe(F.col("commit"))
    short = lambda c: F.coalesce(F.substring(c, 1, 7), F.lit("nothing"))
    said = F.array(
        F.when(F.col("status").isNull(), "not indexed"),
        F.when(F.col("status") != "ready", F.concat(F.lit("not ready: "), "status")),
        F.when(F.col("status").isNotNull() & other, F.concat(F.lit("indexed at "), short("at"), F.lit(", pinned at "), short("commit"))),
    )
    return met.select("name", F.explode(F.array_compact(said)).alias("problem"))


def label_problems(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, problem) of labels (id, file, start, end, symbol) against lines (file, n, line): the file is there, the lines are in it, and one of them has the symbol."""
    sizes = lines.groupBy("file").agg(F.max("n").alias("size"))
    near = labels.join(sizes, "file", "left")
    spot = F.concat_ws(":", "file", "start", "end")
    absent = near.filter("size IS NULL").select("id", F.concat(F.lit("no such file: "), spot).alias("problem"))
    outside = near.filter((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("size"))).select("id", F.concat(F.lit("lines outside the file: "), spot).alias("problem"))
    named = labels.filter("symbol IS NOT NULL").withColumn("n", F.explode(F.when((F.col("start") >= 1) & (F.col("end") >= F.col("start")), F.sequence("start", "end"))))
    seen = named.join(lines, ["file", "n"]).groupBy("id", "file", "start", "end", "symbol").agg(F.max(F.contains("line", F.substring_index("symbol", ".", -1))).alias("seen"))
    unseen = seen.filter("NOT seen").select("id", F.concat(F.lit("symbol not in the lines: "), spot).alias("problem"))
    return absent.unionByName(outside).unionByName(unseen)


class VersionedTable:
    """A table whose new version becomes visible at once: the data first, then one row that points to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def replace(self, rows: DataFrame, version: int) -> None:
        if self.current() is not None and version <= self.current()["version"]:
            raise ValueError("a new version must be higher than the current one")
        place = f"{self.path}/data/v{version}-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        self.spark.createDataFrame([(version, place)], "version long, place string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def current(self):
        try:
            versions = self.spark.read.schema("version long, place string").parquet(f"{self.path}/versions")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
        return versions.orderBy(F.desc("version")).first()

    def read(self) -> DataFrame:
        at = self.current()
        if at is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.parquet(at["place"])


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of a JSON evaluation set."""
    return spark.read.schema(EVAL_SET).json(path, multiLine=True).select("version", "labels_frozen", F.inline("questions"))


def eval_problems(questions: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with questions (id, kind, split, question, relevant)."""
    twice = questions.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    labels = F.size(F.coalesce("relevant", F.array().cast(questions.schema["relevant"].dataType)))
    checks = {
        "empty question": F.trim(F.coalesce("question", F.lit(""))) == "",
        "unknown split": ~F.coalesce(F.col("split"), F.lit("")).isin("dev", "test"),
        "unanswerable with labels": (F.col("kind") == "unanswerable") & (labels > 0),
        "answerable without labels": (F.col("kind") != "unanswerable") & (labels == 0),
        "label with a wrong range": F.exists("relevant", lambda r: (r["start_line"] < 1) | (r["end_line"] < r["start_line"])),
        "label with a wrong grade": F.exists("relevant", lambda r: ~r["grade"].isin(1, 2)),
    }
    said = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda p: p.isNotNull())
    return questions.select("id", F.explode(said).alias("problem")).unionByName(twice)
