"""Source trees as a DataFrame: tasks list folders level by level, without following links, and read the files."""

from __future__ import annotations

import itertools
import os
import stat
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import IGNORED_DIRS, clean_nul, language_of, line_count, skip_reason
from loomwright.sources.tables import shared_dir

MAX_FILES, MAX_KB, HEAD = 5_000, 200, 8_192
ENTRY = "folder string, name string, size long, kind string"


def _entries(root: str, folder: str) -> Iterator[tuple[str, str, int, str]]:
    """(folder, name, size, file | folder | symlink | ignored_dir | unsupported | unreadable) of what is in a folder below root."""
    try:
        found = os.scandir(os.path.join(root, folder))
    except OSError:
        return
    with found:
        for entry in found:
            try:
                at = entry.stat(follow_symlinks=False)
            except OSError:
                yield folder, entry.name, 0, "unreadable"
                continue
            kinds = ((stat.S_ISLNK, "symlink"), (stat.S_ISREG, "file"), (stat.S_ISDIR, "ignored_dir" if entry.name in IGNORED_DIRS else "folder"))
            yield folder, entry.name, at.st_size, next((kind for is_, kind in kinds if is_(at.st_mode)), "unsupported")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(place, path, size, kind) of all below root but plain folders: links are not followed, ignored folders not entered.

    Tasks list a level of folders at a time, which is written before the next one, so that nobody holds the whole list. Places sort as a walk:
    what lies in a folder, ignored folders first, then what lies in its folders."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder in part["folder"]:
                entries = _entries(root, folder)
                while some := list(itertools.islice(entries, 10_000)):
                    yield pd.DataFrame(some, columns=["folder", "name", "size", "kind"])

    base = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    folders, level = spark.createDataFrame([("",)], "folder string"), 0
    while level == 0 or not folders.isEmpty():
        folders.repartition("folder").mapInPandas(read, ENTRY).write.parquet(f"{base}/level={level}")
        folders = spark.read.schema(ENTRY).parquet(f"{base}/level={level}").filter("kind = 'folder'").select(path.alias("folder"))
        level += 1
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    place = F.struct(parts.alias("folder"), (F.col("kind") != "ignored_dir").alias("late"), F.col("name").alias("name"))
    return spark.read.schema(ENTRY).parquet(base).filter("kind <> 'folder'").select(place.alias("place"), path.alias("path"), "size", "kind")


def scan(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_kb: int = MAX_KB) -> DataFrame:
    """(path, language, size, lines, text, skip_reason) of each entry; those to index have no reason. The root must be on storage that all tasks reach."""
    rows = listed(spark, root)
    most = max_kb * 1024

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, kinds = [], []
            for path, size, kind in zip(part["path"], part["size"], part["kind"], strict=True):
                text = None
                if kind == "file" and size <= most:
                    try:
                        text = Path(root, path).read_bytes().decode("utf-8", "replace")
                    except OSError:
                        kind = "unreadable"
                texts.append(text)
                kinds.append(kind)
            yield part.assign(text=texts, kind=kinds)

    order = rows.select("path", "place")
    rows = rows.select("path", "size", "kind").repartition("path").mapInPandas(read, "path string, size long, kind string, text string")
    head = F.substring(F.coalesce("text", F.lit("")), 1, HEAD)
    reason = F.when(F.col("kind") != "file", F.col("kind")).otherwise(skip_reason(F.col("path"), F.col("size"), head, most))
    rows = rows.withColumn("skip_reason", reason)
    # The place of the last file within the cap, from places alone: texts are neither sorted nor numbered.
    within = rows.filter("skip_reason IS NULL").select("path").join(order, "path").select("place").orderBy("place").limit(max_files).agg(F.max("place")).scalar()
    rows = rows.join(order, "path")
    capped = F.when(F.col("skip_reason").isNull() & (F.col("place") > within), "over_file_cap").otherwise(F.col("skip_reason"))
    rows = rows.withColumn("skip_reason", capped)
    kept = F.col("skip_reason").isNull()
    return rows.select("path", language_of(F.col("path")).alias("language"), "size", F.when(kept, line_count(F.col("text"))).alias("lines"), F.when(kept, clean_nul(F.col("text"))).alias("text"), "skip_reason")


def skipped(scanned: DataFrame) -> DataFrame:
    return scanned.filter("skip_reason IS NOT NULL").groupBy("skip_reason").count()


def by_language(scanned: DataFrame) -> DataFrame:
    return scanned.filter("skip_reason IS NULL").groupBy("language").count()
