"""Helpers that the operators share: native text expressions, shared-folder tables and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = "\x20\x09-\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(name: str, taken: list[str]) -> str:
    """name, lengthened until no column of the input has it (column names are compared without case)."""
    lowered = {x.lower() for x in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def refuse(df: DataFrame, *names: str) -> None:
    """Raises if df has a column of one of the names, which an operator is about to add (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"the input already has a column {name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context; a temporary one only for a local
    master without either, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomwright-"))
    return context.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: it survives lost executors and cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark removes its files with the DataFrame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with more rows than one in so many is met by broadcast: there are fewer such keys than this.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, total: int, named: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined on key with named (one row for each key; count: its rows). Keys with so many of the total rows that a task would feel it are
    broadcast, less than HOT_KEYS of them at any size; the rest is shuffled."""
    most = max(1_000, total // HOT_KEYS)
    hot = F.broadcast(named.filter(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(named.filter(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have about limit bytes at most; a longer text is a piece of its own."""
    for batch in batches:
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        if not batch.num_rows:
            yield batch
