"""Prompts within a budget of bytes, citations of their blocks, and batches of texts for a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.answers import bytes_cut, validated
from loomwright.functions.text import fence
from loomwright.sources.tables import written

#: Fixed values of the prompt's format: its budget in bytes, the mark of a cut, and what stands before the blocks and the question.
BUDGET = 24_000
CUT_MARK = "\n[content truncated]"
BEFORE_BLOCKS, BEFORE_QUESTION = "Context:\n", "\n\nQuestion: "


#: Texts of a key that one task assigns to batches.
SEGMENT = 100_000


def block(n: Column, content: Column) -> Column:
    """A numbered block of context; its fence is longer than any in the content."""
    head = F.format_string("[%d] %s:%d-%d (%s, %s, %s)", n, "file", "start", "end", F.coalesce("symbol", F.lit("-")), "kind", "language")
    return F.concat_ws("\n", head, fence(content), content, fence(content))


def within_budget(ranked: DataFrame, size: str, budget: int, by: str = "qid", order: str = "rank") -> DataFrame:
    """The rows of each list before the first that would exceed the budget; the first row always stays."""
    running = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    # Sizes are not negative, so that all rows after the first excess exceed as well.
    return ranked.withColumns({"n": place, "running": running}).filter((F.col("n") == 1) | (F.col("running") <= budget)).drop("running")


def prompts(questions: DataFrame, ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, prompt, n_blocks) from questions (qid, question) and ranked chunks (qid, rank, file, start, end, symbol, kind, language, content)."""
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    rows = ranked.withColumn("n", n).withColumn("block", block(F.col("n"), F.col("content")))
    over = (F.col("n") == 1) & (F.octet_length("block") > budget)
    room = F.greatest(F.lit(budget) - (F.octet_length("block") - F.octet_length("content")) - len(CUT_MARK), F.lit(0))
    cut = F.concat(bytes_cut(F.col("content"), room), F.lit(CUT_MARK))
    rows = rows.withColumn("block", F.when(over, block(F.col("n"), cut)).otherwise(F.col("block"))).withColumn("size", F.octet_length("block")).drop("n")
    kept = within_budget(rows, "size", budget)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n")
    blocks = kept.groupBy("qid").agg(text.alias("blocks"), F.count("*").cast("int").alias("n_blocks"))
    whole = F.concat(F.lit(BEFORE_BLOCKS), "blocks", F.lit(BEFORE_QUESTION), "question")
    return questions.join(blocks, "qid").select("qid", whole.alias("prompt"), "n_blocks")


def cite(answers: DataFrame) -> DataFrame:
    """answers (qid, answer, n_blocks) with the checked text, its numbers and verdicts."""
    return answers.withColumn("checked", validated("answer", "n_blocks")).select("*", "checked.*").drop("checked")


def citations(checked: DataFrame, used: DataFrame) -> DataFrame:
    """(qid, place, n, ...) the blocks of used (qid, n, ...) that each answer cites, in order of first appearance."""
    return checked.select("qid", F.posexplode("numbers").alias("place", "n")).join(used, ["qid", "n"])


def marker_problems(answers: DataFrame) -> DataFrame:
    """(qid, uncited, unused) of answers (qid, answer, numbers): numbers that markers name and no citation has, and citations that no marker names.

    Markers may follow each other; one that follows a word, such as an index in code, is none."""
    chains = F.regexp_extract_all("answer", F.lit(r"(?<![A-Za-z0-9_\]])(?:\[[0-9]{1,9}\])+"), F.lit(0))
    named = F.transform(F.regexp_extract_all(F.array_join(chains, ""), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    both = answers.select("qid", F.array_sort(F.array_distinct(named)).alias("named"), F.array_sort(F.array_distinct("numbers")).alias("held"))
    return both.select("qid", F.array_except("named", "held").alias("uncited"), F.array_except("held", "named").alias("unused"))


def request_batches(texts: DataFrame, key: str, order: str, tokens: str, batch: int = 64, budget: int = 8_000) -> DataFrame:
    """texts with batch, from 0 within each key: in order, a text goes into the next batch when its own is full or would exceed the budget of tokens.
    Texts without a key are in batches of their own.

    Where a batch ends depends on all before it, but never on more than `batch` texts after its first. So a key's texts are cut into segments of SEGMENT,
    each of which says for every place at which its first batch may begin where the first batch beyond it begins, and how many lie
    between. Chained along the key, one small row for each segment, that tells where each segment's batches begin, and segments are then numbered by
    themselves: a key of any size fills many tasks, which hold the open batch alone."""
    if batch >= SEGMENT:
        raise ValueError("a batch must be smaller than a segment")
    hashed, tie, rng, idx, seg, entry, number = (name + "_" * sum(c.lower().startswith(name) for c in texts.columns) for name in ("_key", "_tie", "_range", "_idx", "_seg", "_entry", "_number"))
    # Keys are told apart by their text: nulls are equal to each other there.
    text = F.concat_ws(":", F.col(key).isNull().cast("string"), F.col(key).cast("string"))
    keyed = texts.withColumns({hashed: text, tie: F.monotonically_increasing_id()})
    ranged = written(keyed.repartitionByRange(hashed, order, tie).withColumn(rng, F.spark_partition_id()), "batches")
    held = ranged.groupBy(hashed, rng).agg(F.count("*").alias("n"))
    before = held.select(hashed, rng, F.coalesce(F.sum("n").over(Window.partitionBy(hashed).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(hashed, rng).orderBy(order, tie)) - 1
    rows = ranged.withColumn(idx, inside).join(before, [hashed, rng]).withColumn(idx, F.col(idx) + F.col("before")).drop("before", rng, tie).withColumn(seg, F.floor(F.col(idx) / SEGMENT))
    ahead = F.when((F.col(idx) % SEGMENT < batch) & (F.col(seg) > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    costs = rows.select(F.col(hashed).alias("k"), F.col(seg).alias("s"), F.col(idx).alias("i"), F.col(tokens).alias("cost"), F.explode(ahead).alias("ahead")).withColumn("s", F.col("s") - F.col("ahead"))
    costs = costs.repartition("k", "s").sortWithinPartitions("k", "s", "i").select("k", "s", "cost", (F.col("ahead") == 0).alias("own"))
    maps = costs.mapInPandas(lambda parts: _maps(parts, batch, budget), "k string, s long, exits array<long>, counts array<long>")
    begins = maps.repartition("k").sortWithinPartitions("k", "s").mapInPandas(_begins, "k string, s long, entry long, number long")
    heads = begins.select(F.col("k").alias(hashed), F.col("s").alias(seg), F.lit(-1).cast("long").alias(idx), F.col("entry").alias(entry), F.col("number").alias(number))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition(hashed, seg).sortWithinPartitions(hashed, seg, idx)

    names = [*texts.columns, "batch"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, skip, used, count = 0, 0, 0, 0
        for part in batches:
            out = []
            for place, begin, first, cost in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (idx, entry, number, tokens)), strict=True):
                if place < 0:
                    n, skip, used, count = first - 1, begin, 0, batch
                elif skip:
                    skip -= 1
                else:
                    if count >= batch or used + cost > budget:
                        n, used, count = n + 1, 0, 0
                    used, count = used + cost, count + 1
                out.append(n)
            columns = [part.column(part.schema.get_field_index(c)) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.int64())], names=names).filter(pc.greater_equal(part.column(part.schema.get_field_index(idx)), 0))

    return both.mapInArrow(put, T.StructType([*texts.schema.fields, T.StructField("batch", T.LongType())]))


def _maps(parts: Iterator[pd.DataFrame], batch: int, budget: int) -> Iterator[pd.DataFrame]:
    """A row for each segment: for each place, up to batch, at which its first batch may begin, the place in the next segment at which
    a batch begins first, and the batches that begin before. The rows that are not a segment's own are the next one's first."""
    for k, s, part in _segments(parts):
        n, cost = int(part["own"].sum()), part["cost"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(cost)])
        after = np.searchsorted(sums, sums[:n] + budget, "right") - 1
        after = np.maximum(np.arange(n) + 1, np.minimum(after, np.minimum(np.arange(n) + batch, len(cost)))).tolist()
        exits, counts = [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            j = after[i]
            if j >= n:
                exits[i] = j - n
            else:
                exits[i], counts[i] = exits[j], counts[j] + 1
        # A batch of the segment before may hold all of a short last one.
        most = min(n, batch)
        yield pd.DataFrame({"k": [k], "s": [s], "exits": [exits[:most] + [0] * (batch + 1 - most)], "counts": [counts[:most] + [0] * (batch + 1 - most)]})


def _segments(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, pd.DataFrame]]:
    """Each segment's rows together; a segment is bounded."""
    now, held = None, []
    for part in parts:
        for name, some in part.groupby(["k", "s"], sort=False):
            if name != now and held:
                yield *now, pd.concat(held)
                held = []
            now = name
            held.append(some)
    if held:
        yield *now, pd.concat(held)


def _begins(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the first batch of each segment begins, and its number."""
    key, entry, number = None, 0, 0
    for part in parts:
        out = []
        for k, s, exits, counts in zip(part["k"], part["s"], part["exits"], part["counts"], strict=True):
            if k != key:
                key, entry, number = k, 0, 0
            out.append((k, s, entry, number))
            entry, number = int(exits[entry]), number + int(counts[entry])
        yield pd.DataFrame(out, columns=["k", "s", "entry", "number"])


def preflight(texts: DataFrame, remaining: int, batch: int = 64, reserve: int = 0) -> DataFrame:
    """embedding_requests with affordable: whether they and a reserve fit into the remaining requests; asked before any call."""
    return embedding_requests(texts, batch).withColumn("affordable", F.col("requests") + reserve <= remaining)


def embedding_requests(texts: DataFrame, batch: int = 64) -> DataFrame:
    """(texts, distinct, requests) of a column text_hash: what a model would be asked for."""
    return texts.agg(F.count("*").alias("texts"), F.countDistinct("text_hash").alias("distinct")).withColumn("requests", F.ceil(F.col("distinct") / batch))
