"""Runs of an evaluation as JSON, and their report as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import metrics

#: Columns of a stored run, by question, besides the groups' columns.
RUN = "qid string, first int, " + ", ".join(f"recall_{k} double" for k in metrics.RECALL_AT) + ", reciprocal double, coverage double"
MEASURES = {**{f"recall_{k}": f"R@{k}" for k in metrics.RECALL_AT}, "reciprocal": f"MRR@{metrics.MRR_AT}", "coverage": f"cov@{metrics.COVERAGE_AT}"}


def write_run(scored: DataFrame, path: str) -> None:
    """Stores a run (qid, first, the measures and the groups' columns): one JSON object for each question."""
    scored.withColumn("qid", F.col("qid").cast("string")).write.mode("errorifexists").json(path)


def read_run(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """A stored run, with the columns of the groups as strings."""
    return spark.read.schema(", ".join([RUN, *(f"`{g}` string" for g in groups)])).json(path)


def report(run: DataFrame, groups: list[str], base: DataFrame | None = None) -> str:
    """Markdown: the means of a run over all questions and by each value of each group; with a base, the differences over the questions that both
    scored, and how many first hits moved. Only these few means come to the driver, one row for each value of a group."""
    names = list(MEASURES)

    def table(rows: DataFrame, number: str) -> list[str]:
        lines = ["| group | n | " + " | ".join(MEASURES[m] for m in names) + " |", "|" + "---|" * (len(names) + 2)]
        order = F.col("dimension") != "all", F.col("dimension"), F.col("value")
        for r in rows.orderBy(*order).toLocalIterator():
            of = r.dimension if r.dimension == "all" else f"{r.dimension} {r.value}"
            lines.append(f"| {of} | {r.n} | " + " | ".join("0" if number == "+.3f" and not r[m] else format(r[m], number) for m in names) + " |")
        return lines

    out = ["## Means", "", *table(metrics.summary(run, groups), ".3f")]
    if base is not None:
        moved = {r["change"]: r["n"] for r in metrics.compared(run, base).groupBy("change").agg(F.count("*").alias("n")).collect()}
        out += ["", "## Against the base", "", *table(metrics.paired(run, base, groups), "+.3f"), ""]
        out.append("First hits: " + ", ".join(f"{moved.get(x, 0)} {x}" for x in ("better", "worse", "unchanged")) + ".")
    return "\n".join(out) + "\n"
