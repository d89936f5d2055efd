"""Quality classifier: a sparse ensemble of rules.

Statistics of the text are Spark columns. Trees grown on labelled texts give rules: every path from a root is a
conjunction of comparisons of statistics. A logistic regression with a lasso penalty weighs the rules and drops most. Those that stay are
compiled into one column expression, so that scoring runs without Python.

Defined results
- A null text scores as an empty one. Repeated rows are scored one by one. A document whose labels disagree counts by their mean; null
  labels count for nothing. Without labels every score is 0.5; with labels of one class alone, it is that class's share.
- An empty table gives an empty result. Very long texts are scored whole. Columns of df pass through; one with the name of an output column
  (whatever the case) is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import checkpointed, let, refuse, unused, words_of
from loomwright.llm.quality_rules import lines_with_words, repeat_words, symbols

#: Labelled documents that the trees and weights are learned from, at most: those whose ids hash lowest.
LEARN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7
THRESHOLD = 0.3


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """The statistics that rules compare; text is never null."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = let(lines_with_words(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("copied")))
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.array_join(words, "")) / n,
        "symbols": symbols(text) / n,
        "exclamations": F.regexp_count(text, F.lit("!")) / n,
        "capitals": F.regexp_count(text, F.lit("[A-Z]")) / chars,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "stops": F.regexp_count(text, F.lit("[.,;:?]")) / n,
        "lines": lines["n"] / n,
        "copied_lines": lines["copied"] / F.greatest(lines["n"], F.lit(1)),
        "repeats": repeat_words(words) / n,
        "stutters": F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))) / n,
    }


@dataclass(frozen=True)
class WeightedRule:
    conditions: tuple[tuple[str, str, float], ...]
    weight: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: list[WeightedRule] = field(default_factory=list)

    def score(self) -> Column:
        """Over the columns of statistics, the probability of label 1."""
        margin = F.lit(self.bias)
        for rule in self.rules:
            margin = margin + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def tree_paths(model_text: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """The conditions on the way to every node below a root, in each tree of a printed model, each set once."""
    found: dict[tuple, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in model_text.splitlines():
        indent = len(line) - len(line.lstrip())
        m = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", line.strip())
        if line.strip().startswith("Tree"):
            path = []
        if not m:
            continue
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, (names[int(m[1])], m[2], float(m[3]))))
        found[tuple(sorted({c for _, c in path}))] = None
    return list(found)


def learn(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", learn_rows: int = LEARN_ROWS) -> RuleEnsemble:
    """The ensemble for label, learned from the rows of df that labels names (at most learn_rows)."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    # At most learn_rows pairs of numbers: small enough to broadcast.
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(learn_rows)
    rows = df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(marked), "_id").withColumn("w", words_of(F.col("t")))
    stats = statistics(F.col("t"), F.col("w"))
    names = list(stats)
    table = checkpointed(rows.select("label", *[c.alias(name) for name, c in stats.items()])).coalesce(8)
    counts = table.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not counts["n"]:
        return RuleEnsemble(0.0)
    share = counts["ones"] / counts["n"]
    if share in (0.0, 1.0):
        return RuleEnsemble(30.0 if share else -30.0)
    data = VectorAssembler(inputCols=names, outputCol="x").transform(table).select("label", "x")
    forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(1, int(counts["n"] // 500)), maxBins=64, seed=SEED).fit(data)
    rules = [WeightedRule(path, 0.0) for path in tree_paths(forest.toDebugString, names)]
    if not rules:
        return RuleEnsemble(float(_logit(share)))
    met = table.select("label", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    met = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(met).select("label", "x").persist()
    fitted = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=LASSO, standardization=True, maxIter=60).fit(met)
    met.unpersist()
    weights = fitted.coefficients.toArray()
    return RuleEnsemble(float(fitted.intercept), [WeightedRule(r.conditions, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def score_quality(df: DataFrame, ensemble: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score and predicted."""
    refuse(df, "score", "predicted")
    t, w = unused("_t", df.columns), unused("_w", df.columns)
    kept = {c: unused(f"_in_{c}", df.columns) for c in df.columns}  # statistics may have the names of df's columns
    wide = df.select(*[F.col(c).alias(kept[c]) for c in df.columns], F.coalesce(F.col(text), F.lit("")).alias(t)).withColumn(w, words_of(F.col(t)))
    wide = wide.select(*kept.values(), *[c.alias(name) for name, c in statistics(F.col(t), F.col(w)).items()])
    scored = wide.select(*[F.col(kept[c]).alias(c) for c in df.columns], ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
