"""Quality rules as a short-circuit cascade of native expressions, ordered by measured rejection per cost.

Defined results
- A null or empty text has no words and is rejected (``few_words``). Repeated rows are judged one by one. Very long
  texts are judged whole. An empty table gives an empty result; the cascade then keeps the order in which its rules are
  given. Columns other than the text pass through; one with the name of an output column (whatever the case) is an error.
- The order of the rules changes what a rejected row costs, never whether it is rejected.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import WORD, let, refuse, saved, unused, words_of

#: Rows of the sample that orders the cascade, and characters of the longest text in it; it decides no row's fate.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000
#: Words in a window of repeat_words.
WINDOW = 5


@dataclass(frozen=True)
class QualityRule:
    """rejects: of a text column (never null) and its words, true for a row to reject."""

    name: str
    rejects: Callable[[Column, Column], Column]


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text, each counted once.

    Hashes find the texts in which a window may repeat; only there are the windows themselves sorted and compared.
    """

    def starts(n: Column) -> Column:
        return F.sequence(F.lit(0), n - WINDOW)

    def window_hashes(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts(F.size(h)), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))

    def exact(w: Column) -> Column:
        windows = F.sort_array(F.transform(starts(F.size(w)), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("at"))))

        def repeated(all_: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(all_, j)["g"] == x["g"], F.lit(False))
            return F.sort_array(F.transform(F.filter(all_, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["at"]))

        def covered(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

        return let(windows, lambda x: let(repeated(x), covered))

    may_repeat = let(window_hashes(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).when(~may_repeat, F.lit(0)).otherwise(exact(words))


#: The rules every text must meet.
BASE_RULES = [
    QualityRule("few_words", lambda t, w: F.size(w) < 10),
    QualityRule("repeats", lambda t, w: 100 * repeat_words(w) > 20 * F.size(w)),
]
#: The method's own rules, all in whole numbers: marks of markup debris, shouting, and pages of copied lines.
METHOD_RULES = [
    QualityRule("symbols", lambda t, w: 2 * symbols(t) > F.size(w)),
    QualityRule("exclamations", lambda t, w: 2 * F.regexp_count(t, F.lit("!")) > F.size(w)),
    QualityRule("capitals", lambda t, w: 2 * F.regexp_count(t, F.lit("[A-Z]")) > F.length(t)),
    QualityRule("copied_lines", lambda t, w: let(lines_with_words(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    QualityRule("long_words", lambda t, w: F.length(F.array_join(w, "")) > 40 * F.size(w)),
]


def cascade_order(costs: list[float], rejected: list[tuple[bool, ...]]) -> list[int]:
    """The order of rules that rejects most for its cost: again and again the rule with the most rejections per cost among the sampled rows
    that the chosen ones let through; those that reject nothing more come last, the cheapest first.

    costs: of each rule; rejected: for each sampled row, which rules reject it.
    """
    left, rows, order = list(range(len(costs))), list(rejected), []
    while left:
        best = min(left, key=lambda k: (-sum(r[k] for r in rows) / max(costs[k], 1e-9), costs[k], k))
        order.append(best)
        left.remove(best)
        rows = [r for r in rows if not r[best]]
    return order


def plan_cascade(df: DataFrame, rules: list[QualityRule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[QualityRule]:
    """rules in the order of cascade_order, with costs and rejections measured on a sample: the sample_rows texts of up to SAMPLE_CHARS
    characters whose hashes are lowest. A rule's cost is the shorter of two passes over the sample, less that of a pass without a rule."""
    t = F.coalesce(F.col(text), F.lit(""))
    small = df.select(t.alias("t"), F.xxhash64(t).alias("h")).filter(F.length("t") <= SAMPLE_CHARS)
    sample = saved(small.orderBy("h").limit(sample_rows).select("t"), "quality-sample").withColumn("w", words_of(F.col("t"))).persist()
    try:
        verdicts = [F.coalesce(rule.rejects(F.col("t"), F.col("w")), F.lit(False)) for rule in rules]
        rejected = [tuple(r) for r in sample.select(*[v.alias(f"r{k}") for k, v in enumerate(verdicts)]).collect()]
        if not rejected:
            return list(rules)
        took = []
        for verdict in (F.lit(False), *verdicts):
            probe, times = sample.agg(F.count_if(verdict).alias("n")), []
            for _ in range(2):
                began = time.perf_counter()
                probe.first()
                times.append(time.perf_counter() - began)
            took.append(min(times))
        return [rules[k] for k in cascade_order([x - took[0] for x in took[1:]], rejected)]
    finally:
        sample.unpersist()


def passes(text: Column, words: Column, rules: list[QualityRule]) -> Column:
    """True if no rule rejects; a row that one rule rejects is not shown to the later ones."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects(text, words), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def quality_stats(df: DataFrame, text: str = "text", rules: list[QualityRule] | None = None) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    refuse(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    ordered = plan_cascade(df, METHOD_RULES if rules is None else rules, text)
    t, w = unused("_t", df.columns), unused("_w", df.columns)
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words_of(F.col(t)))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": symbols(F.col(t)).cast("long"),
        "n_dup_lines": duplicate_lines(F.col(t)).cast("long"),
        "n_repeat_words": repeat_words(F.col(w)).cast("long"),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(F.col(t), F.col(w), ordered))).drop(t, w)


def keep_quality(df: DataFrame, text: str = "text", rules: list[QualityRule] | None = None) -> DataFrame:
    """The rows of df that no rule rejects. Costly statistics are computed only for rows that the cheaper rules let through."""
    ordered = plan_cascade(df, [*BASE_RULES, *METHOD_RULES] if rules is None else rules, text)
    seen = unused("_seen", df.columns)
    t = F.coalesce(F.col(text), F.lit(""))
    # The generator keeps the filter from being pushed below it, where each rule would split the text again.
    judged = df.withColumn(seen, F.explode(F.array(let(words_of(t), lambda w: passes(t, w, ordered)))))
    return judged.filter(F.col(seen)).drop(seen)
