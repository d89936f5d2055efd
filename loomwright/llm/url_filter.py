"""URL filters: allow and block rules in a trie over reversed host labels and path segments, longest match first.

Defined results
- A null url, or one without ``://``, has an empty host and path; no rule fits an empty host.
- Repeated rows are judged one by one. An empty table gives an empty result. Very long urls are judged whole. Other columns pass through;
  one with the name of an output column (whatever the case), or of _match, is an error.
- Two equal rules with different verdicts: block wins. Of rules that fit the same url, the longest text (host and path)
  wins; between equally long ones the longer host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_lower, refuse

#: Characters of rule text that a broadcast trie may hold; more rules than that are joined instead.
TRIE_CHARS = 32_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rank(rule: Rule) -> tuple[int, int, bool]:
    return (len(rule.text), len(rule.host), rule.verdict == "block")


def build_trie(rules: list[Rule]) -> dict:
    """Nested dicts. "h": next host label; "p": next whole path segment; "s": rules that end inside a segment, as (start of the segment, rule)."""
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.setdefault("p", {}).setdefault(segment, {})
        node.setdefault("s", []).append((last, rule))
    return root


def longest(trie: dict, host: str, path: str) -> Rule | None:
    """The longest rule on the trie's walks along the host's labels, and from each of them along the path's segments."""
    best: Rule | None = None
    segments, node = path.split("/"), trie
    for label in reversed(host.split(".")):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        at: dict | None = node
        for segment in segments:
            for start, rule in at.get("s", ()):
                if segment.startswith(start) and (best is None or _rank(rule) > _rank(best)):
                    best = rule
            at = at.get("p", {}).get(segment)
            if at is None:
                break
    return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring_index(F.regexp_extract(url, r"(?s)^(.*?)://(.*)$", 2), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    return ascii_lower(F.substring_index(rest, "/", 1)), F.regexp_extract(rest, r"(?s)^[^/]*(/.*)?$", 1)


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """df with host, path, rule (text, or null) and verdict.

    rules: a list, or a DataFrame (verdict, host, path). Up to trie_chars characters of rules travel to the executors as
    a trie; a larger table is joined on the hosts and path starts of each url, which gives the same result.
    """
    refuse(df, "host", "path", "rule", "verdict", "_match")
    host, path = url_parts(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        chars = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 16), F.lit(0)).alias("n")).first()["n"]
        if chars > trie_chars:
            return _joined(df, rules, default)
        rules = [Rule(r["verdict"], r["host"], r["path"]) for r in rules.collect()]
    elif sum(len(r.text) + 16 for r in rules) > trie_chars:
        return _joined(df, df.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [longest(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.text for r in found], "verdict": [r.verdict if r else default for r in found]})

    return df.withColumn("_match", match("host", "path")).withColumns({"rule": F.col("_match.rule"), "verdict": F.col("_match.verdict")}).drop("_match")


def _joined(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Without a trie: each distinct (host, path) meets the rules under its host and parent hosts and under its path's starts of the lengths that rules have."""
    rules = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    lengths = F.broadcast(rules.agg(F.collect_set(F.length("_p")).alias("_lengths")))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = df.select("host", "path").distinct().join(lengths, how="left")
    starts = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = urls.select("host", "path", F.explode(hosts).alias("_h"), starts.alias("_starts")).select("host", "path", "_h", F.explode("_starts").alias("_p"))
    order = F.struct(F.length(F.concat("_h", "_p")), F.length("_h"), F.col("_v") == "block")
    best = keys.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict")), order).alias("_match"))
    joined = df.join(best, ["host", "path"], "left")
    return joined.select(*df.columns, F.col("_match.rule").alias("rule"), F.coalesce("_match.verdict", F.lit(default)).alias("verdict"))
