"""Quality rules, URL rules and the rule ensemble."""

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from loomwright.llm import entry, quality_rules, rule_ensemble, url_filter

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    bad = 2 * symbols > len(w) or 2 * t.count("!") > len(w) or 2 * len(re.findall("[A-Z]", t)) > len(t) or 2 * dup > len(lines) or sum(map(len, w)) > 40 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed, not (failed or bad)


def test_quality_statistics_are_those_of_brute_force(spark):
    got = quality_rules.quality_stats(fixtures.documents(spark)).collect()
    assert len(got) == len(fixtures.rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute_quality(r.text)


def test_cascade_keeps_the_same_rows_in_any_order(spark):
    df = fixtures.documents(spark)
    want = sorted(str(r[:5]) for r in quality_rules.quality_stats(df).filter("kept").select(*df.columns).collect())
    assert sorted(str(tuple(r)) for r in quality_rules.keep_quality(df).collect()) == sorted(str(tuple(r)) for r in quality_rules.quality_stats(df).filter("kept").select(*df.columns).collect())
    for rules in ([*quality_rules.BASE_RULES, *quality_rules.METHOD_RULES], [*reversed([*quality_rules.BASE_RULES, *quality_rules.METHOD_RULES])]):
        text, w = F.coalesce(F.col("text"), F.lit("")), quality_rules.words_of(F.col("text"))
        assert df.filter(quality_rules.passes(text, w, rules)).count() == len(want)


def test_the_cascade_order_weighs_rejections_against_costs():
    # The second rule rejects as much as the first at a tenth of the cost, and leaves the first one row; the third rejects nothing.
    rows = [(True, True, False)] * 8 + [(True, False, False)] + [(False, False, False)] * 3
    assert quality_rules.cascade_order([1.0, 0.1, 0.01], rows) == [1, 0, 2]
    assert quality_rules.cascade_order([0.1, 1.0, 0.01], rows) == [0, 2, 1]
    # What an earlier rule already rejects counts no more: alone, the second rule would come before the third.
    rows = [(True, True, False)] * 5 + [(False, False, True)] * 3
    assert quality_rules.cascade_order([0.1, 0.12, 0.1], rows) == [0, 2, 1]
    assert quality_rules.cascade_order([], []) == [] and quality_rules.cascade_order([2.0, 1.0], []) == [1, 0]


def test_the_sample_is_bounded_and_taken_by_hash(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SAMPLE_CHARS", 100)
    seen = []
    rule = quality_rules.QualityRule("all", lambda t, w: F.length(t) > 50)
    monkeypatch.setattr(quality_rules, "cascade_order", lambda costs, rejected: seen.append(rejected) or list(range(len(costs))))
    df = spark.createDataFrame([("x" * k,) for k in range(200)], "text string")
    quality_rules.plan_cascade(df.orderBy("text"), [rule], sample_rows=40)
    quality_rules.plan_cascade(df.orderBy(F.desc("text")), [rule], sample_rows=40)
    assert len(seen[0]) == 40 and sorted(seen[0]) == sorted(seen[1]) and {r[0] for r in seen[0]} == {True, False}


def test_compiled_rules_score_as_a_walk_through_them(spark):
    """Every rule's conditions checked by hand on the statistics, weights added up, and the logistic function of the sum."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "Bb", "c.", "word", "#", "longerword!"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    labels = df.filter("doc_id < 50").select("doc_id", (F.length("text") % 2).cast("int").alias("quality"))
    ensemble = rule_ensemble.learn(df, labels)
    assert ensemble.rules
    t = F.coalesce(F.col("text"), F.lit(""))
    held = df.withColumns(rule_ensemble.statistics(t, quality_rules.words_of(F.col("text"))))
    holds = {"<=": lambda x, y: x <= y, ">": lambda x, y: x > y}
    want = {}
    for r in held.collect():
        margin = ensemble.bias + sum(rule.weight for rule in ensemble.rules if all(holds[sign](r[name], value) for name, sign, value in rule.conditions))
        want[r.doc_id] = 1 / (1 + math.exp(-margin))
    for r in rule_ensemble.score_quality(df, ensemble).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (want[r.doc_id] >= rule_ensemble.THRESHOLD)


def test_paths_of_a_printed_tree():
    printed = """Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 > 2.0)
      Predict: 0.0
     Else (feature 1 <= 2.0)
      Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    a, b, c = ("x", "<=", 1.5), ("y", ">", 2.0), ("y", "<=", 2.0)
    assert rule_ensemble.tree_paths(printed, ["x", "y"]) == [(a,), tuple(sorted((a, b))), tuple(sorted((a, c))), (("x", ">", 1.5),)]


def test_quality_of_empty_and_clashing_tables(spark):
    assert quality_rules.keep_quality(fixtures.empty(spark)).count() == 0
    clash = fixtures.documents(spark).withColumns({"_t": F.lit(1), "_w": F.lit(2), "_seen": F.lit(3)})
    out = quality_rules.keep_quality(clash)
    assert out.columns == clash.columns and out.count() == quality_rules.keep_quality(fixtures.documents(spark)).count()


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


URLS = [None, "", "x", "http://", "http://a.com", "http://a.com/", "HTTP://A.Example.COM/en/x?y=/z#w", "https://www.example.com/en/", "https://example.com/english/1", "ftp://b.net/es/x", "b.net/fr/", "http://net/fr/q", "http://.net/fr/q", "http://xnet/fr/q", "http://a.com?x=/en/", "http://example.com//en/", "http://É.com/é\n/x", "a://b://c/d", "http://x.com:80/en/"]


def test_urls_by_trie_and_by_join(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*URLS, *URLS])], "page_id long, url string")
    extra = [*entry.URL_RULES, url_filter.Rule("block", "example.com", "/eng"), url_filter.Rule("allow", "example.com", "/eng"), url_filter.Rule("block", "a.com", "")]
    for rules in (entry.URL_RULES, extra):
        for chars in (url_filter.TRIE_CHARS, 0):
            for r in url_filter.judge_urls(df, rules, trie_chars=chars).collect():
                assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url, rules), r.url
    assert url_filter.judge_urls(df.limit(0), extra).count() == 0


def test_rule_ensemble_learns_and_abstains(spark):
    df = spark.createDataFrame([(k, ("good words of some length here and there. " * (1 + k % 5)) + f"n{k}" if k % 3 else "### *** " * (3 + k % 7)) for k in range(300)], "doc_id long, text string")
    labels = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    out = rule_ensemble.score_quality(df, rule_ensemble.learn(df, labels)).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in out) >= 295 and all(0 <= r.score <= 1 for r in out)
    none = rule_ensemble.learn(df, labels.limit(0))
    edge = fixtures.documents(spark)
    scored = rule_ensemble.score_quality(edge.withColumn("repeats", F.lit(1)), none)
    assert {r.score for r in scored.collect()} == {0.5} and scored.count() == edge.count()
    one = rule_ensemble.learn(df, labels.filter("quality = 1"))
    assert all(r.score > 0.99 for r in rule_ensemble.score_quality(edge, one).collect())
    assert rule_ensemble.score_quality(fixtures.empty(spark), none).count() == 0


def test_held_out_rows(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.select("doc_id", entry.held_out().alias("h")).collect())
