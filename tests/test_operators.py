"""Search, fusion, measures, chunks, sources, jobs, prompts and the whole way of a question."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions.answers import question_terms
from loomwright.operators import chunks, fusion, keyword_search, metrics, prompts, vector_search
from loomwright.plans import ask
from loomwright.plans import report as report_
from loomwright.sources import files, tables
from loomwright.streaming import jobs


def test_nearest_is_exact_with_ties_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8))
    data[50:60] = data[40]
    rows = spark.createDataFrame([(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(data)], "id long, embedding array<float>")
    asked = rows.filter("id % 40 = 0").withColumnRenamed("id", "qid")
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for bound in (vector_search.BLOCK_NUMBERS, 16):
        monkeypatch.setattr(vector_search, "BLOCK_NUMBERS", bound)
        got = defaultdict(list)
        for r in vector_search.nearest(asked, rows.repartition(5), 12).orderBy("qid", "rank").collect():
            got[r.qid].append(r.id)
        assert got == {q: sorted(range(200), key=lambda k: (round(1 - float(unit[q] @ unit[k]), 6) + 0.0, k))[:12] for q in range(0, 200, 40)}
    assert [r.id for r in vector_search.nearest_to(data[40].tolist(), rows, 3).orderBy("rank").collect()] == [40, 50, 51]
    for k in (0, 51):
        with pytest.raises(ValueError):
            vector_search.nearest(asked, rows, k)
    with pytest.raises(ValueError):
        vector_search.one_model(rows.withColumn("embed_model", F.lit("a")), "b")
    assert vector_search.nearest(asked.limit(0), rows, 3).count() == 0


def test_nearest_stays_within_its_corpus(spark):
    """Equal vectors in two corpora; zero vectors, vectors that are not finite and others of another size are never found."""
    rows = [(k, "a", [float(k == j) for j in range(5)]) for k in range(5)] + [(10 + k, "b", [float(k == j) for j in range(5)]) for k in range(5)]
    rows += [(20, "a", [0.0] * 5), (21, "a", [float("nan")] * 5), (22, "a", [1.0]), (23, None, [1.0] * 5), (24, "a", None)]
    held = spark.createDataFrame(rows, "id long, repo string, embedding array<float>")
    asked_ = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0, 0.0, 0.0]), (2, "b", [0.0, 1.0, 0.0, 0.0, 0.0]), (3, "c", [1.0] * 5), (4, None, [1.0] * 5), (5, "a", [0.0] * 5)], "qid long, repo string, embedding array<float>")
    got = defaultdict(list)
    for r in vector_search.nearest(asked_, held.repartition(3), 50, scope="repo").orderBy("qid", "rank").collect():
        assert not math.isnan(r.distance)
        got[r.qid].append(r.id)
    assert got == {1: [0, 1, 2, 3, 4], 2: [11, 10, 12, 13, 14]}
    everywhere = vector_search.nearest(asked_.filter("qid = 1"), held, 50).collect()
    assert {r.id for r in everywhere} == {*range(5), *range(10, 15), 23}


CORPUS = [
    (1, "src/load.py", "python", "loadRows", "def loadRows(path): return rows of path"),
    (2, "src/save.py", "python", None, "def save_rows(rows): write the rows"),
    (3, "docs/load.md", "markdown", None, "Loading is described elsewhere"),
    (4, "src/other.go", "go", "Other", "nothing of interest at all"),
    (5, "empty.md", "markdown", None, ""),
]


def corpus(spark):
    return spark.createDataFrame([("r", *c) for c in CORPUS], "repo_id string, chunk_id long, file_path string, language string, symbol string, content string")


def asked(spark, *texts):
    return spark.createDataFrame([(k, "r", t) for k, t in enumerate(texts)], "qid long, repo_id string, question string").select("qid", "repo_id", question_terms("question").alias("terms"))


def brute_bm25(question_words, phrases):
    import re

    lex = lambda t: re.findall("[a-z0-9]+", t.lower())
    camel = lambda t: re.sub("([a-z0-9])([A-Z])", r"\1 \2", t)
    docs = {}
    for k, path, _, symbol, content in CORPUS:
        a = lex(f"{symbol or ''} {camel(symbol or '')} {path}")
        docs[k] = (a, a + lex(content) + lex(camel(content)))
    n, avg = len(docs), sum(len(set(w)) for _, w in docs.values()) / len(docs)
    out = {}
    for k, (a, w) in docs.items():
        score = 0
        for x in question_words:
            tf = w.count(x) + a.count(x)
            df = sum(x in v for _, v in docs.values())
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(set(w)) / avg))
        if score:
            whole = any(list(p) == w[i : i + len(p)] for p in phrases for i in range(len(w)))
            out[k] = round(score * (1.5 if whole else 1), 6)
    return out


def test_bm25_boost_and_filter(spark):
    indexed = keyword_search.index(corpus(spark))
    cases = {"loadRows please": (["loadrows", "load", "rows", "please"], [("loadrows",), ("load", "rows"), ("please",)]), "the save_rows": (["save", "rows"], [("save", "rows")]), "write 'rows write'": (["rows", "write"], [("rows", "write"), ("write",)])}
    got = defaultdict(dict)
    for r in keyword_search.search(indexed, asked(spark, *cases)).collect():
        got[r.qid][r.chunk_id] = r.score
    assert dict(got) == {k: brute_bm25(*c) for k, c in enumerate(cases.values())}
    some = {(r.qid, r.chunk_id): r.score for r in keyword_search.search(indexed, asked(spark, *cases), languages=["python"], path_prefix="src/").collect()}
    assert some == {(q, k): s for q, scores in got.items() for k, s in scores.items() if k in (1, 2)}
    assert keyword_search.search(indexed, asked(spark, "the of")).count() == 0
    assert keyword_search.search(indexed, asked(spark, "rows"), path_prefix="s_c/").count() == 0
    assert {r.chunk_id for r in keyword_search.cover_density(indexed, asked(spark, "save rows")).collect()} == {1, 2}
    assert indexed.stats.first()["n"] == len(CORPUS)


def test_a_written_index_answers_as_one_in_memory(spark, tmp_path):
    made, written = keyword_search.index(corpus(spark)), keyword_search.index(corpus(spark), f"{tmp_path}/index")
    questions = asked(spark, "loadRows please", "the save_rows", "write 'rows write'")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for ix in (written, keyword_search.open_index(spark, f"{tmp_path}/index")):
        assert rows(keyword_search.search(ix, questions)) == rows(keyword_search.search(made, questions))
        assert rows(keyword_search.cover_density(ix, questions)) == rows(keyword_search.cover_density(made, questions))
    read = {f.split("/index/")[1].split("/")[0] for f in keyword_search.search(written, asked(spark, "rows please")).inputFiles()}
    assert read == {"postings", "lexicon", "stats"}


def test_cover_density_of_words_and_phrases(spark):
    docs = spark.createDataFrame([("r", 1, "a", "python", "near", "alpha beta gamma"), ("r", 2, "b", "python", None, "beta alpha")], "repo_id string, chunk_id long, file_path string, language string, symbol string, content string")
    indexed = keyword_search.index(docs)
    # Words are the symbol twice, the path, and the content twice.
    size = {1: 2 + 1 + 6, 2: 1 + 4}
    got = {r.chunk_id: r.score for r in keyword_search.cover_density(indexed, asked(spark, "alpha near")).collect()}
    assert got == {1: round((2 * 0.1 + 2 * 1.0) / math.log(1 + size[1]), 6), 2: round(2 * 0.1 / math.log(1 + size[2]), 6)}
    got = {r.chunk_id: r.score for r in keyword_search.cover_density(indexed, asked(spark, "'alpha beta'")).collect()}
    assert got == {1: round(2 * (2 / 20) / math.log(1 + size[1]), 6), 2: round(1 * (2 / 20) / math.log(1 + size[2]), 6)}


def test_fusion(spark):
    make = lambda rows: spark.createDataFrame([(1, k + 1, c) for k, c in enumerate(rows)], "qid long, rank int, chunk_id long")
    a, b = [5, 3, 9, 1], [3, 7, 5]
    want = Counter()
    for k, c in enumerate(a):
        want[c] += 1 / (60 + k + 1)
    for k, c in enumerate(b):
        want[c] += 0.75 / (60 + k + 1)
    got = fusion.fuse(make(a), make(b)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == sorted(want, key=lambda c: (-round(want[c], 9), c))
    assert all(abs(r.fused_score - want[r.chunk_id]) < 1e-9 for r in got)
    tests = fusion.fuse(make(a), make(b), is_test=F.col("chunk_id") == 3).orderBy("rank").collect()
    assert tests[0].chunk_id == 5
    assert {r.chunk_id for r in fusion.fuse(make(a), make(b), pool=1).collect()} == {5, 3}
    told = spark.createDataFrame([(1, [2, 0, 2])], "qid long, ranking array<int>")
    assert [r.chunk_id for r in fusion.rerank(make([10, 11, 12, 13, 14]), told, depth=3, top=4).orderBy("rank").collect()] == [12, 10, 11, 13]
    assert [r.chunk_id for r in fusion.rerank(make([10, 11]), told.limit(0)).orderBy("rank").collect()] == [10, 11]


def test_measures(spark):
    labels = spark.createDataFrame([("q", 1, "f", 10, 20, 2), ("q", 2, "g", 1, 5, 2), ("q", 3, "f", 1, 9, 1), ("p", 4, "z", 1, 1, 2)], "qid string, label long, file string, start int, end int, grade int")
    ranked = spark.createDataFrame([("q", 1, "f", 1, 9), ("q", 2, "h", 10, 20), ("q", 3, "f", 20, 30), ("q", 9, "g", 5, 5)], "qid string, rank int, file string, start int, end int")
    asked_ = spark.createDataFrame([("q", "dev"), ("p", "test")], "qid string, split string")
    scored = metrics.scores(asked_, metrics.hits(ranked, labels), labels)
    rows = {r.qid: r for r in scored.collect()}
    q, p = rows["q"], rows["p"]
    assert (q.first, q.recall_1, q.recall_3, round(q.reciprocal, 6), q.coverage) == (3, 0.0, 1.0, 0.333333, 0.5)
    assert (p.first, p.recall_8, p.reciprocal, p.coverage) == (0, 0.0, 0.0, 0.0)
    means = {(r.dimension, r.value): r for r in metrics.summary(scored, ["split"]).collect()}
    assert means[("all", "all")].n == 2 and means[("split", "dev")].recall_3 == 1.0 and len(means) == 3
    base = scored.withColumn("first", F.lit(2))
    assert {r.qid: r.change for r in metrics.compared(scored, base).collect()} == {"q": "worse", "p": "worse"}
    assert {r.change for r in metrics.compared(base, base).collect()} == {"unchanged"}
    five = spark.createDataFrame([(x,) for x in (5, 1, 3, 2, 4)], "v int")
    assert [five.agg(metrics.percentile("v", n)).first()[0] for n in (50, 90, 100)] == [3, 5, 5]
    lists = spark.createDataFrame([("q", 1, 5), ("q", 2, 6)], "qid string, rank int, chunk_id long")
    other = spark.createDataFrame([("q", 1, 5)], "qid string, rank int, chunk_id long")
    assert metrics.same_lists(lists, other).first()["differs_at"] == 2 and metrics.same_lists(lists, lists).first()["same"]


def test_grades_splits_and_reviews(spark):
    labels = spark.createDataFrame([("q", 1, "f", 1, 10, 1), ("q", 2, "f", 8, 12, 2)], "qid string, label long, file string, start int, end int, grade int")
    spans = [(1, "f", 1, 9, 2), (2, "f", 1, 5, 1), (3, "f", 12, 30, 2), (4, "f", 13, 30, 0), (5, "F", 1, 9, 0)]
    ranked = spark.createDataFrame([("q", *x[:4]) for x in spans], "qid string, rank int, file string, start int, end int")
    assert {r.rank: r.grade for r in metrics.best_grades(ranked, metrics.hits(ranked, labels)).collect()} == {x[0]: x[4] for x in spans}
    questions = spark.createDataFrame([(1, "dev", "where"), (2, "test", "where"), (3, "dev", "unanswerable")], "qid long, split string, kind string")
    ids = lambda df: {r.qid for r in df.collect()}
    assert ids(metrics.of_split(questions, "dev")) == {1, 3} and ids(metrics.answerable(questions)) == {1, 2} and ids(metrics.of_split(questions, "all", final=True)) == {1, 2, 3}
    for split, final in (("test", False), ("all", False), ("x", True)):
        with pytest.raises(ValueError):
            metrics.of_split(questions, split, final)
    pairs = spark.createDataFrame([(k, k == 3, k != 5, k != 6) for k in range(9)], "qid long, changed boolean, passed boolean, base_passed boolean")
    assert {r.qid: r.why for r in metrics.to_review(pairs, 2).collect()} == {3: "changed", 5: "failed", 6: "failed", 0: "spot check", 1: "spot check"}
    run = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 1.0)], "qid long, r double")
    for name in ("recall_1", "recall_3", "recall_5", "recall_8", "reciprocal", "coverage"):
        run = run.withColumn(name, F.col("r"))
    base = run.filter("qid <> 3").withColumns({c: F.lit(0.5003) for c in ("recall_1", "reciprocal")})
    got = metrics.paired(run.withColumn("split", F.lit("dev")), base.withColumn("split", F.lit("dev")), ["split"]).filter("dimension = 'all'").first()
    assert got.n == 2 and got.recall_1 == 0.0 and got.recall_3 == 0.0


def test_runs_and_reports(spark, tmp_path):
    rows = [(k, "dev" if k % 2 else "test", k % 3, *[float(k % 3 > 0)] * 4, 0.5 * (k % 3 > 0), 0.25) for k in range(6)]
    run = spark.createDataFrame(rows, "qid long, split string, first int, recall_1 double, recall_3 double, recall_5 double, recall_8 double, reciprocal double, coverage double")
    report_.write_run(run, f"{tmp_path}/run")
    back = report_.read_run(spark, f"{tmp_path}/run", ["split"])
    assert sorted(tuple(r) for r in back.select(*run.columns).collect()) == sorted((str(r[0]), *r[1:]) for r in rows)
    got = report_.report(back, ["split"], back.filter("qid <> '0'").withColumns({"first": F.lit(1), "recall_1": F.lit(0.2)}))
    assert "| all | 6 | 0.667 | 0.667 | 0.667 | 0.667 | 0.333 | 0.250 |" in got and "| split dev | 3 |" in got
    assert "| all | 5 | +0.600 | 0 | 0 | 0 | 0 | 0 |" in got and "First hits: 0 better, 3 worse, 2 unchanged." in got


def test_rankings_are_cached_and_batches_are_kept(spark, tmp_path):
    listed = spark.createDataFrame([(1, "why", [5, 6], ["a", "b"], "p1"), (2, " why ", [5, 6], ["a", "b"], "p1"), (3, "who", [6, 5], ["b", "a"], "p2")], "qid long, question string, ids array<long>, texts array<string>, prompt string")
    reply = lambda prompts_: ['{"ranking": [2, 1]}' if p == "p1" else "no" for p in prompts_]
    got, new = ask.rankings(listed, None, "m", reply)
    assert {r.qid: r.ranking for r in got.collect()} == {1: [1, 0], 2: [1, 0]} and new.count() == 1
    new.write.parquet(f"{tmp_path}/cache")
    again, more = ask.rankings(listed.filter("qid < 3"), spark.read.parquet(f"{tmp_path}/cache"), "m", lambda prompts_: [1 / 0 for _ in prompts_])
    assert {r.qid for r in again.collect()} == {1, 2} and more.count() == 0
    for texts in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/texts")
        ask.embed_stream(spark.readStream.schema("text string").parquet(f"{tmp_path}/texts"), f"{tmp_path}/vectors", lambda t: [[float(len(x)), 1.0] for x in t], f"{tmp_path}/progress")
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 3


PYTHON = """import os

LIMIT = 3

# adds
# numbers
def add(a, b):
    return a + b


x = 1  # note
def after():
    pass

@wrap
class Box:
    size = 1

    def get(self):
        return 1

async def wait():
    await x
"""
GO = """package a

import "fmt"

// Run runs.
func (s *Server[T]) Run() error {
	return nil
}

type Box struct {
	A int
}

type Id int

func Top() { fmt.Println() }
"""
TS = """import a from "a";

// keeps
export class Widget {
  go() { return 1; }
}

export const twice = (x: number) => x * 2;

interface Shape {
  a: number;
}
function plain() {}
exports.helper = function () { return 1; };
"""
MARKDOWN = """intro

# Title
text

## Empty

### Child [link](x) ##
body

```
# no heading
```
## Next
more
"""


def made(spark, name, language, source, **options):
    df = spark.createDataFrame([(name, language, source)], "file string, language string, text string")
    rows = chunks.chunk(df, **options).orderBy("start", "end").collect()
    lines = source.split("\n")
    for r in rows:
        assert r.content == "\n".join(lines[r.start - 1 : r.end])
        assert r.embed_text.endswith("\n---\n" + r.content)
    return [(r.symbol, r.kind, r.start, r.end) for r in rows]


def test_chunks_of_code(spark):
    assert made(spark, "a.py", "python", PYTHON) == [("add", "function", 5, 8), ("after", "function", 12, 13), ("Box", "class", 15, 20), ("wait", "function", 22, 23)]
    assert made(spark, "a.go", "go", GO) == [("Server.Run", "method", 5, 8), ("Box", "struct", 10, 12), ("Id", "type", 14, 14), ("Top", "function", 16, 16)]
    assert made(spark, "a.ts", "typescript", TS) == [("Widget", "class", 3, 6), ("twice", "function", 8, 8), ("Shape", "interface", 10, 12), ("plain", "function", 13, 13), ("exports.helper", "function", 14, 14)]


#: Source by language whose brackets, margins and names mislead, with its symbols.
MISLEADING = [
    ("python", "def real(\n    a,\n):\n    return 1\n", [("real", "function", 1, 4)]),
    ("python", 'x = """\ndef fake():\n"""\n', [(None, "window", 1, 3)]),
    ("python", "@deco(\n    1,\n)\ndef f(x):\n    pass\n", [("f", "function", 1, 5)]),
    ("python", "def a():\n    s = 'it\\'s # (['  # ({[\n    return (1,\n2)\n# at the margin\n    # within\n\n@b\n# said of c\nclass C: pass\n", [("a", "function", 1, 6), ("C", "class", 8, 10)]),
    ("python", "def ok():\n    return 1\n\ndef broken(:\n    ((((\n\ndef last():\n    pass\n", [("ok", "function", 1, 2), ("broken", "function", 4, 5), ("last", "function", 7, 8)]),
    ("python", "x = 1 + \\\n2\ndef f(): return '''\ndef g(): pass\n'''\nif x:\n    def no(): pass\n", [("f", "function", 3, 5)]),
    ("go", "package a\n\n// B says\nfunc B() string {\n\treturn `a\n}\n`\n}\n", [("B", "function", 3, 8)]),
    ("go", "type (\n\tX struct {\n\t\ta int\n\t}\n\t// says\n\tY interface{}\n)\n", [("X", "struct", 2, 4), ("Y", "interface", 5, 6)]),
    ("go", "// One is alone.\ntype (\n\tOnly struct{}\n)\ntype A int\ntype B struct{}\ntype C = B\n", [("Only", "struct", 1, 4), ("A", "type", 5, 5), ("B", "struct", 6, 6), ("C", "type", 7, 7)]),
    ("go", "/*\nLong\n\nwords {\n*/\nfunc (s *Set[T]) Put(\n\tx T,\n) {\n\tr := '{'\n}\nfunc (Set[T]) Len() int { return 0 }\n", [("Set.Put", "method", 1, 10), ("Set.Len", "method", 11, 11)]),
    ("typescript", "export default function () {\n  return 1;\n}\nexport default class {\n  a() {}\n}\nexport default async () => {\n};\n", [("default", "function", 1, 3), ("default", "class", 4, 6), ("default", "function", 7, 8)]),
    ("typescript", "const t = `\nfunction no() {\n  ${f({a: `}`})}\n`;\nfunction yes(\n  a: string,\n): { x: number }\n{\n  const r = /[\"'`{]/.test(a);\n  return { x: 1 };\n}\n", [(None, "window", 1, 4), ("yes", "function", 5, 11)]),
    ("typescript", "export const go = async (\n  a,\n  b = {},\n) => {\n  return a;\n};\nexport type U =\n  | 'a'\n  | 'b';\nconst el = <p>don't {x}</p>\nlet f: (a: number) => void = (a) => {}\nconst g = call(() => 1);\n", [("go", "function", 1, 6), ("U", "type", 7, 9), ("f", "function", 11, 11)]),
    ("javascript", "/* says */ x = 1 /* a\n}\n*/\nfunction* gen() {\n}\nclass A extends B\n{\n}\na.b.c = function () {};\n", [(None, "window", 1, 3), ("gen", "function", 4, 5), ("A", "class", 6, 8), ("a.b.c", "function", 9, 9)]),
    ("ruby", "def f\nend\n", [(None, "window", 1, 2)]),
]


def test_symbols_by_lexical_state(spark):
    files = spark.createDataFrame([(str(k), language, text) for k, (language, text, _) in enumerate(MISLEADING)], "file string, language string, text string")
    got = {}
    for r in chunks.chunk(files).collect():
        got.setdefault(int(r.file), []).append((r.symbol, r.kind, r.start, r.end))
    for k, (_, text, want) in enumerate(MISLEADING):
        assert sorted(got[k], key=lambda r: r[2]) == want, text


def test_files_of_any_kind_are_chunked(spark):
    files = spark.createDataFrame([(1, None, "a\nb"), (2, "python", None), (3, "go", ""), (4, "python", "def f():\n    pass"), (5, "markdown", "~~~\n# no\n~~~~\n# A\nx\n````\n```\n# no\n````\n## B\ny")], "file long, language string, text string")
    got = sorted((r.file, r.symbol or "", r.kind, r.start, r.end) for r in chunks.chunk(files).collect())
    assert got == [(1, "", "window", 1, 2), (4, "f", "function", 1, 2), (5, "", "doc", 1, 3), (5, "A", "doc", 4, 9), (5, "A > B", "doc", 10, 11)]


def test_long_classes_are_cut_into_their_members(spark):
    source = "class Ship(Base):\n    \"\"\"Doc.\"\"\"\n    size = 1\n\n    @wrap\n    def sail(self):\n        def inner():\n            return 1\n        return inner()\n\n    async def stop(\n        self,\n    ):\n        return 2\n    speed = 3\n\n    # says\n    # more\n    def name(self):\n        return 4\n\n\ndef after():\n    pass\n"
    assert made(spark, "a.py", "python", source, max_lines=6, overlap=1, min_gap=9) == [("Ship", "class", 1, 3), ("Ship.sail", "method", 5, 9), ("Ship.stop", "method", 11, 14), ("Ship.name", "method", 17, 20), ("after", "function", 23, 24)]
    assert made(spark, "a.py", "python", source)[0] == ("Ship", "class", 1, 20)
    source = "export class Box {\n  #a = 1;\n  constructor() {\n    this.b = 2;\n  }\n\n  // gives\n  static make(n: number): Box { return new Box(); }\n  get value() { return 1; }\n  go = async (x) => {\n    if (x) { y(); }\n  };\n  plain = 3;\n}\n"
    assert made(spark, "b.ts", "typescript", source, max_lines=6, overlap=1, min_gap=9) == [("Box", "class", 1, 2), ("Box.constructor", "method", 3, 5), ("Box.make", "method", 7, 8), ("Box.value", "method", 9, 9), ("Box.go", "method", 10, 12)]
    assert made(spark, "c.py", "python", "class Data:\n" + "    x = 1\n" * 9, max_lines=5, overlap=0)[0] == ("Data", "class", 1, 5)


def test_chunks_of_text_and_windows(spark):
    assert made(spark, "a.md", "markdown", MARKDOWN) == [(None, "doc", 1, 1), ("Title", "doc", 3, 4), ("Title > Empty > Child link", "doc", 8, 13), ("Title > Next", "doc", 14, 15)]
    assert made(spark, "c.py", "python", "A = 1\nB = 2\n") == [(None, "window", 1, 2)]
    assert made(spark, "blank.py", "python", "\n \n") == [] and made(spark, "empty.md", "markdown", "") == []
    big = "\n".join(f"v{k} = {k}" for k in range(25))
    assert made(spark, "d.py", "python", big, max_lines=10, overlap=2) == [(None, "window", 1, 10), (None, "window", 9, 18), (None, "window", 17, 25)]
    for length, most, over in itertools.product((1, 5, 9, 10, 11, 30), (3, 10), (0, 2)):
        got = spark.range(1).select(F.explode(chunks.windows(F.lit(4), F.lit(3 + length), most, over)).alias("w")).select("w.*").collect()
        want, s = [], 4
        while True:
            e = min(s + most - 1, 3 + length)
            want.append((s, e))
            if e == 3 + length:
                break
            s = e - over + 1
        assert [tuple(r) for r in got] == want
    with pytest.raises(ValueError):
        chunks.windows(F.lit(1), F.lit(2), 3, 3)


def test_scan_of_a_tree(spark, tmp_path):
    for path, data in {"a.py": b"x\n", "sub/b.go": b"package b", "node_modules/c.js": b"", "go.sum": b"", "d.bin": b"", "e.py": b"\0", "f.md": b"x" * 3000, "g.ts": b"// @generated\n", ".github/h.md": b"# h\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "l.py").symlink_to(tmp_path / "a.py")
    out = files.scan(spark, str(tmp_path), max_kb=2)
    kept = {r.path: (r.language, r.size, r.lines) for r in out.filter("skip_reason IS NULL").collect()}
    assert kept == {"a.py": ("python", 2, 1), "sub/b.go": ("go", 9, 1), ".github/h.md": ("markdown", 4, 1)}
    assert {r.skip_reason: r["count"] for r in files.skipped(out).collect()} == {"ignored_dir": 1, "lockfile": 1, "unsupported": 1, "binary": 1, "too_large": 1, "generated": 1, "symlink": 1}
    capped = files.scan(spark, str(tmp_path), max_files=1, max_kb=2)
    assert sum(r["count"] for r in files.by_language(capped).collect()) == 1


def test_repositories_and_labels(spark):
    pins = spark.createDataFrame([("O/One", "abcdef123"), ("o/two", "abcdef123"), ("o/three", "abcdef123"), ("o/four", "abcdef123")], "name string, commit string")
    have = spark.createDataFrame([("o", "one", "ready", "abcdef123"), ("o", "two", "failed", None), ("o", "Three", "ready", "0123456789")], "owner string, name string, status string, commit string")
    assert sorted(tuple(r) for r in tables.pin_problems(pins, have).collect()) == [("o/four", "not indexed"), ("o/three", "indexed at 0123456, pinned at abcdef1"), ("o/two", "indexed at nothing, pinned at abcdef1"), ("o/two", "not ready: failed")]
    lines = spark.createDataFrame([("f", 1, "def load():"), ("f", 2, "  pass")], "file string, n int, line string")
    labels = spark.createDataFrame([("a", "f", 1, 2, "X.load"), ("b", "f", 2, 2, "load"), ("c", "g", 1, 1, None), ("d", "f", 2, 3, None), ("e", "f", 2, 1, "load")], "id string, file string, start int, end int, symbol string")
    assert sorted((r.id, r.problem.split(":")[0]) for r in tables.label_problems(labels, lines).collect()) == [("b", "symbol not in the lines"), ("c", "no such file"), ("d", "lines outside the file"), ("e", "lines outside the file")]
    repositories, jobs_ = spark.createDataFrame([(1,), (2,)], "repo_id long"), spark.createDataFrame([(5, 1, "failed"), (6, 1, "queued")], "job_id long, repo_id long, status string")
    assert [(r.repo_id, r.job_status) for r in tables.listed(repositories, jobs_).collect()] == [(2, None), (1, "queued")]


def test_tables(spark, tmp_path):
    store = tables.VersionedTable(spark, str(tmp_path))
    assert store.current() is None
    store.replace(spark.range(3), 1)
    store.replace(spark.range(7), 2)
    assert store.read().count() == 7
    with pytest.raises(ValueError):
        store.replace(spark.range(1), 2)
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    found, missing = tables.cached(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), cache, ["k"])
    assert found.count() == 1 and [r.k for r in missing.collect()] == ["b"]
    assert [r.k for r in tables.first_write(cache, spark.createDataFrame([("a", 2), ("c", 3), ("c", 3)], "k string, v int"), ["k"]).collect()] == ["c"]
    (tmp_path / "set.json").write_text('{"version": 1, "labels_frozen": true, "repositories": [], "questions": [{"id": "1", "kind": "where", "split": "dev", "question": "x", "relevant": [{"file": "a", "start_line": 3, "end_line": 2, "grade": 2}]}, {"id": "1", "kind": "unanswerable", "split": "all", "question": " ", "relevant": []}]}')
    problems = Counter(r.problem for r in tables.eval_problems(tables.read_eval_set(spark, str(tmp_path / "set.json"))).collect())
    assert problems == Counter(["label with a wrong range", "empty question", "unknown split", "repeated id"])


def test_jobs(spark):
    e = spark.createDataFrame([(1, 1, 100, "queued", None), (1, 2, 101, "claimed", None), (1, 3, 102, "progress", 5.0), (1, 4, 103, "progress", None), (2, 5, 90, "queued", None), (3, 6, 90, "queued", None), (3, 7, 91, "claimed", None), (3, 8, 92, "released", None)], "job long, id long, at long, kind string, value double").withColumn("ts", F.timestamp_seconds("at"))
    states = jobs.job_states(e, "job", "ts", "id", "kind", "value").withColumnRenamed("job", "key")
    assert {r.key: (r.status, r.attempts, r.progress) for r in states.collect()} == {1: ("running", 1, 5.0), 2: ("queued", 0, None), 3: ("queued", 0, None)}
    assert [r.key for r in jobs.claim_order(states).orderBy("turn").collect()] == [2, 3] and jobs.claim_next(states).first()["key"] == 2
    stale = jobs.requeue_stale(states, F.timestamp_seconds(F.lit(103 + 601)))
    assert {r.key: r.status for r in stale.collect()}[1] == "queued"
    assert {r.key: r.status for r in jobs.requeue_stale(states.withColumn("attempts", F.lit(3)), F.timestamp_seconds(F.lit(1000))).collect()}[1] == "failed"
    assert not any(r.stale for r in jobs.requeue_stale(states, F.timestamp_seconds(F.lit(103 + 600))).collect())


def requests(spark, seed=2):
    rng = random.Random(seed)
    at = sorted(rng.randrange(0, 600_000_000) for _ in range(120))
    return spark.createDataFrame([(k, t // 1_000_000 % 3, t) for k, t in enumerate(at)], "id long, who long, us long").withColumn("ts", F.timestamp_micros("us"))


def test_token_bucket_and_window(spark):
    df = requests(spark)
    rows = df.collect()
    want = {}
    for who in range(3):
        tokens, last = 4.0, None
        for r in rows:
            if r.who == who:
                tokens = min(4.0, tokens + (0 if last is None else (r.us - last) * 4 / 60e6))
                last = r.us
                want[r.id] = tokens >= 1
                tokens -= want[r.id]
    got = {r.id: r.allowed for r in jobs.token_bucket(df, "who", "ts", "id", 4).collect()}
    assert sum(got[k] != v for k, v in want.items()) == 0 and not all(got.values())
    for r in jobs.in_trailing(df, "who", "ts").collect():
        assert r.in_window == sum(x.who == r.who and r.us - 60_000_000 < x.us <= r.us for x in rows)


def test_streams_equal_batches(spark, tmp_path):
    df = requests(spark).withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    half = df.filter("id < 60"), df.filter("id >= 60")
    half[0].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for k in range(2):
        jobs.drain(jobs.token_bucket_stream(stream(), "who", "ts", "id", 4), f"{tmp_path}/out", f"{tmp_path}/check")
        if k == 0:
            half[1].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {(r.id, r.allowed) for r in jobs.token_bucket(df, "who", "ts", "id", 4).collect()}
    assert {(r.id, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    jobs.drain(jobs.counts_stream(stream(), "ts", "kind", "1 minute", "0 seconds"), f"{tmp_path}/counts", f"{tmp_path}/check2")
    whole = {tuple(r) for r in jobs.counts_stream(df, "ts", "kind", "1 minute").collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/counts").collect()} <= whole


def context(spark, sizes):
    rows = [(1, k + 1, f"f{k}.py", 1, 2, None, "window", "python", "é" * n) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "qid long, rank int, file string, start int, end int, symbol string, kind string, language string, content string")


def test_prompts(spark):
    q = spark.createDataFrame([(1, "why?")], "qid long, question string")
    got = prompts.prompts(q, context(spark, [10, 10, 500, 1]), 200).first()
    assert got.n_blocks == 2 and got.prompt.startswith("Context:\n[1] f0.py:1-2 (-, window, python)\n```\néé") and got.prompt.endswith("\n\nQuestion: why?")
    cut = prompts.prompts(q, context(spark, [500]), 100).first()
    assert cut.n_blocks == 1 and "[content truncated]" in cut.prompt and len(cut.prompt.split("Question")[0].encode()) <= 100 + 11 + 2
    cited = prompts.citations(prompts.cite(spark.createDataFrame([(1, "b [2] a [1]", 2)], "qid long, answer string, n_blocks int")), spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "qid long, n int, file string"))
    assert [r.file for r in cited.orderBy("place").collect()] == ["y", "x"]


def test_a_question_from_end_to_end(spark, tmp_path):
    held = corpus(spark).withColumns({"start": F.lit(1), "end": F.lit(9), "kind": F.lit("function")})
    vectors = spark.createDataFrame([(k, [float(k == j) for j in range(1, 6)]) for k in range(1, 6)], "id long, embedding array<float>")
    questions = spark.createDataFrame([(7, "r", "where is loadRows", [1.0, 0.0, 0.0, 0.0, 0.2])], "qid long, repo_id string, question string, embedding array<float>")
    model = lambda prompts_: ["It loads [1]. Also [99]." for _ in prompts_]
    for mode in ask.MODES:
        got = ask.answer(questions, held, vectors, model, lambda p: ['{"ranking": [2]}' for _ in p], ask.Settings(mode=mode)).first()
        assert (got.answer, got.numbers, got.invalid, got.grounded) == ("It loads [1]. Also.", [1], 1, True)
    ranked = ask.retrieve(questions, held, vectors, ask.Settings(mode="hybrid")).orderBy("rank").collect()
    assert ranked[0].chunk_id == 1
    # The same vectors in another repository never reach the question.
    other = held.withColumns({"repo_id": F.lit("s"), "chunk_id": F.col("chunk_id") + 100})
    both = vectors.unionByName(vectors.withColumn("id", F.col("id") + 100))
    for mode in ("vector", "hybrid"):
        found = ask.retrieve(questions, held.unionByName(other), both, ask.Settings(mode=mode)).collect()
        assert found and all(r.chunk_id < 100 for r in found)
    with pytest.raises(ValueError):
        ask.retrieve(questions, held.withColumn("embed_model", F.lit("old")), vectors, ask.Settings(mode="vector", embed_model="new"))
    assert ask.Settings(top=999).top == 50 and ask.Settings(top=0).top == 1
    seen = []
    ask.answer(questions, held.withColumn("content", F.repeat("content", F.lit(1000))), vectors, model, lambda p: seen.extend(p) or ['{"ranking": [1]}' for _ in p], ask.Settings(mode="hybrid_rerank")).collect()
    known = spark.createDataFrame([("r", "ready"), ("s", "indexing")], "repo_id string, status string")
    asked_ = spark.createDataFrame([(1, "r"), (2, "s"), (3, "t")], "qid long, repo_id string")
    judged = ask.readiness(asked_, known).select("qid", "problem", ask.classified(F.col("problem")).alias("said")).collect()
    assert {r.qid: (r.problem, r.said and r.said.status) for r in judged} == {1: (None, None), 2: ("not_ready", 409), 3: ("not_found", 404)}
    assert spark.range(1).select(ask.classified(F.lit("boom")).alias("x")).first().x.code == "internal"
    store = f"{tmp_path}/answers"
    more = spark.createDataFrame([(k,) for k in range(4)], "qid long")
    ask.resume(more.filter("qid < 2"), store, lambda df: df.withColumn("answer", F.lit("a")))
    assert {r.qid for r in ask.pending(more, store).collect()} == {2, 3}
    ask.resume(more, store, lambda df: df.withColumn("answer", F.lit("b")))
    assert sorted((r.qid, r.answer) for r in spark.read.parquet(store).collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(ValueError):
        ask.check_questions(questions.withColumn("question", F.lit(" ")))
    for bad in ({"languages": ("cobol",)}, {"path_prefix": "/a"}, {"path_prefix": "a/../b"}, {"path_prefix": "x" * 201}, {"mode": "x"}, {"languages": ("go",) * 11}):
        with pytest.raises(ValueError):
            ask.Settings(**bad)
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    new = ask.embed_texts(texts, None, lambda t: [[1.0, float(len(x))] for x in t])
    assert new.count() == 2
    assert ask.embed_texts(texts, new, lambda t: [][1]).count() == 2  # nothing is asked for twice


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    from loomwright.queries import QUERIES

    top = plan(QUERIES["vector_nearest"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in top and "CartesianProduct" not in top
    paths = plan(tables.table(spark, "/root/testdata/sf0.001", "pages").filter(F.col("url").startswith("http")).select("page_id"))
    assert "StringStartsWith(url,http)" in paths


def test_questions_of_several_dimensions(spark):
    """A vector of another size silences its own question alone."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, None), (5, [])], "id long, embedding array<double>")
    asked_ = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 0.0, 0.0]), (4, []), (5, None)], "qid long, embedding array<double>")
    got = [(r.qid, r.rank, r.id) for r in vector_search.nearest(asked_, rows.repartition(2), 5).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (3, 1, 3)]


def test_every_job_has_a_turn_of_its_own(spark):
    """Also when neither plan nor rows are shared between the numbering and the sums before it."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        states = spark.range(400_000).select(F.col("id").alias("key"), F.lit("queued").alias("status"), F.timestamp_seconds(F.xxhash64("id") % 1000).alias("first_ts"))
        found = jobs.claim_order(states)
        assert tuple(found.agg(F.count("*"), F.countDistinct("turn"), F.min("turn"), F.max("turn")).first()) == (400_000, 400_000, 1, 400_000)
        sorted_ = Window.orderBy("turn")
        after = found.filter("turn > 199000 AND turn < 201000").withColumn("last", F.lag(F.struct("first_ts", "key")).over(sorted_))
        assert after.filter(F.col("last") >= F.struct("first_ts", "key")).count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, k, k) for k in range(3)] + [(1, 10 + k, k) for k in range(3)], "who long, id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.id: (r.key, r.allowed) for r in jobs.token_bucket(df, "who", "ts", "id", 2).collect()}
    assert got == {0: (None, True), 1: (None, True), 2: (None, False), 10: (1, True), 11: (1, True), 12: (1, False)}
    got = sorted((r.id, r.who, r.batch) for r in prompts.request_batches(df.withColumn("cost", F.lit(3)).withColumn("_key", F.lit(1)), "who", "id", "cost", 2, 100).collect())
    assert got == [(0, None, 0), (1, None, 0), (2, None, 1), (10, 1, 0), (11, 1, 0), (12, 1, 1)]


def test_a_repository_is_replaced_in_a_written_index(spark, tmp_path):
    """A search equals one over a fresh index, and the folders of other buckets keep their files."""
    import glob
    import os

    path = f"{tmp_path}/index"
    held = corpus(spark)
    many = [held.withColumns({"repo_id": F.lit(f"r{k}"), "chunk_id": F.col("chunk_id") + 100 * k}) for k in range(6)]
    whole = many[0]
    for more in many[1:]:
        whole = whole.unionByName(more)
    keyword_search.index(whole, path)
    files_ = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    before = files_()
    new = many[2].filter("chunk_id % 2 = 0").withColumn("content", F.concat("content", F.lit(" rows loadRows of load rows")))
    found = keyword_search.replace(spark, path, ["r2"], new)
    fresh = keyword_search.index(whole.filter("repo_id <> 'r2'").unionByName(new))
    questions = spark.createDataFrame([(10 * k + j, f"r{k}", t) for k in range(6) for j, t in enumerate(("loadRows please", "write 'rows write' of"))], "qid long, repo_id string, question string").select("qid", "repo_id", question_terms("question").alias("terms"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for ix in (found, keyword_search.open_index(spark, path)):
        assert rows(keyword_search.search(ix, questions)) == rows(keyword_search.search(fresh, questions))
        assert rows(keyword_search.cover_density(ix, questions)) == rows(keyword_search.cover_density(fresh, questions))
    bucket = spark.createDataFrame([("r2",)], "repo_id string").select(keyword_search._bucket()).first()[0]
    changed = {f for f in set(before) | set(files_()) if before.get(f) != files_().get(f)}
    assert changed and all(f"bucket={bucket}/" in f or f"bucket={bucket}\\" in f for f in changed)
    gone = keyword_search.replace(spark, path, ["r2"], new.limit(0))
    assert rows(gone.stats.select("repo_id", "n")) == [(f"r{k}", 5) for k in range(6) if k != 2] and gone.postings.filter("repo_id = 'r2'").count() == 0


def test_many_questions_are_not_held_by_the_driver(spark, monkeypatch):
    indexed, questions = keyword_search.index(corpus(spark)), asked(spark, "loadRows please", "the save_rows", "write 'rows write'")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(keyword_search.search(indexed, questions)), rows(keyword_search.cover_density(indexed, questions))
    monkeypatch.setattr(keyword_search, "BROADCAST_ROWS", 2)
    assert (rows(keyword_search.search(indexed, questions)), rows(keyword_search.cover_density(indexed, questions))) == want


def test_answers_check_repositories_and_keep_rankings(spark, tmp_path):
    held = corpus(spark).withColumns({"start": F.lit(1), "end": F.lit(9), "kind": F.lit("function")})
    vectors = spark.createDataFrame([(k, [float(k == j) for j in range(1, 6)]) for k in range(1, 6)], "id long, embedding array<float>")
    questions = spark.createDataFrame([(k, r, "where is loadRows", [1.0, 0.0, 0.0, 0.0, 0.2]) for k, r in ((1, "r"), (2, "s"), (3, "t"))], "qid long, repo_id string, question string, embedding array<float>")
    known = spark.createDataFrame([("r", "ready"), ("s", "indexing")], "repo_id string, status string")
    indexed = keyword_search.index(held, f"{tmp_path}/index")
    model = lambda prompts_: ["It loads [1]." for _ in prompts_]
    ranker = lambda p: ['{"ranking": [2]}' for _ in p]
    never = lambda p: [1 / 0 for _ in p]
    for reranker in (ranker, never):  # the second time every ranking is known
        got = {r.qid: r for r in ask.answer(questions, held, vectors, model, reranker, indexed=indexed, repositories=known, cache=f"{tmp_path}/rankings").collect()}
        assert {k: r.problem for k, r in got.items()} == {1: None, 2: "not_ready", 3: "not_found"} and got[1].answer == "It loads [1]." and got[2].answer is None
    assert spark.read.parquet(f"{tmp_path}/rankings").count() == 1


def test_answers_before_a_failure_are_kept(spark, tmp_path):
    store, questions, calls = f"{tmp_path}/answers", spark.range(50).withColumnRenamed("id", "qid"), []

    def answer_batch(df):
        calls.append(df.count())
        if len(calls) == 4:
            raise RuntimeError("the model failed")
        return df.withColumn("answer", F.lit("a"))

    with pytest.raises(RuntimeError):
        ask.resume(questions, store, answer_batch, 5)
    done = spark.read.parquet(store).count()
    assert 0 < done < 50 and done == sum(calls[:3])
    ask.resume(questions, store, answer_batch, 5)
    assert sorted(r.qid for r in spark.read.parquet(store).collect()) == list(range(50)) and sum(calls) - calls[3] == 50


def test_percentiles_of_groups(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([rng.randrange(5), rng.random() * 100])) for g, n in (("a", 1), ("b", 2), ("c", 199), (None, 40), ("e", 1000)) for _ in range(n)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows] + [("c", None), ("f", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in metrics.group_percentiles(df, "g", "v", {"p1": 1, "p50": 50, "p90": 90, "p100": 100}, "middle").collect()}
    assert set(got) == {"a", "b", "c", None, "e"}
    for g, r in got.items():
        v = sorted(float(x) for k, x in rows if k == g)
        assert [r.p1, r.p50, r.p90, r.p100] == [v[max(1, -(-p * len(v) // 100)) - 1] for p in (1, 50, 90, 100)]
        assert r.middle == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_a_tree_is_listed_in_the_order_of_a_walk(spark, tmp_path):
    import os

    for path in ("b/z.py", "b/a/x.py", "b/a-b/y.py", "a.py", "z.py", "c/deep/er/q.md", "vendor/no.py", "b/dist/no.js", "é/n.py", "b/a/dist/no.js"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "c" / "loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    want = []
    for folder, names, found in os.walk(tmp_path, followlinks=False):
        skip = [d for d in names if d in ("vendor", "dist") or os.path.islink(os.path.join(folder, d))]
        want += sorted(d for d in skip if not os.path.islink(os.path.join(folder, d))) and [os.path.relpath(os.path.join(folder, d), tmp_path) for d in sorted(skip) if d in ("vendor", "dist")]
        want += [os.path.relpath(os.path.join(folder, f), tmp_path) for f in sorted([*found, *(d for d in skip if d not in ("vendor", "dist"))])]
        names[:] = sorted(d for d in names if d not in skip)
    rows = files.listed(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.path for r in rows] == want and {r.kind for r in rows} == {"file", "symlink", "ignored_dir"}
    first = {r.path for r in files.scan(spark, str(tmp_path), max_files=3).filter("skip_reason IS NULL").collect()}
    assert first == {p for p in want if p.endswith((".py", ".md"))} & set([p for p in want if p.endswith((".py", ".md"))][:3])


@pytest.mark.parametrize("segment", [5, 12, 100_000])
def test_batches_of_large_keys(spark, monkeypatch, segment):
    """Whatever the segments, batches are those of one pass over each key's texts."""
    monkeypatch.setattr(prompts, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [(key, (1 << 60) + k, rng.choice([0, 1, 3, 9, 40])) for key, n in (("a", 150), (None, 37), ("b", 1), ("c", 24)) for k in range(n)]
    df = spark.createDataFrame(rows, "who string, id long, cost int").repartition(7)
    got = {(r.who, r.id): r.batch for r in prompts.request_batches(df, "who", "id", "cost", 4, 20).collect()}
    want, state = {}, {}
    for who, k, cost in rows:
        n, used, count = state.get(who, (0, 0, 0))
        if count and (count >= 4 or used + cost > 20):
            n, used, count = n + 1, 0, 0
        state[who] = (n, used + cost, count + 1)
        want[who, k] = n
    assert got == want


def test_jobs_live(spark, tmp_path):
    """A drained stream gives the states of the batch; a job that falls silent is queued by its timer alone, or fails after its last attempt."""
    kinds = ["queued", "claimed", "progress", "failed", "released", "succeeded"]
    rng = random.Random(12)
    rows = [(rng.randrange(12), k, rng.randrange(1000), rng.choice(kinds), rng.choice([None, float(k)])) for k in range(150)]
    rows += [(50, 1000, 1, "claimed", None), *((51, 1001 + k, k, "claimed", None) for k in range(3)), (52, 1010, 1, "succeeded", None)]
    df = spark.createDataFrame(rows, "job long, id long, at long, kind string, value double").withColumn("ts", F.timestamp_seconds("at"))
    for part in (df.filter("id % 2 = 0"), df.filter("id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r.key, []).append(r)

    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = jobs.live_jobs(events, "job", "ts", "id", "kind", "value", stale_seconds=3)
    query = live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="500 milliseconds").start()
    try:
        # A stream with timers never falls idle, so that it is watched.
        want = {r.job: (r.status, r.attempts, r.progress, r.first_ts, r.last_ts) for r in jobs.job_states(df, "job", "ts", "id", "kind", "value").collect()}
        running, until = {k for k, v in want.items() if v[0] == "running"}, time.time() + 90
        while (set(seen) != set(want) or any(not seen[k][-1].stale for k in running)) and query.isActive and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    fresh = {k: next(r for r in reversed(v) if not r.stale) for k, v in seen.items()}
    assert {k: (r.status, r.attempts, r.progress, r.first_ts, r.last_ts) for k, r in fresh.items()} == want
    assert {k for k, v in seen.items() if v[-1].stale} == running
    assert seen[50][-1].status == "queued" and seen[51][-1].status == "failed" and not seen[52][-1].stale
    batch = jobs.requeue_stale(jobs.job_states(df, "job", "ts", "id", "kind", "value"), F.timestamp_seconds(F.lit(10_000)))
    told = jobs.requeue_counts(batch).first()
    assert (told.requeued, told.failed) == (sum(seen[k][-1].status == "queued" for k in running), sum(seen[k][-1].status == "failed" for k in running))
