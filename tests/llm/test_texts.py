"""HTML extraction, personal data, packing and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomwright.llm import decontaminate, html_text, line_dedup, packing, pii, quality_rules, rule_ensemble, simhash, suffix_dedup, url_filter

from . import fixtures

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><!-- <p>no</p> --><article><h1>A  title</h1><p>First &amp; foremost&#33;<p>Second <b>bold</b>\n text<br>goes on</p><aside>Related things to read</aside><ul><li>one item</li></ul></article><footer>&copy; x</footer>", "A title\nFirst & foremost!\nSecond bold text goes on\none item"),
    ("<body><div class='cookie-notice'>We use cookies here and there.</div><main><p>Body text that is long enough to be read as a text of a page.</p><form>Name <input> <button>Send</button></form></main><section id=comments><p>Nice article, thanks a lot for it.</p></section></body>", "Body text that is long enough to be read as a text of a page."),
    ("<article><p>Before</p><script>var a = '</p><p>no</p>';</script><div class=\"ad\">Buy now</div><p>After</article>", "Before\nAfter"),
    (None, ""),
    ("", ""),
    ("<p", ""),
    ("<!-- never closed <p>x</p>", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(k, "u", p) for k, (p, _) in enumerate([*PAGES, *PAGES])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df.withColumn("_tree", F.lit(1))).collect()}
    assert [got[k] for k in range(2 * len(PAGES))] == [t for _, t in PAGES] * 2
    assert html_text.extract_text(df.limit(0)).count() == 0


WRAPPED = [
    ("<html><head><title>x</title><body><article><p>Text of the article.</p></article>", "Text of the article."),
    ("<html><head><title>x</title><meta charset=utf-8><article><p>Text of the article.</p></article>", "Text of the article."),
    ("<head><title>x</title>Plain words that follow a head without its end tag and go on for a while.", "Plain words that follow a head without its end tag and go on for a while."),
    ("<body><div class='layout with-sidebar'><article><p>Text of the article.</p><div class=ad>Buy now</div></article><div class=sidebar><p>Other things</p></div></div>", "Text of the article."),
    ("<body><div class=has-banner><main><div id=nav-page><article><h1>T</h1><p>Text of the article.</p></article></div></main></div>", "T\nText of the article."),
    ("<body><div class=has-banner><article><p>Text of the article that is longer.</p></article></div><div id=comments><article class=comment><p>Nice article, thanks a lot for all of it, really.</p></article></div>", "Text of the article that is longer."),
    ("<body><div class=with-sidebar><p>" + "words of a page that marks no article " * 8 + "</p><div class=sidebar>Read also this one</div></div>", ("words of a page that marks no article " * 8).strip()),
]


def test_open_heads_and_hinted_wrappers(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(WRAPPED)], "page_id long, html string")
    assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == {k: t for k, (_, t) in enumerate(WRAPPED)}


def test_words_and_densities_decide_where_names_tell_nothing():
    words = lambda n, w: " ".join([w] * n)
    page = f"<body><div class=x1><div><a>Home</a></div><div><a>About us</a></div></div><div class=x2><h2>The title of it</h2><div>{words(60, 'first')}</div><div>{words(45, 'second')} <a>link here</a></div><div>{words(8, 'third')}</div><div>{words(50, 'last')}</div></div><div><a>Other story here now</a></div><div><a>Third story of these</a></div><div>Copyright 2020 us</div></body>"
    tree = html_text.learned_tree(html_text.LABELLED)
    assert [x.split()[0] for x in html_text.main_text(page, tree).split("\n")] == ["The", "first", "second", "third", "last"]
    # A tree that sees neither words nor densities cannot tell the menu from the text.
    pages = [html_text.blocks(html_text.labelled_page(x)) for x in html_text.LABELLED]
    blind = lambda found: html_text.features(found) * [f not in html_text.FEATURES[:6] for f in html_text.FEATURES]
    tree = html_text.grow(np.vstack([blind(p) for p in pages]), np.array([b.text.startswith("+") for p in pages for b in p], float))
    found = html_text.blocks(page)
    assert len({html_text.classify(tree, row) for b, row in zip(found, blind(found), strict=True) if not b.heading}) == 1
    # Labelled pages are told apart as they are labelled, but for a few blocks.
    tree = html_text.learned_tree(html_text.LABELLED)
    wrong = sum(html_text.classify(tree, row) != b.text.startswith("+") for p in pages for b, row in zip(p, html_text.features(p), strict=True))
    assert wrong <= 0.05 * sum(map(len, pages))


def test_deep_nesting_takes_linear_time():
    tree = html_text.learned_tree(html_text.LABELLED)
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        html_text.main_text("<div class=menu>x<b>" * n + "</i></div>" * n, tree)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html_text.entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def brute_entities(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PERSONAL = ["mail a.b+c@x-y.example.com or x@y", "ip 1.2.3.4, 256.1.1.1, 001.002.003.004, 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111", "call +1 (415) 555-0132 or +49.30.123456 or +1 2", "漢🙂 jane@example.org 漢 4539578763621486", None, "", "0" * 5000]


def test_entities_are_those_of_the_patterns(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*PERSONAL, *PERSONAL])], "doc_id long, text string").withColumn("_key", F.lit(1))
    got = pii.protect(df).collect()
    assert len(got) == 2 * len(PERSONAL)
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind in pii.KINDS] == brute_entities(r.text or ""), r.text
    assert pii.protect(df.limit(0)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    texts = [f"the report of Quillfeather names jane@example.org among others {k}" for k in range(3)] + [f"the report of somebody names nobody among others {k}" for k in range(60)]
    texts += [f"the report of others {k} names k{k}@example.org" for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        marked = {r.text[s.start : s.end] for s in r.spans if s.kind == pii.TERM}
        assert marked == ({"Quillfeather"} if "jane" in r.text else set())
        if "jane" in r.text:
            assert "[EMAIL]" in r.sanitised and "[TERM]" in r.sanitised and "jane" not in r.sanitised
    copies = spark.createDataFrame([(k, texts[0]) for k in range(5)] + [(k + 9, t) for k, t in enumerate(texts[3:])], "doc_id long, text string")
    assert pii.protect(copies).filter(F.exists("spans", lambda s: s["kind"] == pii.TERM)).count() == 0  # one text alone shows nothing


def test_terms_far_from_their_entity(spark):
    far = " ".join(["filler words that stand between"] * 8)
    texts = [f"Quillfeather wrote this. {far} {k} jane@example.org" for k in range(3)] + ["jane@example.org is Quillfeather", f"jane@example.org {far} {far} alone"]
    texts += [f"somebody wrote this. {far} is {k}" for k in range(60)] + [f"{far} k{k}@example.org" for k in range(6)]
    for r in pii.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        marked = {r.text[s.start : s.end] for s in r.spans if s.kind == pii.TERM}
        assert marked == ({"Quillfeather"} if "Quillfeather" in r.text else set())


def test_secrets_and_the_measure(spark):
    key = "ab12" * 10
    cases = {f'token = "{key[:-4]}9f3c"': 1, f"api_key: {key[:-4]}zz81": 1, 'name = "abcdefghijklmnopqrstuvwxyz"': 0, "id = 1234567890123456789": 0, "see: https://example.org/a1b2c3d4e5f6g7h8": 0, f"= {key}": 0, "x = aaaaaaaaaaaaaaaa1": 0}
    for text, n in cases.items():
        assert sum(k == pii.SECRET for k, _, _ in pii.entities(text)) == n, text
    # The measure over whole documents, by brute force.
    rng = random.Random(3)
    people = [f"p{k}@example.org" for k in range(6)]
    texts = []
    for k in range(150):
        words = [f"w{rng.randrange(60)}q" for _ in range(12)]
        if rng.random() < 0.5:
            who = rng.randrange(6)
            words += [people[who], *([f"alias{who}"] if rng.random() < 0.8 else []), *([f"alias{(who + 1) % 6}"] if rng.random() < 0.2 else [])]
            rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20]
    held = [({w.strip(pii.PUNCTUATION) for w in t.split() if len(w.strip(pii.PUNCTUATION)) > 1}, {w for w in t.split() if "@" in w}) for t in texts]
    n, n_kind = len(texts), sum(bool(e) for _, e in held)
    want = set()
    for term in set().union(*(w for w, _ in held)):
        for who in people:
            both = [t for t, (w, e) in zip(texts, held, strict=True) if term in w and who in e]
            n_term, n_entity = sum(term in w for w, _ in held), sum(who in e for _, e in held)
            if len(set(both)) >= pii.LEAST_TEXTS and len(both) >= pii.LEAST_SHARE * n_term and np.log2(n * len(both) / (n_term * n_entity)) > np.log2(n / n_kind):
                want.add((term, who))
    assert {t for t, _ in want if t.startswith("alias")}
    for r in pii.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words, people_ = held[r.doc_id]
        assert {r.text[s.start : s.end] for s in r.spans if s.kind == pii.TERM} == {t for t, who in want if who in people_ and t in words and "@" not in t}


def check_packing(pieces, ids_of):
    """Every id in one piece, sequences without holes and no padding, but for lengths that are powers of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        want = Counter()
        for ids in ids_of[doc]:
            want[len(ids)] += len(ids)
        got = Counter()
        for p in parts:
            got[p.doc_tokens] += p.length
            assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in ids_of[doc])
        assert got == want
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


@pytest.mark.parametrize("lane", [packing.LANE_TOKENS, 3000])
def test_packing(spark, lane):
    rows = fixtures.rows() + [(900, "a  b \n c <|endoftext|> d  ", "en", "s1", 1), (901, "  ", "en", None, 1), (902, "x\n\n\ny 漢字  🙂 it's we'll", "en", "s3", 1)]
    t = Tokenizer.from_file(TOKENIZER)
    ids_of = defaultdict(list)
    for r in rows:
        ids_of[r[0]].append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    df = fixtures.documents(spark, rows).withColumn("lane", F.lit(1))
    check_packing(packing.pack(df, TOKENIZER, lane_tokens=lane).collect(), ids_of)
    check_packing(packing.pack(df, TOKENIZER, lane_tokens=lane, targets={"s0": 0.9, "s9": 0.1}).collect(), ids_of)
    assert packing.pack(fixtures.empty(spark), TOKENIZER).count() == 0


def test_every_window_has_the_mixture(spark):
    """Twenty sources of about a twentieth each, over the given tables: every whole window holds each source's share."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held, total = defaultdict(Counter), Counter()
    for p in packing.pack(df, TOKENIZER, lane_tokens=100_000).collect():
        held[p.sequence_id][p.source] += p.length
        total[p.source] += p.length
    n = sum(total.values())
    far = [sum(abs(got[s] / 2048 - total[s] / n) for s in total) / 2 for got in held.values() if sum(got.values()) == 2048]
    assert len(total) == 20 and len(far) == n // 2048
    assert sum(far) / len(far) < 0.02


def test_windows_keep_the_mixture():
    queues = {"a": [(0, 0, 60_000)], "b": [(1, 0, 500)] * 80}
    found = packing.fill(queues, {"a": 0.6, "b": 0.4}, 0, packing.Places(100_000, 2048), 256)
    held = Counter()
    for doc, _, n, sequence, _ in found:
        if doc == 0:
            held[sequence] += n
    assert all(abs(held[k] - 0.6 * 2048) <= 2 for k in range(100_000 // 2048))


def test_pipeline_applies_every_stage(spark, tmp_path):
    rows = [r for r in fixtures.rows() if r[0] is not None]
    fixtures.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(rows[9][1].split()[:14])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        assert seen[-1].columns == docs.columns and seen[-1].schema == docs.schema
        seen[-1].write.parquet(f"{tmp_path}/stage{k}")
        seen[-1] = spark.read.parquet(f"{tmp_path}/stage{k}")
    from .test_duplicates import brute_hits, check_kept
    from .test_filters import brute_quality

    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert key(seen[1]) == Counter((r[0], r[1]) for r in rows if brute_quality(r[1])[-1])
    check_kept(key(seen[3]), [tuple(r) for r in seen[2].collect()])
    assert key(seen[4]) == Counter((r.doc_id, r.text) for r in seen[3].collect() if not brute_hits(r.text, [(1, item)])[3])
    t = Tokenizer.from_file(TOKENIZER)
    ids_of = defaultdict(list)
    for r in seen[4].collect():
        ids_of[r.doc_id].append([*t.encode(r.text, add_special_tokens=False).ids, 1])
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), ids_of)


def test_pipeline_takes_nulls_empty_tables_and_further_columns(spark, tmp_path):
    item = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for name, rows in (("nulls", fixtures.rows()), ("empty", [])):
        more = spark.createDataFrame(rows, fixtures.SCHEMA).withColumns({"n_words": F.lit(1), "KEPT": F.lit("k"), "f": F.lit(2)})
        more.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        item.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == more.columns
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {p.doc_id for p in packed} == {r.doc_id for r in docs.collect()} and bool(packed) == bool(rows)


def test_operators_refuse_clashes_whatever_the_case(spark):
    df = fixtures.documents(spark)
    bench = df.select(F.col("doc_id").alias("item_id"), "text")
    page = spark.createDataFrame([(1, "https://a.com/", "<p>x")], "page_id long, url string, html string")
    calls = {
        "Spans": [lambda d: pii.protect(d), lambda d: suffix_dedup.remove_repeats(d)],
        "N_Words": [lambda d: decontaminate.contamination(d, bench), lambda d: quality_rules.quality_stats(d)],
        "KEPT": [lambda d: quality_rules.quality_stats(d), lambda d: suffix_dedup.remove_repeats(d)],
        "Score": [lambda d: rule_ensemble.score_quality(d, rule_ensemble.RuleEnsemble(0.0))],
        "Fingerprint": [lambda d: simhash.with_fingerprints(d)],
    }
    for name, several in calls.items():
        for call in several:
            with pytest.raises(ValueError, match="already has a column"):
                call(df.withColumn(name, F.lit(1)))
    for name in ("Host", "path", "RULE", "verdict"):
        with pytest.raises(ValueError, match="already has a column"):
            url_filter.judge_urls(page.withColumn(name, F.lit(1)), [])
    with pytest.raises(ValueError, match="already has a column"):
        html_text.extract_text(page.withColumn("Text", F.lit(1)))
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]
    assert simhash.RADIUS == 2 and line_dedup.SIMILAR == (4, 5) and quality_rules.WINDOW == 5
