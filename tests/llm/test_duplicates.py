"""Line deduplication, SimHash, repeated byte strings and benchmark passages, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import decontaminate, entry, line_dedup, simhash, suffix_dedup, suffix_order
from loomwright.llm.common import utf8

from . import fixtures


def order(row):
    return (row[0] is None, row[0] if row[0] is not None else 0)


def brute_lines(rows):
    """Removed lines by (doc_id, text)."""
    documents = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: order(d))
    seen, out = [], {}
    for key in documents:
        removed = []
        for k, line in enumerate(key[1].split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if s:
                if any(5 * len(s & e) >= 4 * len(s | e) for e in seen):
                    removed.append(k)
                seen.append(s)
        out[key] = removed
    return out


def unique_ids(rows):
    """Rows of one id with different texts are ordered by a hash, which brute force does not know."""
    have, out = {}, []
    for r in rows:
        if have.setdefault(r[0], r[1]) == r[1]:
            out.append(r)
    return out


def test_lines_are_removed_as_by_brute_force(spark):
    rows = unique_ids(fixtures.rows())
    want = brute_lines(rows)
    df = fixtures.documents(spark, rows)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for g in got:
        old = by_id[g.doc_id][1]
        lines = (old or "").split("\n")
        gone = set(want[(g.doc_id, old or "")])
        assert g.text == (None if old is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert any(want.values())


@pytest.mark.parametrize(("crowded", "large"), [(0, 6), (0, 10_000), (126, 6), (126, 0)])
def test_lines_of_all_sizes_meet_by_short_prefixes(spark, monkeypatch, crowded, large):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(line_dedup, "LARGE", large)
    random.seed(7)
    rows = []
    for k in range(60):
        line = random.sample([f"w{i}" for i in range(120)], random.choice([4, 5, 6, 9, 10, 30, 80]))
        near = [line[: len(line) - cut] + [f"x{k}-{i}" for i in range(new)] for cut, new in ((0, 1), (1, 0), (len(line) // 9, len(line) // 9), (len(line) // 5, 0), (0, len(line) // 4), (len(line) // 6, len(line) // 6))]
        rows += [(random.randrange(10**9), " ".join(random.sample(x, len(x)))) for x in (line, *near)]
    want = {i: removed for (i, _), removed in brute_lines(rows).items()}
    got = {r.doc_id: r.removed for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 100 < sum(map(len, want.values())) < len(rows)


def test_lines_of_repeated_ids_empty_and_clashing_tables(spark):
    df = fixtures.documents(spark).withColumns({"_h": F.lit(1), "s": F.lit(2), "w": F.lit(3), "_kept": F.lit(4)})
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert line_dedup.dedup_lines(fixtures.empty(spark)).count() == 0


def test_short_lines_are_removed_too(spark, tmp_path):
    texts = ["Home\n\nAbout us\none two three four", "Home\n\nus  About us\nfour three two one more", "Home page\n \nAbout them\none two three", "no no no no no no\nAbout\tus\nHome", "no\nHome\none two three four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in entry.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0,2,3", 2: "", 3: "1,2", 4: "0,1,2"}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, str(tmp_path)).collect()}
    assert kept == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in got[k].split(",")) for k, t in enumerate(texts)}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], f"{p:016x}", name[find(i)]) for i, (r, p) in enumerate(zip(rows, prints, strict=True))), len(least)


def brute_like(rows):
    """The rows that stay of groups whose sets of five-word shingles have a similarity of 0.8 or more."""
    words = [(r[1] or "").lower().encode().split() for r in rows]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0, i)
        least[find(i)] = min(least.get(find(i), k), k)
    return Counter((rows[k[2]][0], rows[k[2]][1]) for k in least.values())


def check_kept(got, rows):
    """All that brute force keeps is kept, and of what it removes little: a line more in a short text can turn too many bits."""
    want = brute_like(rows)
    assert not want - got and sum((got - want).values()) <= 0.1 * (len(rows) - sum(want.values()))


def test_near_copies_are_removed_and_others_stay(spark):
    """Copies with a few words changed, of each a family of five: nine of ten go at least, and nothing else does."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = fixtures.words(rng, rng.randint(60, 300), 5000).split()
        rows.append((k, " ".join(words), "en", "s0", 1))
        for _ in range(4 if k % 2 else 0):
            near = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 55)):
                near[at] = f"x{rng.randrange(5000)}"
            rows.append((1000 + len(rows), " ".join(near), "en", "s0", 1))
    assert len(rows) - sum(brute_like(rows).values()) > 80
    check_kept(Counter((r.doc_id, r.text) for r in simhash.keep_first(fixtures.documents(spark, rows).repartition(4)).collect()), rows)


def test_a_group_of_one_fingerprint_loses_no_link(spark):
    """Texts of the same words in other orders share all fingerprints; the one near copy among them lies beyond the members that each is held against."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    orders = [rng.sample(words, 60) for _ in range(9)]
    near = [*orders[1][:-2], orders[1][-1], orders[1][-2]]
    rows = [(k, " ".join(w), "en", "s0", 1) for k, w in enumerate([*orders, near])]
    want = brute_like(rows)
    assert sum(want.values()) == 9
    assert Counter((r.doc_id, r.text) for r in simhash.keep_first(fixtures.documents(spark, rows).coalesce(1)).collect()) == want


@pytest.mark.parametrize("frequent", [None, 1, 9])
def test_near_copies_are_removed_as_by_brute_force(spark, monkeypatch, frequent):
    """Families of near copies, a passage of many texts, lines added to short texts: every link counts, in any order of the shingles."""
    if frequent:
        monkeypatch.setattr(simhash, "COUNTED", 1)
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
    rng = random.Random(13)
    passage, rows = fixtures.words(rng, 40, 5000), fixtures.rows()
    for k in range(30):
        words = fixtures.words(rng, rng.randint(20, 120), 5000).split()
        rows.append((1000 + len(rows), " ".join(words) + (f" {passage}" if k % 2 else ""), "en", "s0", 1))
        for _ in range(k % 5):
            near = list(words)
            near[rng.randrange(len(near))] = f"x{rng.randrange(5000)}"
            rows.append((1000 + len(rows), " ".join(near) + (f" {passage}" if k % 2 else ""), "en", "s0", 1))
    got = simhash.keep_first(fixtures.documents(spark, rows).repartition(4))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_like(rows)


def test_simhash_components(spark):
    rng = random.Random(4)
    rows = fixtures.rows() + [(100 + k, " ".join(fixtures.rows()[9][1].split()[: -k or None]), "en", "s0", 1) for k in range(8)]
    rows += [(200 + k, fixtures.words(rng, 2), "en", "s0", 1) for k in range(40)]
    want, _ = brute_components(rows)
    df = fixtures.documents(spark, rows)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("f"), "component")
    assert Counter((r.doc_id, r.f, r.component) for r in got.collect()) == want
    kept = simhash.keep_first(df.withColumns({"_key": F.lit(1), "_held": F.lit(2)}))
    assert kept.columns == [*df.columns, "_key", "_held"]
    check_kept(Counter((r.doc_id, r.text) for r in kept.collect()), rows)
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0 and simhash.keep_first(fixtures.empty(spark)).count() == 0


def test_simhash_chains_are_followed(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102)}


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(min_size=0, max_size=120), st.tuples(st.binary(min_size=1, max_size=6), st.integers(1, 30)).map(lambda x: x[0] * x[1])))
def test_suffix_order(text):
    assert suffix_order.suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_order_with_queues_on_disk(monkeypatch):
    monkeypatch.setattr(suffix_order, "MEMORY_ITEMS", 40)
    monkeypatch.setattr(suffix_order, "BATCH", 7)
    text = bytes(random.Random(5).choice(b"abc") for _ in range(1500)) * 2
    assert suffix_order.suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_bytes(rows, span):
    texts = [(r[1] or "").encode() for r in rows]
    starts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if starts[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("span", "gram", "bound", "hot", "shard"), [(400, 64, None, None, None), (30, 8, None, None, 100), (30, 8, 0, 2, 500), (30, 8, None, 1, 0)])
def test_repeated_bytes(spark, monkeypatch, span, gram, bound, hot, shard):
    for name, value in (("BROADCAST_ANCHORS", bound), ("HOT_CONTEXTS", hot), ("SHARD_BYTES", shard)):
        if value is not None:
            monkeypatch.setattr(suffix_dedup, name, value)
    rows = [*fixtures.rows(), (500, "z" * 900, "en", "s0", 1), (501, "ab" * 500 + "z" * 50, "en", "s0", 1)]
    df = fixtures.documents(spark, rows).withColumns({"_g": F.lit(1), "anchor": F.lit(2)})
    out = suffix_dedup.remove_repeats(df, span=span, gram=gram)
    got = out.select("doc_id", "n_bytes", suffix_dedup.removed_bytes(F.col("spans")).alias("n"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h"))
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, span)


def test_a_partition_of_many_shards_keeps_its_memory():
    """A partition of eight times the shard size and more is sorted a shard at a time, with the peak of a single shard."""
    import tracemalloc

    rng, peaks = random.Random(6), []
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for n in (40, 640):
        rows = [bytes(rng.choices(b"abcdefgh", k=700)) for _ in range(n)]
        table = pa.table({"anchor": pa.array([k // 4 for k in range(n)], pa.int64()), "a": pa.array(range(n), pa.int64()), "b": pa.array(range(n), pa.int64()), "n": pa.array([1] * n, pa.int64()), "bytes": pa.array([rows[k // 2] + bytes([k % 2]) for k in range(n)], pa.binary())})
        tracemalloc.start()
        found = sum(b.num_rows for shard in suffix_dedup.shards(iter(table.to_batches(max_chunksize=16)), 25_000) for b in suffix_dedup._sorted_shard(shard, 400, kind))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == n
    assert peaks[1] < 2 * peaks[0]


def test_repeated_bytes_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(fixtures.empty(spark)).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    fold = lambda t: WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w = fold(text)
    hit, listed = set(), set()
    for item, t in items:
        v = fold(t)
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                listed.add(str(item))
    return len(w), len(hit), sorted(listed), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark):
    rng = random.Random(8)
    rows = fixtures.rows()
    long_ = (rows[24][1] or "").split()
    items = [(1, " ".join(rows[5][1].split()[:20])), (2, " ".join(long_[2:15])), (3, "W7X, w8x"), (4, ""), (5, None), (6, rows[30][1]), (6, rows[30][1]), (7, " ".join(long_[2:14])), (8, fixtures.words(rng, 40)), (10, "a"), (11, "same " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = fixtures.documents(spark)
    for block in (decontaminate.BLOCK_BYTES, 200):
        for r in decontaminate.contamination(df, bench, block_bytes=block).collect():
            assert (r.n_words, r.n_hit, r.hit_items, r.contaminated) == brute_hits(r.text, [x for x in items if x[1] is not None]), r.text
    clash = df.withColumns({"n_words": F.lit("x"), "hit_items": F.lit(1)})
    kept = decontaminate.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and kept.count() == sum(not brute_hits(r[1], items)[3] for r in rows)
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(fixtures.empty(spark), bench).count() == 0


def test_items_without_an_id_hit_and_are_not_listed(spark, tmp_path):
    import duckdb

    words = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join(words[:20])), (2, " ".join(words[20:])), (3, "short item"), (4, None)]
    items = [(None, " ".join(words[2:18])), (None, "short item"), (7, " ".join(words[19:36])), (8, " ".join(words[2:18]) + " more"), (9, None), (None, None)]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in entry.op10_decontaminate(spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert got == sorted(con.execute(entry.OP10_SQL).fetchall())
    assert [r[5] for r in got] == [True, True, True, False]
    in_blocks = decontaminate.contamination(df, benchmark, block_bytes=100).select("doc_id", "n_hit").collect()
    assert sorted(tuple(r) for r in in_blocks) == [(r[0], r[2]) for r in got]


def test_repeated_words_are_found_in_linear_time():
    rng = random.Random(21)
    words = lambda *texts: decontaminate.Words(*utf8(pa.array(texts, pa.large_string())))
    for _ in range(150):
        made = lambda n: " ".join(x for _ in range(n) for x in ([f"w{rng.randrange(3)}"] * rng.choice([1, 1, 30])))
        items = [made(rng.randint(0, 25)) for _ in range(2)]
        docs = [f"{made(8)} {rng.choice(items)} {made(8)}" for _ in range(2)]
        got = [(set(), set()) for _ in docs]
        for doc, start, end, item in decontaminate.BenchmarkIndex(["0", "1"], items).hits(words(*docs)):
            got[doc][0].update(range(start, end))
            got[doc][1].add(item)
        for doc, found in zip(docs, got):
            w, hit, listed = doc.split(), set(), set()
            for k, item in enumerate(items):
                v = item.split()
                n = min(13, len(v))
                windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit.update(range(i, i + n))
                        listed.add(k)
            assert found == (hit, listed)
    began = time.process_time()
    assert [h[1:3] for h in decontaminate.BenchmarkIndex(["0"], ["same " * 5_000]).hits(words("same " * 5_000))] == [(0, 5_000)]
    assert time.process_time() - began < 2
