"""The queries opN_* over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import conversation_repair, decontaminate, html_text, line_dedup, packing, pii, quality_rules, rule_ensemble, runs, secret_scan, simhash, suffix_dedup, url_filter
from loomwright.llm.common import let, words_of

URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them match an earlier line of the corpus, and which (from 0)."""
    report = line_dedup.line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = rule_ensemble.learn(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    return rule_ensemble.score_quality(documents, ensemble).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_stats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeats"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", pii.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    base = pii.spans_text(F.filter("spans", pii.of_kind(*pii.KINDS)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("has_private"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op11_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(documents, secret_scan.learn(documents))
    counts = [F.size(F.filter("spans", secret_scan.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    base = secret_scan.spans_text(F.filter("spans", secret_scan.of_kind(*secret_scan.KINDS)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def unrolled(doc_id: Column, text: Column) -> Column:
    """text; in one of ten documents its words from some place on repeat with a period, by the crc32 of the id. Words are then joined by one space."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words_of(text), rewritten)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", unrolled(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find_runs(documents)
    best = runs.longest(F.col("runs"))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(damaged, F.col("live")).select("conv_id", *conversation_repair.COUNTS, "cost", "audit", "repaired_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_rule_ensemble, op3_simhash, op4_quality_rules, op5_packing, op6_html_text, op7_suffix_dedup, op8_pii, op9_url_filter, op10_decontaminate, op11_secret_crf, op12_runs, op13_conversation_repair)}


_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Lower-cases A-Z alone.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT r, i AS p, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - p, 5))) AS n_repeat FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM hit) GROUP BY r),
s AS (SELECT d.r, doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(t) - length(replace(t, '!', '')) AS n_excl, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat, 0) AS n_repeat
      FROM d LEFT JOIN rep USING (r)),
v AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup, n_words < 10 OR 100 * n_repeat > 20 * n_words AS failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
       n_repeat::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT (failed OR 2 * n_symbols > n_words OR 2 * n_excl > n_words OR 2 * n_upper > length(t) OR 2 * n_dup > len(lines) OR word_chars > 40 * n_words) AS kept
FROM v
"""

OP9_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, {_LOW.format("split_part(rest, '/', 1)")} AS host, CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM p),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}) AS t(verdict, h, s)),
best AS (SELECT page_id, host, path, max(length(h || s) * 1000 + length(h)) AS longest FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, h || s AS rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN best USING (page_id, host, path)
LEFT JOIN rules ON length(h || s) * 1000 + length(h) = longest AND (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, s)
"""

OP10_SQL = rf"""
WITH item AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, spot.n, item_id FROM spot JOIN win ON spot.g = win.g AND spot.n = win.n),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN listed USING (r)
"""


#: The checksum of a string of ASCII characters.
_CRC = """(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::BIGINT)), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT))"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w0, {_CRC.format("doc_id::VARCHAR")} AS h FROM documents),
m AS (SELECT r, doc_id, w0, len(w0) AS n, coalesce(h % 10 = 0 AND len(w0) > 0, false) AS hit, h // 10 AS g FROM d),
v AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM m),
q AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM v),
t AS (SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END AS w FROM q),
six AS (SELECT r, i, hash(array_to_string(w[i + 1 : i + 6], ' ')) AS g FROM (SELECT r, w, unnest(range(n - 5)) AS i FROM t WHERE n >= 12)),
met AS (SELECT x.r, x.i, y.i - x.i AS period FROM six x JOIN six y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
isle AS (SELECT r, period, min(i) AS start, count(*) + 5 + period AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, period ORDER BY i) AS k FROM met) GROUP BY r, period, k),
long_ AS (SELECT * FROM isle WHERE length >= greatest(12, 2 * period)),
run AS (SELECT * FROM long_ x WHERE NOT EXISTS (SELECT 1 FROM long_ y WHERE y.r = x.r AND y.period < x.period AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
gone AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(range(start + period, start + length)) AS k FROM run)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS c FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS k FROM t) z WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = z.r AND gone.k = z.k) GROUP BY r),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM run GROUP BY r),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE k <> 0),
o AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM e),
f AS (SELECT *, count(*) OVER (PARTITION BY conv) AS n, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
-- Costs to go, audits and texts (reversed lists) from the end: with nothing yet (z), after system (s), user (u), assistant (a).
w AS (SELECT conv, n AS i, {{c: 0, s: '', t: NULL::VARCHAR}} AS z, {{c: 4, s: 'II', t: 'user:' || chr(10) || 'assistant:'}} AS s,
             {{c: 2, s: 'I', t: 'assistant:'}} AS u, {{c: 0, s: '', t: NULL::VARCHAR}} AS a FROM (SELECT DISTINCT conv, n FROM f)
      UNION ALL
      SELECT conv, i, list_min([z0, {{c: u1.c + 2, s: 'I' || u1.s, t: concat_ws(chr(10), 'user:', u1.t)}}]), list_min([s0, {{c: u1.c + 2, s: 'I' || u1.s, t: concat_ws(chr(10), 'user:', u1.t)}}]), u1, a1
      FROM (SELECT *, list_min([u0, {{c: a0.c + 2, s: 'I' || a0.s, t: concat_ws(chr(10), 'assistant:', a0.t)}}]) AS u1, list_min([a0, {{c: u0.c + 2, s: 'I' || u0.s, t: concat_ws(chr(10), 'user:', u0.t)}}]) AS a1
            FROM (SELECT conv, w.i - 1 AS i,
                list_min(list_concat([{{c: z.c + 3, s: 'D' || z.s, t: z.t}}], CASE WHEN ok THEN [{{c: u.c + 2 + late, s: 'R' || u.s, t: concat_ws(chr(10), 'user:' || text, u.t)}}] ELSE [] END,
                    CASE WHEN ok AND r = 's' THEN [{{c: s.c + late, s: 'K' || s.s, t: concat_ws(chr(10), x, s.t)}}] WHEN ok AND r = 'u' THEN [{{c: u.c + late, s: 'K' || u.s, t: concat_ws(chr(10), x, u.t)}}] ELSE [] END)) AS z0,
                list_min(list_concat([{{c: s.c + 3, s: 'D' || s.s, t: s.t}}], CASE WHEN ok THEN [{{c: u.c + 2 + late, s: 'R' || u.s, t: concat_ws(chr(10), 'user:' || text, u.t)}}] ELSE [] END,
                    CASE WHEN ok AND r = 'u' THEN [{{c: u.c + late, s: 'K' || u.s, t: concat_ws(chr(10), x, u.t)}}] ELSE [] END)) AS s0,
                list_min(list_concat([{{c: u.c + 3, s: 'D' || u.s, t: u.t}}], CASE WHEN ok THEN [{{c: a.c + 2 + late, s: 'R' || a.s, t: concat_ws(chr(10), 'assistant:' || text, a.t)}}] ELSE [] END,
                    CASE WHEN ok AND r = 'a' THEN [{{c: a.c + late, s: 'K' || a.s, t: concat_ws(chr(10), x, a.t)}}] ELSE [] END)) AS u0,
                list_min(list_concat([{{c: a.c + 3, s: 'D' || a.s, t: a.t}}], CASE WHEN ok THEN [{{c: u.c + 2 + late, s: 'R' || u.s, t: concat_ws(chr(10), 'user:' || text, u.t)}}] ELSE [] END,
                    CASE WHEN ok AND r = 'u' THEN [{{c: u.c + late, s: 'K' || u.s, t: concat_ws(chr(10), x, u.t)}}] ELSE [] END)) AS a0
              FROM w JOIN (SELECT conv, i, text, role || ':' || text AS x, left(role, 1) AS r, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM f) g USING (conv, i))))
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.s, '') AS audit, sha256(coalesce(z.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) k LEFT JOIN c USING (conv) LEFT JOIN (SELECT * FROM w WHERE i = 0) b USING (conv)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op9_url_filter": OP9_SQL, "op10_decontaminate": OP10_SQL, "op12_runs": OP12_SQL, "op13_conversation_repair": OP13_SQL}
