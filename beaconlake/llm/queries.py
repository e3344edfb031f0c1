"""The corpus operators as queries over whole tables. Each returns digests; the operators have the texts, spans and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

SQL: dict[str, str] = {}


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), percent=80, k=5)


SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT doc_id, g FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY 1, 2
"""


def op1_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffle_to_shards

    rows = shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, host_quality

    return host_quality(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "n_failed", F.round("host_rate", 6).alias("host_rate"), "host_strict")


SQL["op3_host_quality"] = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w WHERE len(w) > 8),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100)) AS n FROM d),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n FROM c GROUP BY 1),
f AS (SELECT w.doc_id, host, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
k AS (SELECT *, base_failed::INT + (n_symbols * 100 > n_words * 10)::INT + (n_dup_lines * 100 > n_lines * 30)::INT + (word_chars * 2 < n_words * 5 OR word_chars > n_words * 12)::INT AS n_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (n_failed > 0) AS k FROM k GROUP BY 1),
m AS (SELECT sum(k) / sum(n) AS mean, count(*) AS m, sum(n)::DOUBLE AS nn,
    sum(n * (k / n - (SELECT sum(k) / sum(n) FROM h)) ** 2) / nullif(count(*) - 1, 0) AS between_hosts, sum(k * (1 - k / n)) / nullif(sum(n) - count(*), 0) AS within_hosts,
    (sum(n) - sum(n * n)::DOUBLE / sum(n)) / nullif(count(*) - 1, 0) AS size FROM h),
s AS (SELECT mean, CASE WHEN between_hosts > within_hosts THEN least(greatest(size * within_hosts / (between_hosts - within_hosts), 1), 1000) ELSE 1000 END AS strength FROM m),
r AS (SELECT host, n, (k + mean * strength) / (n + strength) AS rate, mean, strength FROM h, s),
j AS (SELECT host, rate, n >= 5 AND rate - mean > 0.2533471031357998 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS strict FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (NOT strict OR n_failed = 0) AS kept, n_failed, round(rate, 6) AS host_rate, strict AS host_strict
FROM k JOIN j USING (host)
"""


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL["op6_suffix_automaton"] = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
size AS (SELECT DISTINCT least(10, len(w))::BIGINT AS n FROM w WHERE kind = 'b' AND len(w) > 0),
b AS (SELECT DISTINCT id, least(10, len(w))::BIGINT AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM w WHERE kind = 'b' AND len(w) > 0),
d AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, size WHERE kind = 'd' AND len(w) >= n),
h AS (SELECT d.id, d.i, d.n, b.id AS item FROM d JOIN b ON d.g = b.g AND d.n = b.n),
p AS (SELECT id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
x AS (SELECT id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM h) GROUP BY 1)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (id) LEFT JOIN x USING (id) WHERE kind = 'd'
"""


def op9_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import token_digests
    from .tokens import vocabulary

    return token_digests(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


#: Target weights of the domains (quality, toxic): mostly high and clean.
TARGETS = {"low_clean": 0.1, "low_toxic": 0.02, "high_clean": 0.85, "high_toxic": 0.03}


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import DOMAINS, mix

    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS, carry=["doc_id"])
    return out.select("doc_id", "n_tokens", *(F.round(F.get("posterior", F.lit(d)), 6).alias(f"p_{name}") for d, name in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"), "copies")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.transform("base", lambda x: x["word"])
    base, own = F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"])
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.greatest(best, F.when(F.size("base") > 0, 0.7).otherwise(0.0)).alias("score"))


def op5_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_content import extract

    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import section_counts
    from .tokens import vocabulary

    found = section_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "crossing", F.posexplode("sections").alias("section", "s")).select("doc_id", "section", F.col("s.first").alias("first_char"), F.col("s.chars").alias("n_chars"), F.col("s.tokens").alias("section_tokens"), "n_tokens", "crossing")


def op11_word_id_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(10, 100), min_words=20, seed=2024, n=1, buckets=10_000).select("doc_id", "n_features", "weight", "score", "rank")


SQL["op11_word_id_resampling"] = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
w AS (SELECT kind, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS (SELECT kind, r, unnest(w) AS f FROM w),
n AS (SELECT kind, r, f, count(*) AS n FROM f GROUP BY ALL),
words AS (SELECT f, hex(encode(f)) AS h, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM n GROUP BY 1),
bytes AS (SELECT f, s, t, list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)) AS b FROM words),
hashed AS (SELECT f, s, t, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc.tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
sums AS (SELECT bucket, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM hashed GROUP BY 1),
total AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, total),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM n JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN weights USING (r) WHERE kind = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= drawn THEN k END AS rank FROM scored LEFT JOIN k USING (r)
"""


def op12_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85, k=3)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL["op12_chosen_paths"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT doc_id, g FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b),
c AS (SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id))::BIGINT AS component_id
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY 1, 2)
SELECT *, doc_id = component_id AS kept FROM c
"""


def op13_word_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least=10, top=10)


SQL["op13_word_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 2) // (t.n + 2 * v.v))::BIGINT AS p,
    (1 + 1000000000 * (k.n::HUGEINT + 2) // (v.n + 2 * v.v))::BIGINT AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= 10
"""


_BY_NAME = [op1_hypergeometric_sharding, op2_ngram_jaccard_join, op3_host_quality, op4_license_rules, op5_dom_marginals, op6_suffix_automaton, op7_nearest_toxic, op8_offset_token_counts, op9_sorted_string_tables, op10_soft_mixing, op11_word_id_resampling, op12_chosen_paths, op13_word_divergence]


def queries() -> dict:
    return {f.__name__: f for f in _BY_NAME}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
