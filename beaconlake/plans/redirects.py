"""Queries of redirect maps. Old and new addresses come from the ids of pages, so the SQL knows the way that must find each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks as S
from ..operators import redirects as R
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}

_N = "CAST(page_id AS STRING)"
_KIND = "CASE WHEN page_id % 8 = 7 AND page_id % 16 = 7 THEN 8 ELSE page_id % 8 END"
#: (old, new, method, decision) by kind; 6 and 8 have no page of their own.
_WAYS = [
    ("'/shop/item-a' || N", "'/shop/item-a' || N", "exact", "keep"),
    ("'/Shop/Case-b' || N || '/'", "'/shop/case-b' || N", "case", "keep"),
    ("'/news/story-c' || N", "'/journal/story-c' || N", "pattern", "redirect"),
    ("'/2019/05/07/dated-d' || N || '.html'", "'/dated-d' || N", "pattern", "redirect"),
    ("'/old/deep/slug-e' || N || '.php'", "'/guides/x/slug-e' || N", "slug", "redirect"),
    ("'/lost/f' || N", "'/titles/page-f' || N", "title", "redirect"),
    ("'/shop/gone-g' || N", "'/shop'", "parent", "review"),
    ("'/zone/close-match-number-h' || N", "'/zz/close-match-numbers-h' || N", "slug-close", "review"),
    ("'/void/i' || N", None, None, None),
]


def _by_kind(values: list[str | None]) -> str:
    return f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {v.replace('N', _N)}" for k, v in enumerate(values) if v) + " END"


OLD, NEW = _by_kind([w[0] for w in _WAYS]), _by_kind([w[1] for w in _WAYS])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def inventories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = A.load(spark, sf_dir, "pages")
    rows = pages.selectExpr(f"{OLD} AS old", f"{NEW} AS new", f"CASE WHEN page_id % 8 = 5 THEN 'Títle F' || {_N} END AS title")
    return R.inventory(rows.select(F.col("old").alias("url"), "title")), R.inventory(rows.select(F.col("new").alias("url"), "title"))


_METHOD = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN '{w[2]}'" for k, w in enumerate(_WAYS) if w[2]) + " END"
_DECISION = f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN '{w[3]}'" for k, w in enumerate(_WAYS) if w[3]) + " ELSE CASE WHEN page_id % 5 > 0 THEN 'manual' ELSE 'gone' END END"
_KNOWN = f"SELECT lower(regexp_replace({OLD}, '/$', '')) AS key, {NEW} AS target, {_METHOD} AS method, {_DECISION} AS decision, page_id % 5 AS value FROM pages"


@query("SELECT 'news' AS a, 'journal' AS b, count(*) AS n FROM pages WHERE page_id % 8 = 2 HAVING count(*) >= 3")
def red_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.learn_swaps(*inventories(spark, sf_dir))


@query(f"SELECT key, target, method FROM ({_KNOWN})")
def red_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match(*inventories(spark, sf_dir)).select("key", "target", "method")


@query(f"SELECT decision, coalesce(method, 'none') AS method, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM ({_KNOWN}) GROUP BY 1, 2")
def red_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.match(*inventories(spark, sf_dir)).withColumn("value", F.regexp_extract("key", r"(\d+)(?:\.\w+)?$", 1).cast("long") % 5)
    decided = found.withColumn("decision", R.decision(F.col("method"), F.col("confidence"), F.col("value"), F.lit(True)))
    return decided.groupBy("decision", F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


#: Runs of ten that end at three pages; in every fifth run the end leads back.
MAP = [
    (f"'/r/' || {_N}", "source"),
    (f"CASE WHEN page_id % 50 = 30 THEN '/r/' || CAST(page_id + 5 AS STRING) WHEN page_id % 20 = 10 THEN '/' WHEN page_id % 10 = 0 THEN '/final/' || CAST(page_id % 3 AS STRING) ELSE '/r/' || CAST(page_id - 1 AS STRING) END", "target"),
    ("CASE WHEN page_id % 11 = 0 THEN 302 ELSE 301 END", "code"),
    ("CASE WHEN page_id % 13 = 0 THEN 'manual' WHEN page_id % 17 = 0 THEN 'review' ELSE 'redirect' END", "decision"),
    ("CAST(page_id % 5 AS DOUBLE)", "value"),
]
_WALK = f"""WITH RECURSIVE m AS ({A.sql(MAP, 'pages')}), s(source, target, spot, hops, seen, looped) AS (
  SELECT source, target, target, 0, [source], false FROM m UNION ALL
  SELECT s.source, s.target, m.target, s.hops + 1, list_append(s.seen, s.spot), list_contains(list_append(s.seen, s.spot), m.target) FROM s JOIN m ON m.source = s.spot WHERE NOT s.looped),
e AS (SELECT source, max(hops) AS hops, bool_or(looped) AS looped, arg_max(spot, hops) AS spot, any_value(target) AS target FROM s GROUP BY source),
w AS (SELECT source, target, looped OR hops > 10 AS looped, hops, CASE WHEN looped OR hops > 10 THEN target ELSE spot END AS final FROM e)
"""


@query(_WALK + "SELECT source, target, looped, CASE WHEN looped THEN 0 ELSE hops END AS hops, final FROM w")
def red_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = R.walk(A.derived(A.load(spark, sf_dir, "pages"), MAP))
    return walked.select("source", "target", "looped", F.when(F.col("looped"), 0).otherwise(F.col("hops")).cast("long").alias("hops"), "final")


@query(_WALK + """, x AS (SELECT w.*, code, decision, value FROM w JOIN m USING (source)), t AS (SELECT final, count(*) AS n, (SELECT count(*) FROM x) AS every FROM x GROUP BY final),
i AS (SELECT 'undecided' AS type, CASE WHEN decision = 'manual' AND value > 0 THEN 'high' ELSE 'medium' END AS severity, value FROM x WHERE decision <> 'redirect'
UNION ALL SELECT 'temporary_code', 'medium', value FROM x WHERE code = 302
UNION ALL SELECT 'loop', 'high', value FROM x WHERE looped
UNION ALL SELECT 'chain', CASE WHEN hops = 1 THEN 'medium' ELSE 'high' END, value FROM x WHERE NOT looped AND hops > 0
UNION ALL SELECT 'target_missing', 'high', value FROM x WHERE final NOT IN ('/', '/final/0', '/final/1')
UNION ALL SELECT 'home_target', CASE WHEN n >= 10 OR n / every > 0.05 THEN 'high' ELSE 'medium' END, n FROM t WHERE final = '/'
UNION ALL SELECT 'concentration', 'medium', n FROM t WHERE final <> '/' AND (n >= 20 OR n >= 10 AND n / every > 0.1))
SELECT type, severity, count(*) AS n, sum(value) AS value FROM i GROUP BY 1, 2""")
def red_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = R.inventory(spark.createDataFrame([("/",), ("/final/0",), ("/final/1",)], "url string"))
    issues = R.lint(A.derived(A.load(spark, sf_dir, "pages"), MAP), there)
    return issues.groupBy("type", "severity").agg(F.count("*").alias("n"), F.sum("value").alias("value"))



@query(f"""WITH k AS (SELECT page_id, {OLD} AS old, {NEW} AS new, {_METHOD} AS method FROM pages), m AS (SELECT *, page_id % 8 = 0 AS numbered FROM k)
SELECT old || CASE WHEN numbered THEN '?p=' || {_N} ELSE '' END AS source, CASE WHEN numbered OR method IS NULL THEN '' ELSE 'https://new.org' || new END AS target,
CASE WHEN NOT numbered AND method IS NULL AND page_id % 5 = 0 THEN '410' ELSE '301' END AS code, CASE WHEN numbered THEN 'none' ELSE coalesce(method, 'none') END AS method,
CASE WHEN numbered THEN 'manual' WHEN method IS NULL THEN CASE WHEN page_id % 5 > 0 THEN 'manual' ELSE 'gone' END WHEN method IN ('parent', 'slug-close') THEN 'review' ELSE 'redirect' END AS decision, CAST(page_id % 5 AS DOUBLE) AS value FROM m""")
def red_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration to another host; the pages that stay in place are named by a number in the old URLs. Value comes in two rows a URL."""
    rows = A.load(spark, sf_dir, "pages").selectExpr("page_id", f"{OLD} AS old", f"{NEW} AS new", f"CASE WHEN page_id % 8 = 5 THEN 'Títle F' || {_N} END AS title")
    old = F.concat(F.lit("https://www.old.org"), "old", F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("?p="), "page_id")).otherwise(""))
    halves = rows.select(old.alias("url"), "title", F.explode(F.array((F.col("page_id") % 5) * 0.25, (F.col("page_id") % 5) * 0.75)).alias("value"))
    new = rows.where("new is not null").select(F.concat(F.lit("https://new.org"), "new").alias("url"), "title")
    return R.build(halves, new).drop("confidence")


@query(f"""WITH p AS (SELECT page_id % 6 AS k, page_id FROM pages), u AS (SELECT k, CASE k WHEN 0 THEN '/wp-admin/x' || {_N} WHEN 1 THEN '/en/en/a' || {_N} WHEN 2 THEN '/pics/' || {_N} || '.png' WHEN 3 THEN '/old/' || {_N} || '.php' WHEN 4 THEN '/moved/thing-' || {_N} ELSE '/void/q' || {_N} END AS path, page_id FROM p)
SELECT CASE k WHEN 0 THEN 'probe' WHEN 1 THEN 'doubled_segment' WHEN 2 THEN 'asset' WHEN 3 THEN CASE WHEN page_id % 4 = 1 THEN 'covered_but_404' ELSE 'probe' END WHEN 4 THEN 'suggested' ELSE 'no_match' END AS status,
CASE WHEN k = 1 THEN '/en/a' || {_N} WHEN k = 3 AND page_id % 4 = 1 THEN '/t/' || {_N} WHEN k = 4 THEN '/shop/thing-' || {_N} ELSE '' END AS target, path, CAST(page_id % 9 AS DOUBLE) AS hits FROM u""")
def red_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.load(spark, sf_dir, "pages")
    rows = p.selectExpr("page_id", "page_id % 6 AS k", f"CASE page_id % 6 WHEN 0 THEN '/wp-admin/x' || {_N} WHEN 1 THEN '/en/en/a' || {_N} WHEN 2 THEN '/pics/' || {_N} || '.png' WHEN 3 THEN '/old/' || {_N} || '.php' WHEN 4 THEN '/moved/thing-' || {_N} ELSE '/void/q' || {_N} END AS url", "CAST(page_id % 9 AS DOUBLE) AS value")
    there = rows.where("k in (1, 4)").selectExpr(f"CASE k WHEN 1 THEN '/en/a' || {_N} ELSE '/shop/thing-' || {_N} END AS url")
    covered = rows.where("k = 3 and page_id % 4 = 1").selectExpr("url AS source", f"'/t/' || {_N} AS target")
    return R.hunt(rows.select("url", "value"), R.inventory(there), covered).drop("method")


_MAP_ROWS = A.sql(MAP, "pages")


@query(f"WITH m AS ({_MAP_ROWS}) SELECT sum(value) AS value, coalesce(sum(value) FILTER (decision IN ('manual', 'review')), 0) AS unresolved FROM m")
def red_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_at_risk(A.derived(A.load(spark, sf_dir, "pages"), MAP))


_EXPORTED = f"(SELECT source, target, CASE WHEN page_id % 7 = 0 THEN '410' ELSE CAST(code AS VARCHAR) END AS code FROM (SELECT page_id, {', '.join(f'{e} AS {n}' for e, n in MAP)} FROM pages) WHERE decision = 'redirect')"
_END = "(code = '410')"


@query(f"""WITH m AS {_EXPORTED}
SELECT 'redirection' AS format, source || ',' || CASE WHEN {_END} THEN '' ELSE target END || ',0,' || code || ',' || CASE WHEN {_END} THEN 'error' ELSE 'url' END AS line FROM m
UNION ALL SELECT 'yoast', source || ',' || CASE WHEN {_END} THEN '' ELSE target END || ',' || code || ',plain' FROM m
UNION ALL SELECT 'rankmath', ',' || trim(source, '/') || ',exact,' || target || ',' || code || ',,active,' FROM m
UNION ALL SELECT 'seopress', ltrim(source, '/') || ',' || CASE WHEN {_END} THEN '' ELSE 'https://w.org' || target END || ',' || code || ',yes,exact_match,,,,both' FROM m
UNION ALL SELECT 'generic', source || ',' || target || ',' || code FROM m
UNION ALL SELECT 'htaccess', CASE WHEN {_END} THEN 'RedirectMatch 410 ^' || source || '/?$' ELSE 'RedirectMatch ' || code || ' ^' || source || '/?$ ' || target END FROM m
UNION ALL SELECT 'nginx', source || ' ' || target || ';' FROM m WHERE NOT {_END} UNION ALL SELECT 'nginx', source || '/ ' || target || ';' FROM m WHERE NOT {_END} UNION ALL SELECT 'nginx', '#   ' || source FROM m WHERE {_END}
UNION ALL SELECT f, l FROM (VALUES ('redirection', 'source,target,regex,code,type'), ('yoast', 'Origin,Target,Type,Format'), ('rankmath', 'id,source,matching,destination,type,category,status,ignore'), ('generic', 'source,target,code'), ('htaccess', '<IfModule mod_alias.c>'), ('htaccess', '</IfModule>'), ('nginx', '# 410 candidates (location = /path {{ return 410; }}):')) h(f, l)""")
def exp_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.derived(A.load(spark, sf_dir, "pages"), [("page_id", "page_id"), *MAP]).withColumn("code", F.when(F.col("page_id") % 7 == 0, "410").otherwise(F.col("code").cast("string")))
    out = [S.redirect_lines(rows, f, host="https://w.org").select(F.lit(f).alias("format"), "line") for f in S.FORMATS]
    return reduce(DataFrame.unionByName, out)
