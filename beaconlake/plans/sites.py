"""Queries of sites: which paths robots.txt closes to whom, and what changed between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import access as X
from ..operators import pages as P
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}

AGENTS = ["GPTBot", "ClaudeBot", "CCBot", "Googlebot", "PerplexityBot"]
ROBOTS = "Disallow: /before\nUser-agent: GPTBot\nUser-agent: ClaudeBot # two agents\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n\nUser-agent: CCBot\nDisallow: /\nUser-agent: Googlebot\nDisallow:\n\nUser-agent: *\nDisallow: /de\nAllow: /de/2"
#: The same as rules: agent, allow, pattern, expression.
_RULES = [
    *((a, *r) for a in AGENTS[:2] for r in ((False, "/en/", "^/en/"), (True, "/en/1", "^/en/1"), (False, "/*.html$", "^/.*[.]html$"))),
    ("CCBot", False, "/", "^/"), ("PerplexityBot", False, "/de", "^/de"), ("PerplexityBot", True, "/de/2", "^/de/2"),
]
_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '^www[.]', '')"
_PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_ACCESS = f"""WITH a AS (SELECT unnest({AGENTS}) AS agent), r(agent, allow, pattern, expression) AS (VALUES {', '.join(f"('{a}', {w}, '{p}', '{e}')" for a, w, p, e in _RULES)}),
c AS (SELECT page_id, {_HOST} AS host, agent, {_PATH} AS path FROM pages, a),
b AS (SELECT page_id, host, c.agent, coalesce(arg_max(allow, 2 * length(pattern) + allow::INT), true) AS allowed, arg_max(pattern, 2 * length(pattern) + allow::INT) AS pattern FROM c LEFT JOIN r ON r.agent = c.agent AND regexp_matches(path, expression) GROUP BY ALL)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = A.load(spark, sf_dir, "pages").select("page_id", W.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path"))
    files = paths.select("host").distinct().withColumn("text", F.lit(ROBOTS))
    return X.access(paths, X.robots_rules(files), AGENTS)


@query(_ACCESS + "SELECT page_id, agent, allowed, pattern FROM b")
def acc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_path(spark, sf_dir).select("page_id", "agent", "allowed", "pattern")


@query(_ACCESS + ", g AS (SELECT host, agent, count(*) AS paths, count(*) FILTER (NOT allowed) AS blocked FROM b GROUP BY 1, 2) SELECT *, CASE WHEN blocked = 0 THEN 'open' WHEN blocked = paths THEN 'closed' ELSE 'partial' END AS state FROM g")
def acc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.matrix(by_path(spark, sf_dir))


_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'New ' ELSE '' END || {_TITLE} AS title, page_id % 11 = 0 AS noindex, CASE WHEN page_id % 11 = 0 THEN 'noindex, follow' ELSE '' END AS robots, '' AS description, 'https://c.org/' || CAST(page_id AS VARCHAR) AS canonical, 'Article' AS schema_types, 'de,fr' AS hreflang FROM pages")
def page_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages with a canonical link, a schema and languages put into their heads."""
    head = F.format_string("<link href='https://c.org/%d' rel=\"canonical\"><link rel=alternate hreflang='fr' href=x><link rel=alternate hreflang=\"de\" href=y><script type='application/ld+json'>{\"@type\": \"Article\"}</script></head>", "page_id")
    pages = _changed(A.load(spark, sf_dir, "pages")).withColumn("html", F.replace("html", F.lit("</head>"), head))
    return P.snapshot(pages).select("page_id", "title", "noindex", "robots", "description", "canonical", F.array_join("schema_types", ",").alias("schema_types"), F.array_join("hreflang", ",").alias("hreflang"))


def _changed(pages: DataFrame) -> DataFrame:
    """The pages with a noindex in every eleventh and another title in every seventh."""
    n = F.col("page_id")
    marked = F.when(n % 11 == 0, F.regexp_replace("html", "(?i)</title>", "</title><meta content='NoIndex, follow' name=\"robots\">")).otherwise(F.col("html"))
    return pages.withColumn("html", F.when(n % 7 == 0, F.regexp_replace(marked, "(?i)<title>", "<title>New ")).otherwise(marked))


_ISSUES = "SELECT url, i AS issue, CASE i WHEN 'became_noindex' THEN 'high' WHEN 'not_in_after' THEN 'medium' ELSE 'low' END AS severity FROM (SELECT url, unnest(CASE WHEN page_id % 13 = 0 THEN ['not_in_after'] ELSE list_concat(CASE WHEN page_id % 11 = 0 THEN ['became_noindex'] ELSE [] END, CASE WHEN page_id % 7 = 0 THEN ['title_changed'] ELSE [] END) END) AS i FROM pages)"


@query(_ISSUES)
def page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.load(spark, sf_dir, "pages")
    return P.diff(P.snapshot(pages), P.snapshot(_changed(pages.where("page_id % 13 <> 0"))), "page_id").drop("page_id")


@query(f"WITH i AS ({_ISSUES}) SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE page_id % 7 > 0 AND page_id % 11 > 0 AND page_id % 13 > 0) AS identical FROM i")
def page_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.load(spark, sf_dir, "pages")
    before, after = P.snapshot(pages), P.snapshot(_changed(pages.where("page_id % 13 <> 0")))
    return P.summary(before, after, P.diff(before, after, "page_id"), "page_id")


_CHANGE = "CASE page_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'noindex' WHEN 2 THEN 'focus_keyword' WHEN 3 THEN 'canonical' ELSE 'title' END"


@query(f"SELECT field, verdict, count(*) AS n FROM (SELECT {_CHANGE} AS field, CASE WHEN page_id % 13 = 0 THEN 'not_read' WHEN page_id % 5 = 2 THEN 'not_rendered' WHEN page_id % 5 = 3 THEN 'mismatch' WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 11 = 0 THEN 'ok' ELSE 'mismatch' END WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 7 = 0 THEN 'ok' ELSE 'mismatch' END ELSE 'ok' END AS verdict FROM pages) GROUP BY ALL")
def page_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes wanted of the pages that ``_changed`` changed: a title that begins with New, noindex, a canonical that none has, a template of variables only."""
    pages = A.load(spark, sf_dir, "pages").withColumn("url", F.format_string("https://w.org/p/%d", "page_id"))
    value = F.expr("CASE page_id % 5 WHEN 0 THEN 'NEW %%title%% | ' WHEN 1 THEN 'yes' WHEN 2 THEN 'word' WHEN 3 THEN 'https://c.org/x' ELSE '%%title%% %%sep%% ' END")
    changes = pages.select("url", F.expr(_CHANGE).alias("field"), value.alias("value"))
    return P.verify(changes, P.snapshot(_changed(pages.where("page_id % 13 <> 0")))).groupBy("field", "verdict").agg(F.count("*").alias("n"))


@query("SELECT 'rankmath' AS plugin, 'rest' AS way, count(*) AS n, count(DISTINCT page_id) AS bodies FROM pages UNION ALL SELECT 'yoast', CASE WHEN page_id % 5 IN (0, 2, 4) THEN 'rest' ELSE 'cli' END, count(*), count(DISTINCT page_id) FROM pages GROUP BY ALL UNION ALL SELECT 'aioseo', CASE WHEN page_id % 5 = 2 THEN 'manual' ELSE 'rest' END, count(*), count(DISTINCT CASE WHEN page_id % 5 = 2 THEN -1 WHEN page_id % 5 = 1 THEN -2 ELSE page_id END) FROM pages GROUP BY ALL UNION ALL SELECT 'seopress', CASE WHEN page_id % 5 = 2 THEN 'cli' ELSE 'rest' END, count(*), count(DISTINCT CASE WHEN page_id % 5 = 1 THEN -2 ELSE page_id END) FROM pages GROUP BY ALL")
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.load(spark, sf_dir, "pages").withColumn("url", F.format_string("https://w.org/p/%d", "page_id"))
    value = F.when(F.col("page_id") % 5 == 1, "yes").otherwise(F.format_string('It\'s "%d"', "page_id"))
    changes = pages.select("url", F.expr(_CHANGE).alias("field"), value.alias("value"))
    known = P.snapshot(pages).withColumns({"post_id": F.col("page_id").cast("string"), "rest_route": F.lit("posts")})
    out = [P.plan(changes, known, p).select(F.lit(p).alias("plugin"), "way", "body") for p in P.STORED]
    return reduce(DataFrame.unionByName, out).groupBy("plugin", "way").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))


@query("SELECT page_id, '%title% %sep% ' || CAST(page_id AS VARCHAR) || ' %sitename% %%nothing%%' AS rankmath, '#post_title #separator_sa ' || CAST(page_id AS VARCHAR) || ' #site_title %%nothing%%' AS aioseo FROM pages")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.format_string("%%%%title%%%% %%%%sep%%%% %d %%%%sitename%%%% %%%%nothing%%%%", "page_id")
    return A.load(spark, sf_dir, "pages").select("page_id", P.translated(t, "yoast", "rankmath").alias("rankmath"), P.translated(t, "yoast", "aioseo").alias("aioseo"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'yoast' WHEN 1 THEN 'aioseo,rankmath' WHEN 2 THEN 'seopress' ELSE '' END AS plugins, CASE page_id % 4 WHEN 0 THEN '22.' || CAST(page_id % 9 AS VARCHAR) WHEN 1 THEN '4.9' END AS version, page_id % 4 = 0 AS premium FROM pages")
def page_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    mark = F.when(n % 4 == 0, F.concat(F.lit("<!-- This site is optimized with the Yoast SEO Premium plugin v22."), (n % 9).cast("string"), F.lit(" -->"))).when(n % 4 == 1, '<!-- Search Engine Optimization by Rank Math --><!-- All in One SEO 4.9 - aioseo.com -->').otherwise("")
    pages = A.load(spark, sf_dir, "pages").select("page_id", "url", F.concat(mark, "html").alias("html"), F.when(n % 4 == 2, F.array(F.lit("wp/v2"), F.lit("seopress/v1"))).alias("ns"))
    return P.plugins(pages, "ns").select("page_id", F.array_join("plugins", ",").alias("plugins"), "version", "premium")


LLMS = "# Site\n\n> About it\n\n## Pages\n- [One](https://%s/en/1): first\n- [Two](https://other.org/x)\n* [Cart](/cart/)\n- [One](https://%s/en/1)\n\n# Again"


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = A.load(spark, sf_dir, "pages").select(W.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path")).where("host <> ''")
    hosts = paths.select("host").distinct()
    files = hosts.withColumn("text", F.lit(ROBOTS))
    sample = paths.unionByName(hosts.withColumn("path", F.explode(F.array(*map(F.lit, ["/", *X._SHOP]))))).distinct()
    rules = X.robots_rules(files)
    llms = hosts.where("length(host) % 2 = 0").select("host", F.replace(F.lit(LLMS), F.lit("%s"), F.col("host")).alias("text"))
    return X.audit(X.access(sample, rules, X.TOKENS), rules, files, llms, shop=True)


@query(f"""WITH h AS (SELECT {_HOST} AS host, {_PATH} AS path FROM pages), s AS (SELECT host, bool_or(starts_with(path, '/de') AND NOT starts_with(path, '/de/2')) AS refused FROM h GROUP BY 1), e AS (SELECT * FROM s WHERE length(host) % 2 = 0),
c AS (SELECT 'low' AS severity, 'search_paths_refused' AS type, 6 AS count FROM s WHERE refused UNION ALL SELECT 'medium', 'transactional_open', 21 FROM s UNION ALL SELECT 'low', 'rules_outside_group', 1 FROM s
UNION ALL SELECT 'medium', 'llms_format', 1 FROM e UNION ALL SELECT 'high', 'llms_offhost', 1 FROM e UNION ALL SELECT 'medium', 'llms_transactional', 1 FROM e UNION ALL SELECT 'low', 'llms_duplicates', 1 FROM e UNION ALL SELECT 'info', 'llms_absent', 1 FROM s WHERE length(host) % 2 = 1)
SELECT severity, type, CAST(sum(count) AS BIGINT) AS count, count(*) AS hosts FROM c GROUP BY ALL""")
def acc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).groupBy("severity", "type").agg(F.sum("count").alias("count"), F.count("*").alias("hosts"))


@query(f"WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), p AS (SELECT unnest({list(X.PRESETS)}) AS preset) SELECT preset, count(*) * {len(X.TOKENS)} AS rows, 0 AS wrong FROM h, p GROUP BY preset")
def acc_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies written for every host by each preset, read back: how many agents aren't where the policy wants them."""
    hosts = A.load(spark, sf_dir, "pages").select(W.host_of(F.col("url")).alias("host")).distinct()
    keep = X.robots_rules(hosts.withColumn("text", F.lit("User-agent: Googlebot\nDisallow: /private\n\nUser-agent: *\nDisallow: /tmp/")))
    out = [X.proven(X.policy(hosts, p, True, keep), p).select(F.lit(p).alias("preset"), (F.col("wanted") != F.col("allowed")).alias("wrong")) for p in X.PRESETS]
    return reduce(DataFrame.unionByName, out).groupBy("preset").agg(F.count("*").alias("rows"), F.count_if("wrong").alias("wrong"))


@query("WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN '/llms.txt' WHEN event_id % 3 = 1 THEN '/robots.txt' ELSE '.md' END AS file, CASE event_id % 4 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'Perplexity-User' WHEN 2 THEN 'other bot' ELSE 'browser or unknown' END AS who FROM events) SELECT file, who, count(*) AS requests FROM r GROUP BY ALL")
def acc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.load(spark, sf_dir, "events")
    url = F.when(F.col("event_id") % 3 == 0, "/llms.txt?a=1").when(F.col("event_id") % 3 == 1, "/robots.txt").otherwise("/docs/x.md")
    agent = F.get(F.array(*map(F.lit, ["Mozilla/5.0 (compatible; GPTBot/1.2)", "Perplexity-User/1.0", "some-spider/2", "Mozilla/5.0 Firefox"])), (F.col("event_id") % 4).cast("int"))
    return X.file_requests(e.select(F.concat(F.lit('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET '), url, F.lit(' HTTP/1.1" 200 5 "-" "'), agent, F.lit('"')).alias("line")))


@query(f"""WITH p AS (SELECT DISTINCT 'https://www.shop.org' || {_PATH} AS url, {_PATH} AS path FROM pages), f AS (SELECT url FROM p WHERE NOT (starts_with(path, '/de') AND NOT starts_with(path, '/de/2'))),
r AS (SELECT url, row_number() OVER (ORDER BY length(url) DESC, url) AS k FROM f WHERE url <> 'https://www.shop.org/key') SELECT '- [The key](https://www.shop.org/key)' AS line UNION ALL SELECT '# Shop' UNION ALL SELECT '> Sells' UNION ALL SELECT '## Key pages' UNION ALL SELECT '## Pages' UNION ALL SELECT '- [T ' || CAST(length(url) AS VARCHAR) || '](' || url || ')' FROM r WHERE k <= 19""")
def acc_llms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An llms.txt of twenty pages: one key page, then the longest URLs; carts, other hosts and what robots.txt closes are left out."""
    url = F.concat(F.lit("https://www.shop.org"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1))
    pages = A.load(spark, sf_dir, "pages").select(url.alias("url"), F.format_string("T %d", F.length(url)).alias("title"), F.length(url).cast("double").alias("value"))
    more = spark.createDataFrame([("https://www.shop.org/cart/x", "no", 1e9), ("https://other.org/y", "no", 1e9), ("https://www.shop.org/a?add-to-cart=1", "no", 1e9)], "url string, title string, value double")
    key = spark.createDataFrame([(0, "https://www.shop.org/key", "The key"), (1, "https://www.shop.org/checkout/", "no")], "at int, url string, title string")
    rules = X.robots_rules(spark.createDataFrame([("www.shop.org", ROBOTS)], "host string, text string"))
    return X.llms_text(X.curated(pages.unionByName(more), "www.shop.org", rules, key, 20), "Shop", "Sells").select("line")
