"""Queries that read files of other tools (written from the driver's tables), migration proofs and live checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import migration as M
from ..operators import series as T
from ..sources import answers, exports
from . import adapters as A
from .redirects import MAP, _MAP_ROWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def as_files(rows: DataFrame, by: str, header: str, line, encoding: str = "UTF-8") -> DataFrame:
    """(file, content): the lines of each value of ``by`` under the header. line: a Column of text, in the order of its own text."""
    body = rows.groupBy(F.col(by).cast("string").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    return body.select("file", F.encode(F.concat(F.lit(header + "\n"), "body"), encoding).alias("content"))


_DAYS = "SELECT event_type AS file, CAST(ts AS DATE) AS date, count(*) AS clicks, count(*) * 1234 AS impressions FROM events GROUP BY ALL"


def dates_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each event type: French headers, semicolons, days first, thin spaces, decimal commas, percent signs, in UTF-16."""
    days = A.load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("t"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    shown = F.regexp_replace(F.format_number(F.col("n") * 1234, 0), ",", " ")
    line = F.concat_ws(";", F.date_format("d", "dd/MM/yyyy"), F.col("n").cast("string"), shown, F.lit("1,5 %"), F.regexp_replace(F.format_string("%.1f", F.col("n") / 10), r"\.", ","))
    return as_files(days.withColumn("line", line), "t", "Jour;Clics;Affichages;CTR moyen;Position moyenne", F.col("line"), "UTF-16")


@query(_DAYS.replace("SELECT event_type", "SELECT 'dates' AS kind, event_type").replace(" FROM events", ", 1.5 AS ctr, round(count(*) / 10, 1) AS position, day(CAST(ts AS DATE)) <= 12 AS ambiguous FROM events"))
def exp_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.performance(dates_export(spark, sf_dir)).select("kind", "file", "date", "clicks", "impressions", "ctr", F.round("position", 1).alias("position"), "ambiguous")


@query(f"SELECT file AS series_id, date AS d, CAST(impressions AS DOUBLE) AS v FROM ({_DAYS}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY date DESC) > 2")
def exp_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trim(exports.metric_series(exports.performance(dates_export(spark, sf_dir)), "impressions"), 2)


def map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.derived(A.load(spark, sf_dir, "pages"), MAP)
    line = F.concat_ws(",", F.concat(F.lit('"'), "source", F.lit('"')), "target", F.when(F.col("code") == 301, "").otherwise(F.col("code").cast("string")), "decision", F.col("value").cast("string"))
    return as_files(m.withColumns({"f": F.lit("map"), "line": line}), "f", "Source,Cible,Code,Decision,Valeur", F.col("line"))


@query(f"WITH m AS ({_MAP_ROWS}) SELECT source, target, CAST(code AS VARCHAR) AS code, decision, value FROM m")
def exp_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.map_rows(map_file(spark, sf_dir)).select("source", "target", "code", "decision", "value")


@query("SELECT o_orderpriority AS type, CAST(o_orderdate AS DATE) AS date, count(*) AS n, o_orderstatus = 'O' AS planned FROM orders GROUP BY ALL")
def exp_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders")
    line = F.concat_ws("\t", F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("site%d", F.col("o_custkey") % 5), "o_orderpriority", F.format_string('"%s, ""%d"""', "o_orderpriority", "o_orderkey"), F.when(F.col("o_orderstatus") == "O", "Prévu").otherwise("done"))
    files = as_files(o.withColumns({"f": F.col("o_custkey") % 3, "line": line}), "f", "Date\tClient\tAction\tNotes\tStatut", F.col("line"))
    return exports.action_log(files).where("description rlike '^[^,]+, \"[0-9]+\"$'").groupBy("type", F.to_date("date").alias("date"), "planned").agg(F.count("*").alias("n"))


_ANSWERS = "CASE WHEN event_id % 4 < 3 THEN 'https://s' || CAST(user_id % 9 AS VARCHAR) || '.com/a' END"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'perplexity' WHEN 2 THEN 'gemini' ELSE 'anthropic' END AS engine, 'Say ' || event_type AS text, CASE WHEN event_id % 4 = 2 THEN 'https://s' || CAST(user_id % 9 AS VARCHAR) || '.com' ELSE 'https://s' || CAST(user_id % 9 AS VARCHAR) || '.com/a' END AS cited, CASE WHEN event_id % 4 IN (0, 3) THEN 'https://c.org/' || event_type ELSE '' END AS consulted, true AS searched FROM events")
def answer_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the answer of an API, its URL cited twice."""
    e = A.load(spark, sf_dir, "events")
    url, text, far = F.format_string("https://s%d.com/a", F.col("user_id") % 9), F.concat(F.lit("Say "), "event_type"), F.concat(F.lit("https://c.org/"), "event_type")
    shapes = {
        "openai": '{"output":[{"type":"web_search_call","action":{"sources":[{"url":"%3$s"},{}]}},{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"%1$s","annotations":[{"type":"url_citation","url":"%2$s"},{"type":"url_citation","url":"%2$s"},{"type":"file","url":"x"}]}]}]}',
        "perplexity": '{"choices":[{"message":{"content":"%1$s"}}],"search_results":[{"url":"%2$s"},{"url":"%2$s"}]}',
        "gemini": '{"candidates":[{"content":{"parts":[{"text":"%1$s"},{}]},"groundingMetadata":{"webSearchQueries":["q"],"groundingChunks":[{"web":{"uri":"https://x.com/grounding-api-redirect/1","title":"S%4$d.com "}},{"web":{"uri":""}}]}}]}',
        "anthropic": '{"content":[{"type":"server_tool_use"},{"type":"web_search_tool_result","content":[{"url":"%3$s"}]},{"type":"text","text":"Say "},{"type":"text","text":"%5$s","citations":[{"url":"%2$s"},{"url":"%2$s"}]}]}',
    }
    names = F.array(*map(F.lit, shapes))
    json = F.when(F.lit(False), "")
    for i, shape in enumerate(shapes.values()):
        json = json.when(F.col("event_id") % 4 == i, F.format_string(shape, text, url, far, F.col("user_id") % 9, F.col("event_type")))
    rows = e.select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("engine"), json.alias("json"))
    return answers.parsed(rows).select("event_id", "engine", "text", F.array_join("cited", " ").alias("cited"), F.array_join("consulted", " ").alias("consulted"), "searched")


_PROOF = f"""WITH m AS ({_MAP_ROWS.replace('SELECT ', 'SELECT page_id, ', 1)}),
t AS (SELECT page_id, source, CASE WHEN decision = 'keep' THEN source WHEN decision <> 'manual' THEN target ELSE 'UNDECIDED' END AS target FROM m),
b AS (SELECT CASE WHEN page_id % 19 = 0 THEN 'MISSING' ELSE target END AS target, page_id % 40 AS clicks FROM t),
a AS (SELECT target, CASE WHEN page_id % 3 = 0 THEN page_id % 30 ELSE 0 END AS old, CASE WHEN page_id % 3 > 0 AND target <> 'UNDECIDED' THEN page_id % 20 ELSE 0 END AS new FROM t WHERE page_id % 19 > 0),
n AS (SELECT target, sum(new) AS after_new FROM a WHERE target <> 'UNDECIDED' GROUP BY 1), o AS (SELECT target, sum(old) AS after_old FROM a GROUP BY 1),
g AS (SELECT target, count(*) AS sources, sum(clicks) AS before FROM b GROUP BY 1),
s AS (SELECT (SELECT sum(clicks) FROM b) AS total, (SELECT sum(old) + sum(new) FROM a) AS now)"""


def _proof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = A.derived(A.load(spark, sf_dir, "pages"), [("page_id", "page_id"), *MAP])
    old = F.concat(F.lit("https://www.old.org"), "source")
    before = m.select(F.when(F.col("page_id") % 19 == 0, F.concat(old, F.lit("/x?y=1"))).otherwise(old).alias("url"), (F.col("page_id") % 40).cast("double").alias("clicks"))
    known = m.where("page_id % 19 > 0")
    stale = known.where("page_id % 3 = 0").select(old.alias("url"), (F.col("page_id") % 30).cast("double").alias("clicks"))
    fresh = known.where("page_id % 3 > 0 and decision <> 'manual'").select(F.concat(F.lit("https://new.org"), "target", F.lit("?s=1")).alias("url"), (F.col("page_id") % 20).cast("double").alias("clicks"))
    return m.drop("page_id"), before, stale.unionByName(fresh)


@query(_PROOF + " SELECT target, sources, CAST(before AS DOUBLE) AS before, CAST(coalesce(after_new, 0) AS DOUBLE) AS after_new, CAST(coalesce(after_old, 0) AS DOUBLE) AS after_old, CAST(before AS DOUBLE) >= greatest(10, 0.01 * total) AND (coalesce(after_new, 0) + coalesce(after_old, 0)) / before < 0.5 * now / total AS lost FROM g LEFT JOIN n USING (target) LEFT JOIN o USING (target), s")
def mig_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.groups(*_proof(spark, sf_dir)).drop("kept")


@query("SELECT 'https://www.old.org/r/' || CAST(page_id AS VARCHAR) || '/x?y=1' AS url, CAST(page_id % 40 AS DOUBLE) AS clicks FROM pages WHERE page_id % 19 = 0 AND page_id % 40 > 0")
def mig_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, before, _ = _proof(spark, sf_dir)
    return M.missing_from_map(m, before)


@query("WITH s AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1) SELECT round(avg(v) FILTER (d < DATE '2024-01-10' AND d >= DATE '2024-01-10' - 28), 4) AS mean_before, round(avg(v) FILTER (d >= DATE '2024-01-10'), 4) AS mean_recent, round(avg(v) FILTER (d >= DATE '2024-01-10') / avg(v) FILTER (d < DATE '2024-01-10'), 6) AS ratio, CAST(date_diff('day', DATE '2024-01-10', max(d)) + 1 AS BIGINT) AS days_after, true AS early FROM s")
def mig_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.load(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("value").alias("v"))
    c = M.curve(days, "2024-01-10")
    return c.select(F.round("mean_before", 4).alias("mean_before"), F.round("mean_recent", 4).alias("mean_recent"), F.round("ratio", 6).alias("ratio"), F.col("days_after").cast("long").alias("days_after"), "early")


#: A checker's hops by the number of a test: what is expected, hops (path and status), the page's own words, verdict.
_TESTS = [
    ("/t", False, [("/s", 301), ("/t", 200)], False, "", "ok"), ("/t", False, [("/s", 200)], False, "", "not_redirected"), ("/t", False, [("/s", 301), ("/t", 404)], False, "", "broken_target"),
    ("/t", False, [("/s", 301), ("/", 200)], False, "", "home_target"), ("/t", False, [("/s", 301), ("/u", 200)], False, "", "wrong_target"), ("/t", False, [("/s", 301), ("/t/", 200)], True, "", "noindex_target"),
    ("/t", False, [("/s", 301), ("/t", 200)], False, "/other", "canonical_elsewhere"), ("/t", False, [("/s", 302), ("/t", 200)], False, "/t", "temporary"), ("/t", False, [("/s", 301), ("/v", 308), ("/t", 200)], False, "", "chain"),
    ("/t", False, [("/s", 301), ("/v", 301), ("/s", 301)], False, "", "loop"), ("", True, [("/s", 410)], False, "", "gone_ok"), ("", True, [("/s", 404)], False, "", "gone_404"), ("", True, [("/s", 200)], False, "", "gone_still_live"),
    ("", True, [("/s", 301), ("/", 200)], False, "", "gone_redirected"), ("/t", False, [("/s", None)], False, "", "error"), ("/s", False, [("/s", 200)], False, "", "ok"),
]


@query(f"WITH v AS (SELECT unnest({[t[5] for t in _TESTS]}) AS verdict, unnest(range({len(_TESTS)})) AS k), s AS (SELECT unnest({list(M.SEVERITY)}) AS verdict, unnest({list(M.SEVERITY.values())}) AS severity) SELECT verdict, severity, count(*) AS n FROM pages JOIN v ON k = page_id % {len(_TESTS)} JOIN s USING (verdict) GROUP BY ALL")
def live_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = "https://www.x.org"
    rows = [(k, site + e if e else "", gone, [(site + p, s) for p, s in hops], no, site + c if c else "") for k, (e, gone, hops, no, c, _) in enumerate(_TESTS)]
    tests = spark.createDataFrame(rows, "k long, expected string, gone boolean, hops array<struct<url:string,status:int>>, noindex boolean, canonical string")
    pages = A.load(spark, sf_dir, "pages").select((F.col("page_id") % len(_TESTS)).alias("k"), F.col("url").alias("source"))
    return M.live_verdicts(pages.join(tests, "k")).groupBy("verdict", "severity").agg(F.count("*").alias("n"))
