"""Queries of crawler forensics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import web
from ..operators import logs
from ..sinks import packed_files
from ..sources.logs import parse_combined, parse_delimited, parse_json, parse_logs, spread
from ..sources.packed import packed_lines
from ..storage import scratch, stored
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _case(field: int) -> str:
    ordered = sorted(dims.BOTS, key=lambda b: -len(b[0]))
    return "CASE " + " ".join(f"WHEN contains(lower(agent), '{b[0]}') THEN '{b[field]}'" for b in ordered) + " END"


_FORGED = "(upper(method) IN ('POST', 'PUT', 'DELETE', 'PATCH') OR " + " OR ".join(f"lower(split_part(url, '?', 1)) = '{p}' OR starts_with(lower(split_part(url, '?', 1)), '{p}/') OR starts_with(lower(split_part(url, '?', 1)), '{p}.')" for p in dims.FORGERY_PATHS) + ")"
_NUMBER = "list_sum(list_transform(string_split(ip, '.'), lambda x, i: CAST(x AS BIGINT) * CAST(256 ** (4 - i) AS BIGINT)))"
_CIDR = "(VALUES " + ", ".join(f"('{r}', {a}, {b})" for r, a, b in [(r, *A.bounds(n, k)) for r, n, k in A.CIDR]) + ") cidr(ranges, lo, hi)"
#: hit: parsed lines; v: crawler hits with their verdict.
CTE = f"""WITH hit AS (SELECT * FROM ({A.sql(A.HIT, 'events')}) WHERE NOT broken),
c AS (SELECT *, {_case(1)} AS bot, {_case(2)} AS provider, {_case(3)} AS purpose, {_case(4)} AS ranges, {_NUMBER} AS n FROM hit),
v AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM {_CIDR} WHERE cidr.ranges = c.ranges AND c.n BETWEEN lo AND hi) THEN 'verified' WHEN {_FORGED} THEN 'spoofed' ELSE 'unverifiable' END AS verdict FROM c WHERE bot IS NOT NULL),
r AS (SELECT * FROM v WHERE verdict <> 'spoofed'),
ai AS (SELECT * FROM r WHERE purpose IN ('training', 'user_fetch', 'search'))
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_combined(A.log_lines(spark, sf_dir))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.verify(logs.classify(parsed(spark, sf_dir).where("parsed")), A.cidr(spark))


@query(f"SELECT event_id, ip, ts, method, url, CAST(status AS INTEGER) AS status, bytes, agent, CAST(rt AS DOUBLE) AS rt_ms FROM ({A.sql(A.HIT, 'events')}) WHERE NOT broken")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).where("parsed").select("event_id", "ip", F.col("ts"), "method", "url", "status", "bytes", "agent", F.round("rt_ms", 3).alias("rt_ms"))


@query(
    f"""SELECT ip, ts, method, url, CAST(status AS INTEGER) AS status, bytes, agent, CAST(rt AS DOUBLE) AS rt_ms, count(*) AS lines
FROM ({A.sql(A.HIT, 'events')}) WHERE NOT broken GROUP BY ALL"""
)
def log_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_parse over gzip, bzip2, xz and plain files whose names say nothing, read in ranges of 16 kB."""
    lines, path = A.log_lines(spark, sf_dir), scratch(spark, "packed")
    for i, packing in enumerate(("gzip", "bzip2", "xz", "plain")):
        packed_files(lines.where(F.pmod("event_id", F.lit(4)) == i), path, packing, member_bytes=20_000).write.format("noop").mode("overwrite").save()
    found = parse_combined(packed_lines(spark, path, block_bytes=1 << 14)).where("parsed")
    fields = ["ip", "ts", "method", "url", "status", "bytes", "agent", F.round("rt_ms", 3).alias("rt_ms")]
    return found.select(*fields).groupBy("ip", "ts", "method", "url", "status", "bytes", "agent", "rt_ms").agg(F.count("*").alias("lines"))


#: The dialects of log_dialects: what an event is written as, by its number modulo 4, and the packing.
_DIALECTS = {
    0: ("bzip2", ",", "Date,Adresse IP,Chemin,Navigateur,Statut,Taille", ["ts", "ip", "url", "agent", "status", "bytes"]),
    1: ("xz", "\t", "visitor_ip\tUser Agent\tmethod\turl\ttime\tduration", ["ip", "agent", "method", "url", "ts", "rt"]),
    2: ("gzip", "|", '"page"|"code"|"ua"|"timestamp"|"x"|"remote_addr"', ["url", "status", "agent", "ts", "rt", "ip"]),
}


@query(
    f"""SELECT format, ip, ts, url, status, bytes, agent, count(*) AS lines FROM (
SELECT CASE event_id % 4 WHEN 3 THEN 'json' ELSE 'csv' END AS format, ip, ts, url, agent,
  CAST(CASE event_id % 4 WHEN 1 THEN 0 ELSE status END AS INTEGER) AS status, CASE WHEN event_id % 4 IN (1, 2) THEN 0 ELSE bytes END AS bytes
FROM ({A.sql(A.HIT, 'events')})) GROUP BY ALL"""
)
def log_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files in three delimited dialects and of JSON lines, packed differently; each file's own header says what its columns are."""
    h = A.derived(spread(A.load(spark, sf_dir, "events")), A.HIT).withColumn("dialect", F.pmod("event_id", F.lit(4)))
    path = scratch(spark, "dialects")
    text = {c: F.col(c).cast("string") for c in ("ip", "url", "agent", "status", "bytes", "rt", "method")} | {"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    for i, (packing, sep, header, fields) in _DIALECTS.items():
        rows = h.where(F.col("dialect") == i).select(F.concat_ws(sep, *(text[f] for f in fields)).alias("line"))
        packed_files(rows, path, packing, header=header).write.format("noop").mode("overwrite").save()
    record = F.to_json(F.struct("ip", text["ts"].alias("time"), F.col("url").alias("path"), "status", "bytes", "agent"))
    packed_files(h.where("dialect = 3").select(record.alias("line")), path, "plain").write.format("noop").mode("overwrite").save()
    found = parse_logs(packed_lines(spark, path)).where("parsed")
    return found.groupBy("format", "ip", "ts", "url", "status", "bytes", "agent").agg(F.count("*").alias("lines"))


@query(f"SELECT count(*) AS lines, count(*) FILTER (broken) AS malformed, round(count(*) FILTER (broken) / count(*), 6) AS ratio, count(*) FILTER (broken) / count(*) > 0.2 AS refuse FROM ({A.sql(A.HIT, 'events')})")
def log_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.malformed(parsed(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT event_id, ip, ts, method, url, CAST(status AS INTEGER) AS status, bytes, agent, CAST(CASE WHEN rt > 50 THEN rt ELSE rt * 1000 END AS DOUBLE) AS rt_ms FROM ({A.sql(A.HIT, 'events')})")
def log_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.derived(A.load(spark, sf_dir, "events"), A.HIT)
    record = F.to_json(F.struct(F.col("ip").alias("ClientIP"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("method").alias("ClientRequestMethod"), F.concat_ws(" ", "method", "url", F.lit("HTTP/1.1")).alias("request"), F.col("status").alias("status"), F.col("bytes").alias("size"), F.col("agent").alias("user_agent"), F.col("rt").alias("duration")))
    out = parse_json(h.select("event_id", record.alias("line"))).where("parsed")
    return out.select("event_id", "ip", "ts", "method", "url", "status", "bytes", "agent", F.round("rt_ms", 3).alias("rt_ms"))


@query(f"SELECT event_id, ip, ts, url, CAST(status AS INTEGER) AS status, agent FROM ({A.sql(A.HIT, 'events')})")
def log_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.derived(A.load(spark, sf_dir, "events"), A.HIT)
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "ip", "url", "agent", F.col("status").cast("string"))
    return parse_delimited(h.select("event_id", line.alias("line")), "date\tip\turl\tuser_agent\tstatus").where("parsed").select("event_id", "ip", "ts", "url", "status", "agent")


@query(CTE + "SELECT bot, provider, purpose, count(*) AS claimed, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'spoofed') AS spoofed, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, CAST(coalesce(sum(bytes) FILTER (verdict <> 'spoofed'), 0) AS BIGINT) AS bytes, count(DISTINCT ip) FILTER (verdict <> 'spoofed') AS ips, min(ts) FILTER (verdict <> 'spoofed') AS first_seen, max(ts) FILTER (verdict <> 'spoofed') AS last_seen FROM v GROUP BY ALL")
def log_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bot_buckets(verified(spark, sf_dir))


@query(CTE + "SELECT event_id, bot, verdict FROM v")
def log_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("event_id", "bot", "verdict")


@query(CTE + "SELECT purpose, count(*) AS bots, CAST(sum(k) AS BIGINT) AS claimed, CAST(sum(a) AS BIGINT) AS verified, CAST(sum(s) AS BIGINT) AS spoofed, CAST(sum(u) AS BIGINT) AS unverifiable, string_agg(bot, ',' ORDER BY bot) AS names FROM (SELECT bot, purpose, count(*) AS k, count(*) FILTER (verdict = 'verified') AS a, count(*) FILTER (verdict = 'spoofed') AS s, count(*) FILTER (verdict = 'unverifiable') AS u FROM v GROUP BY ALL) GROUP BY purpose")
def log_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.purposes(logs.bot_buckets(verified(spark, sf_dir)))


_SECTION = "CASE WHEN p = '/' THEN '/ (root)' WHEN length(p) - length(replace(p, '/', '')) = 1 AND contains(p, '.') THEN '/ (root)' ELSE '/' || split_part(p, '/', 2) || '/' END"


@query(CTE + f"SELECT bot, {_SECTION} AS section, count(*) AS hits FROM (SELECT *, split_part(url, '?', 1) AS p FROM r) GROUP BY ALL")
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.histogram(verified(spark, sf_dir), web.section_of(F.col("url")), "section")


@query(CTE + "SELECT bot, CAST(status AS INTEGER) AS status, count(*) AS hits FROM r GROUP BY ALL")
def log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.histogram(verified(spark, sf_dir), F.col("status"), "status")


@query(CTE + "SELECT bot, CAST(ts AS DATE) AS day, count(*) AS hits FROM r GROUP BY ALL")
def log_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.histogram(verified(spark, sf_dir), F.to_date("ts"), "day")


@query(CTE + """, n AS (SELECT bot, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS hits FROM r GROUP BY ALL),
e AS (SELECT bot, CAST(unnest(generate_series((SELECT min(month) FROM n), (SELECT max(month) FROM n), INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT bot FROM n)),
m AS (SELECT bot, month, coalesce(hits, 0) AS hits FROM e LEFT JOIN n USING (bot, month))
SELECT bot, month, hits, before, coalesce(before > 50 AND hits < 0.1 * before, false) AS dropped FROM (SELECT *, lag(hits) OVER (PARTITION BY bot ORDER BY month) AS before FROM m)""")
def log_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.months(verified(spark, sf_dir))


@query(CTE + "SELECT bot, count(*) AS n, round(avg(rt), 3) AS mean_ms, " + ", ".join(f"list_sort(list(CAST(rt AS DOUBLE)))[CAST(least(floor({s} * count(*)), count(*) - 1) AS BIGINT) + 1] AS p{int(s * 100)}" for s in (0.5, 0.9, 0.99)) + " FROM r GROUP BY bot")
def log_response_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.response_times(verified(spark, sf_dir).where("verdict <> 'spoofed'"), "bot")


@query(CTE + "SELECT parameter, count(*) AS hits FROM (SELECT DISTINCT event_id, split_part(unnest(string_split(split_part(url, '?', 2), '&')), '=', 1) AS parameter FROM ai WHERE contains(url, '?')) GROUP BY parameter")
def log_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.query_parameters(logs.ai_hits(verified(spark, sf_dir)))


@query(CTE + "SELECT count(*) AS hits, count(*) FILTER (contains(url, '?')) AS query_hits, count(*) FILTER (regexp_matches(url, '(?i)/(page|p)/[0-9]+|[?&](page|paged|p)=[0-9]+')) AS paginated, count(*) FILTER (status BETWEEN 300 AND 399) AS redirected FROM ai")
def log_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.ai_hits(verified(spark, sf_dir)).agg(F.count("*").alias("hits"), F.count_if(F.col("url").contains("?")).alias("query_hits"), F.count_if(F.col("url").rlike(logs.PAGINATION)).alias("paginated"), F.count_if(F.col("status").between(300, 399)).alias("redirected"))


_SHARE = {"refused": ("status IN (401, 403, 429)", 0.02), "redirected": ("status BETWEEN 300 AND 399", 0.10), "query": ("contains(url, '?')", 0.15), "pagination": ("regexp_matches(url, '(?i)/(page|p)/[0-9]+|[?&](page|paged|p)=[0-9]+')", 0.20)}


@query(CTE + " UNION ALL ".join(f"SELECT bot, '{k}' AS diagnostic, round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS value, CAST({t} AS DOUBLE) AS threshold FROM r GROUP BY bot HAVING avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) > {t}" for k, (c, t) in _SHARE.items()))
def log_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.diagnostics(verified(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(CTE + ", top AS (SELECT bot, url, count(*) AS n FROM r GROUP BY ALL) SELECT bot, rank, url, n FROM (SELECT *, row_number() OVER (PARTITION BY bot ORDER BY n DESC, url) AS rank FROM top) WHERE rank <= 5")
def log_top_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = logs.histogram(verified(spark, sf_dir), F.col("url"), "url")
    return n.selectExpr("bot", "row_number() over (partition by bot order by hits desc, url) as rank", "url", "hits as n").where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


_PATHS = "crawled AS (SELECT DISTINCT CASE WHEN p <> '/' AND ends_with(p, '/') THEN left(p, -1) ELSE p END AS path FROM (SELECT split_part(url, '?', 1) AS p FROM ai)), listed AS (SELECT DISTINCT '/' || event_type || '/' || CAST(event_id % 150 AS STRING) AS path FROM events), cited AS (SELECT DISTINCT '/' || event_type || '/' || CAST(event_id % 200 AS STRING) AS path FROM events WHERE event_id % 3 = 0)"
_MATRIX = CTE + ", " + _PATHS + ", m AS (SELECT path, bool_or(a) AS crawled, bool_or(b) AS listed, bool_or(c) AS cited FROM (SELECT path, true AS a, false AS b, false AS c FROM crawled UNION ALL SELECT path, false, true, false FROM listed UNION ALL SELECT path, false, false, true FROM cited) GROUP BY path) "


def _coverage(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """URLs repeat, so paths are made of the distinct ones. hits: the verified hits, if they are there already."""
    paths = lambda url: url.toDF("url").distinct().select(web.strip_query(F.col("url")).alias("path"))
    events = A.load(spark, sf_dir, "events")
    numbers = lambda rows, n: rows.select("event_type", (F.col("event_id") % n).alias("n")).distinct()
    crawled = logs.ai_hits(verified(spark, sf_dir) if hits is None else hits).select("url")
    listed = numbers(events, 150).select(F.format_string("https://www.example.com/%s/%d", "event_type", "n"))
    cited = numbers(events.where("event_id % 3 = 0"), 200).select(F.format_string("https://example.com/%s/%d#top", "event_type", "n"))
    return logs.coverage(paths(crawled), paths(listed), paths(cited))


@query(_MATRIX + "SELECT crawled, listed, cited, count(*) AS paths FROM m GROUP BY ALL")
def log_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).groupBy("crawled", "listed", "cited").agg(F.count("*").alias("paths"))


@query(_MATRIX + "SELECT path FROM m WHERE listed AND NOT crawled")
def log_sitemap_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).where("listed and not crawled").select("path")


@query(f"SELECT event_id, CASE WHEN lower(agent) LIKE '%mozilla%' AND NOT regexp_matches(lower(agent), '{'|'.join(h.replace('.', '[.]') for h in dims.GENERIC_BOT_HINTS)}') THEN true ELSE false END AS human FROM ({A.sql(A.HIT, 'events')})")
def log_humans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.derived(A.load(spark, sf_dir, "events"), A.HIT).select("event_id", web.looks_human("agent").alias("human"))


@query(CTE + "SELECT window_start, bot, count(*) AS hits FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, bot FROM r) GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: six-hour windows of the hits, the batch form of streaming.logs.windowed."""
    return verified(spark, sf_dir).where("verdict <> 'spoofed'").groupBy(F.window("ts", "6 hours").alias("w"), "bot").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("window_start"), "bot", "hits")


@query("SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 7200000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of a user with gaps of two hours."""
    e = A.load(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query(CTE + "SELECT count(*) AS claimed, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'spoofed') AS spoofed, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, count(*) FILTER (verdict <> 'spoofed' AND purpose IN ('training', 'user_fetch', 'search')) AS counted FROM v")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.totals(verified(spark, sf_dir))


@query(_MATRIX + """, k AS (SELECT count(*) AS hits, count(*) FILTER (purpose = 'user_fetch') AS fetches, count(*) FILTER (status >= 400) / count(*) AS errors FROM ai),
q AS (SELECT count(*) FILTER (verdict = 'verified') / count(*) AS rate FROM v WHERE purpose IN ('training', 'user_fetch', 'search')), cov AS (SELECT count(*) FILTER (listed AND crawled) / count(*) FILTER (listed) AS covered FROM m)
SELECT 'verified_hits' AS kpi, CAST(hits AS DOUBLE) AS value, CASE WHEN hits > 0 THEN 'good' ELSE 'neutral' END AS tone FROM k
UNION ALL SELECT 'verification_rate', round(rate, 6), CASE WHEN rate < 0.6 THEN 'bad' WHEN rate < 0.9 THEN 'warn' ELSE 'good' END FROM q
UNION ALL SELECT 'real_time_fetches', fetches, CASE WHEN fetches > 0 THEN 'good' ELSE 'bad' END FROM k
UNION ALL SELECT 'errors', round(errors, 6), CASE WHEN errors > 0.02 THEN 'bad' ELSE 'good' END FROM k
UNION ALL SELECT 'sitemap_coverage', round(covered, 6), CASE WHEN covered < 0.4 THEN 'bad' ELSE 'good' END FROM cov""")
def log_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stored(verified(spark, sf_dir).select("url", "purpose", "verdict", "status"), "hits")  # lines are parsed once
    return logs.kpis(hits, _coverage(spark, sf_dir, hits)).withColumn("value", F.round("value", 6))


_P50 = "list_sort(list(CAST(rt AS DOUBLE)))[CAST(least(floor(0.5 * count(*)), count(*) - 1) AS BIGINT) + 1]"


@query(CTE + f", b AS (SELECT bot, {_P50} AS p50 FROM r GROUP BY bot), h AS (SELECT {_P50} AS human_p50 FROM c WHERE bot IS NULL AND lower(agent) LIKE '%mozilla%') SELECT bot, p50, human_p50 FROM b, h WHERE p50 > 1400 OR p50 > 2 * human_p50")
def log_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of 1400 ms, since the hits' medians are about 1500."""
    hits = logs.classify(parsed(spark, sf_dir).where("parsed"))
    humans = hits.where(F.col("bot").isNull() & web.looks_human("agent")).withColumn("who", F.lit("human"))
    bots = logs.verify(hits, A.cidr(spark)).where("verdict <> 'spoofed'")
    return logs.slow(logs.response_times(bots, "bot"), logs.response_times(humans, "who"), 1400.0)


@query(CTE + ", l AS (SELECT bot, max(CAST(ts AS DATE)) AS last_seen FROM r WHERE event_id % 3 > 0 OR ts < TIMESTAMP '2024-01-05' GROUP BY bot) SELECT bot, last_seen, date_diff('day', last_seen, (SELECT max(CAST(ts AS DATE)) FROM v)) AS days FROM l WHERE date_diff('day', last_seen, (SELECT max(CAST(ts AS DATE)) FROM v)) > -1")
def log_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each bot was seen (of any number), where a third of its later hits is spoofed."""
    v = verified(spark, sf_dir)
    late = (F.col("event_id") % 3 == 0) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return logs.unseen(v.withColumn("verdict", F.when(late, "spoofed").otherwise(F.col("verdict"))), -1).withColumn("days", F.col("days").cast("long"))


@query(CTE + ", n AS (SELECT parameter, count(*) AS hits FROM (SELECT DISTINCT event_id, split_part(unnest(string_split(split_part(url, '?', 2), '&')), '=', 1) AS parameter FROM ai WHERE contains(url, '?')) GROUP BY parameter) SELECT parameter, hits, round(hits / (SELECT count(*) FROM ai), 6) AS share FROM n WHERE hits / (SELECT count(*) FROM ai) > 0.1")
def log_common_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.common_parameters(logs.ai_hits(verified(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query(CTE + "SELECT url, count(*) AS hits FROM ai WHERE status BETWEEN 300 AND 399 GROUP BY url HAVING count(*) > 1")
def log_redirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.redirected_often(logs.ai_hits(verified(spark, sf_dir)), 1)


@query(CTE + ", p AS (SELECT CASE WHEN p <> '/' AND ends_with(p, '/') THEN left(p, -1) ELSE p END AS path FROM (SELECT split_part(url, '?', 1) AS p FROM ai)) SELECT path, count(*) AS hits FROM p WHERE path NOT IN (SELECT '/' || event_type || '/' || CAST(event_id % 40 AS STRING) FROM events) GROUP BY path HAVING count(*) >= 2")
def log_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = A.load(spark, sf_dir, "events").select(F.format_string("/%s/%d", "event_type", F.col("event_id") % 40).alias("path"))
    return logs.orphans(logs.ai_hits(verified(spark, sf_dir)), listed)


@query(CTE + ", p AS (SELECT split_part(url, '?', 1) AS path, CAST(ts AS DATE) AS d, DATE '2024-01-16' AS updated FROM ai WHERE starts_with(url, '/view/')) SELECT path, updated, count(*) FILTER (d < updated AND d >= updated - 14) AS before, count(*) FILTER (d >= updated AND d < updated + 14) AS after FROM p GROUP BY ALL")
def log_around_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = A.load(spark, sf_dir, "events").select(F.format_string("/view/%d", F.col("event_id") % 120).alias("path")).distinct()
    return logs.around(logs.ai_hits(verified(spark, sf_dir)), paths.withColumn("updated", F.lit("2024-01-16").cast("date")))


@query("SELECT 'malformed' AS gate, 'ok' AS state UNION ALL SELECT 'ranges', 'ok' UNION ALL SELECT 'period', CASE WHEN min(CAST(ts AS DATE)) <= DATE '2024-01-01' AND max(CAST(ts AS DATE)) >= DATE '2024-02-15' THEN 'ok' ELSE 'warn' END FROM events")
def log_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.gates(parsed(spark, sf_dir), A.cidr(spark), "2024-01-01", "2024-02-15")


@query(f"SELECT count(*) AS hits FROM ({A.sql(A.HIT, 'events')}) WHERE NOT broken AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def log_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.within(parsed(spark, sf_dir).where("parsed"), "2024-01-05", "2024-01-09").agg(F.count("*").alias("hits"))
