"""Queries of findings, reports as lines, trackers' snapshots and the store of survey answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as N
from ..operators import surveys as S
from ..sources import answers, exports
from ..storage import scratch
from . import adapters as A
from . import files, series, sites, surveys

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _examples(group: str, example: str, weight: str, source: str, keep: str) -> str:
    """SQL of a grouped builder: n, value, examples."""
    return f"""SELECT {keep}, count(*) AS n, CAST(sum({weight}) AS DOUBLE) AS value, list({example} ORDER BY {weight} DESC, {example})[1:3] AS examples FROM ({source}) GROUP BY {group}"""


_SEVERITY = "coalesce(list_position(['high', 'medium', 'low', 'info'], severity), 5)"
_FINDINGS = f"""
SELECT 'visibility' AS report, CASE WHEN kind IN ('editorial', 'ugc', 'reviews') THEN 'high' ELSE 'medium' END AS severity, 'core_sources' AS type, kind AS subject, n, value, examples
  FROM ({_examples('kind', 'domain', 'core_in', "SELECT *, type AS kind FROM (" + surveys.SQL['vis_source_gap'] + ") WHERE stability = 'core' AND type <> 'own'", 'kind')})
UNION ALL SELECT 'pages', severity, issue, '', n, value, examples FROM ({_examples('issue, severity', 'url', 'weight', "SELECT *, 1 AS weight FROM (" + sites.SQL['page_diff'] + ")", 'issue, severity')})
UNION ALL SELECT 'portfolio', severity, 'site_fell', site, actions, CAST(-pct AS DOUBLE), [site] FROM ({series.SQL['port_findings']})
UNION ALL SELECT 'migration', 'high', 'group_lost', target, sources, CAST(before AS DOUBLE), [target] FROM ({files.SQL['mig_groups']}) WHERE lost"""
_RANKED = f"SELECT report, severity, type, subject, n, round(value, 4) AS value, array_to_string(examples, ' ') AS examples, CAST(row_number() OVER (PARTITION BY report ORDER BY {_SEVERITY}, value DESC, type, subject) AS INTEGER) AS rank FROM ({_FINDINGS}) QUALIFY rank <= 6"


@query(_RANKED)
def find_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst findings of four reports over the whole tables."""
    gap = S.source_gap(surveys.observations(spark, sf_dir), surveys.urls(), surveys.OWN)
    parts = [N.of_sources(gap), N.of_pages(sites.page_diff(spark, sf_dir)), N.of_sites(series.port_findings(spark, sf_dir)), N.of_migration(files.mig_groups(spark, sf_dir))]
    return N.ranked(parts).withColumns({"value": F.round("value", 4), "examples": F.array_join("examples", " ")})


@query(
    f"""SELECT 0 AS section, 'findings' AS name, to_json({{'report': report, 'severity': severity, 'type': type, 'subject': subject, 'n': n, 'rank': rank}})::VARCHAR AS json FROM ({_RANKED})
UNION ALL SELECT 1, 'domains', to_json({{'domain': domain, 'answers': answers, 'type': type}})::VARCHAR FROM ({surveys.SQL['vis_domains']})
UNION ALL SELECT 2, 'pages', to_json({{'url': url, 'issue': issue, 'severity': severity}})::VARCHAR FROM ({sites.SQL['page_diff']})"""
)
def find_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of three sections as lines; the order of lines is tested apart."""
    top = find_ranked(spark, sf_dir).select("report", "severity", "type", "subject", "n", "rank")
    domains, issues = surveys.vis_domains(spark, sf_dir).select("domain", "answers", "type"), sites.page_diff(spark, sf_dir).select("url", "issue", "severity")
    order = [N.severity_rank(F.col("severity")), "url", "issue"]
    return N.report_lines([("findings", top, ["report", "rank"]), ("domains", domains, [F.desc("answers"), "domain"]), ("pages", issues, order)]).drop("at")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, text): for each family what a tracker would send: counts by engine, and words before the JSON."""
    o = surveys.observations(spark, sf_dir)
    by = o.groupBy("family", "engine").agg(F.count("*").alias("answers_measured"), F.count_if("cited").alias("answers_with_mention"))
    own = by.groupBy("family").agg(F.collect_list(F.struct(F.upper("engine").alias("slug"), "answers_measured", "answers_with_mention")).alias("by_provider"), F.sum("answers_measured").alias("m"), F.sum("answers_with_mention").alias("k"))
    snap = F.struct("by_provider", F.struct(F.col("m").alias("answers_measured"), F.col("k").alias("answers_with_mention")).alias("visibility"), F.array().cast("array<string>").alias("questions"))
    return own.select(F.col("family").alias("site"), F.concat(F.lit("Result {of the call}:\n"), F.to_json(F.struct(snap.alias("snapshot")))).alias("text"))


_COUNTED = surveys.OBS + ", g AS (SELECT family AS site, 'overall' AS kind, 'all' AS name, count(*) AS n, count(*) FILTER (cited) AS k FROM o GROUP BY 1 UNION ALL SELECT family, 'engine', engine, count(*), count(*) FILTER (cited) FROM o GROUP BY 1, 3)"


@query(_COUNTED + f" SELECT site, kind, name, n, k, round(k / n, 6) AS rate, round({surveys._LOW}, 6) AS low, round({surveys._HIGH}, 6) AS high FROM g")
def vis_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from trackers' own counts: those of the answers that they were counted from."""
    counts = answers.tracker_counts(answers.tracker_snapshots(_snapshots(spark, sf_dir)))
    return surveys.rounded(S.with_interval(counts), "rate", "low", "high")


@query(surveys.OBS + f", g AS (SELECT 'overall' AS kind, 'all' AS name, count(*) AS n, count(*) FILTER (cited) AS k FROM o UNION ALL SELECT 'engine', engine, count(*), count(*) FILTER (cited) FROM o GROUP BY 2) SELECT kind, name, n, k, round(k / n, 6) AS rate, round({surveys._LOW}, 6) AS low, round({surveys._HIGH}, 6) AS high FROM g")
def vis_tracker_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trackers of all sites together, through the rates of answers: each row counts for as many as it says."""
    counts = answers.tracker_counts(answers.tracker_snapshots(_snapshots(spark, sf_dir))).where("kind = 'engine'")
    rows = counts.select(F.col("name").alias("engine"), F.col("site").alias("family"), "n", "k")
    return surveys.rounded(S.rates(rows, F.col("n"), F.col("k")).where("kind <> 'family'"), "rate", "low", "high")


@query(surveys.OBS + " SELECT prompt_id, engine, event_id AS run, cited, sources FROM o")
def vis_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers, read from a store that got part of them, then all, then all again."""
    o = surveys.observations(spark, sf_dir).select("prompt_id", "engine", F.col("event_id").alias("run"), "cited", "sources")
    path = scratch(spark, "answers")
    for part in (o.where("run % 3 = 0"), o, o):
        S.keep_answers(part, path)
    return S.kept_answers(spark, path)


_ENGINES = ["purchase", "signup", "view"]


@query(
    surveys.OBS
    + f""", p AS (SELECT DISTINCT prompt_id FROM o),
plans AS (SELECT prompt_id, engine, run FROM (SELECT prompt_id, unnest({_ENGINES}) AS engine FROM p), (SELECT unnest([1, 2, 3]) AS run)),
kept AS (SELECT DISTINCT prompt_id, engine, CAST(event_id % 5 AS INTEGER) AS run FROM o WHERE wave = 1)
SELECT prompt_id, 'Which is "best", ' || prompt_id || '?' AS prompt, 'core' AS family, engine, run FROM plans ANTI JOIN kept USING (prompt_id, engine, run)"""
)
def vis_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a survey of three engines and runs still has to ask: its frozen prompts, read from their file, without those that the store has."""
    o = surveys.observations(spark, sf_dir)
    asked = F.concat(F.lit('Which is "best", '), "prompt_id", F.lit("?"))
    line = F.concat_ws(",", "prompt_id", F.concat(F.lit('"'), F.replace(asked, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("core"))
    frozen = files.as_files(o.select("prompt_id").distinct().withColumns({"line": line, "f": F.lit("prompts")}), "f", "Prompt_ID,Prompt,Family", F.col("line"))
    path = scratch(spark, "answers")
    S.keep_answers(o.where("wave = 1").select("prompt_id", "engine", (F.col("event_id") % 5).cast("int").alias("run"), "cited"), path)
    return S.unanswered(S.survey_plan(exports.prompts(frozen), _ENGINES, 3), S.kept_answers(spark, path))
