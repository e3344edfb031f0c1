"""Queries of visibility in AI answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import surveys as S
from ..dims import Z
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}
OWN = "me.com"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.derived(A.load(spark, sf_dir, "events"), A.OBSERVATION)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


OBS = f"WITH o AS ({A.sql(A.OBSERVATION, 'events')})"
def urls():
    return F.split("sources", " ")
_LOW = f"greatest(0, (k / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} / (1 + {Z} * {Z} / n) * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4.0 * n * n)))"
_HIGH = _LOW.replace("greatest(0, ", "least(1, ").replace(f") - {Z} /", f") + {Z} /")
_HOST = "regexp_replace(lower(regexp_extract(u, '^https?://([^/:?#]*)', 1)), '^www[.]', '')"
_DOMAIN = f", d AS (SELECT DISTINCT event_id, prompt_id, engine, cited, {_HOST} AS domain FROM (SELECT *, unnest(string_split(sources, ' ')) AS u FROM o))"
_TYPE = "CASE WHEN domain = 'me.com' OR ends_with(domain, '.me.com') THEN 'own' WHEN domain = 'en.wikipedia.org' THEN 'reference' ELSE 'editorial' END"


@query(OBS + f", g AS (SELECT 'overall' AS kind, 'all' AS name, count(*) AS n, count(*) FILTER (cited) AS k FROM o UNION ALL SELECT 'engine', engine, count(*), count(*) FILTER (cited) FROM o GROUP BY engine UNION ALL SELECT 'family', family, count(*), count(*) FILTER (cited) FROM o GROUP BY family) SELECT kind, name, n, k, round(k / n, 6) AS rate, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM g")
def vis_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.rates(observations(spark, sf_dir)), "rate", "low", "high")


def _compare_sql(by: str) -> str:
    l1, h1, l2, h2 = (x.replace("k /", f"k{i} /").replace("n", "n#").replace("n#", f"n{i}").replace("mi" + f"n{i}", "min") for i in (1, 2) for x in (_LOW, _HIGH))
    return OBS + f""", w AS (SELECT {by}, count(*) FILTER (wave = 1) AS n1, count(*) FILTER (wave = 1 AND cited) AS k1, count(*) FILTER (wave = 2) AS n2, count(*) FILTER (wave = 2 AND cited) AS k2 FROM o GROUP BY 1),
a AS (SELECT * FROM w WHERE n1 > 0 AND n2 > 0), b AS (SELECT {by}, 1 AS i, n1 AS n, k1 AS k FROM a UNION ALL SELECT {by}, 2, n2, k2 FROM a), c AS (SELECT {by}, i, {_LOW} AS l, {_HIGH} AS h FROM b),
x AS (SELECT a.*, k1 / n1 AS p1, k2 / n2 AS p2, c1.l AS l1, c1.h AS h1, c2.l AS l2, c2.h AS h2 FROM a JOIN c c1 ON c1.{by} = a.{by} AND c1.i = 1 JOIN c c2 ON c2.{by} = a.{by} AND c2.i = 2),
y AS (SELECT *, p2 - p1 - sqrt((p2 - l2) ** 2 + (h1 - p1) ** 2) AS low, p2 - p1 + sqrt((h2 - p2) ** 2 + (p1 - l1) ** 2) AS high, (k1 + k2) / (n1 + n2) AS p FROM x)
SELECT {by}, n1, k1, n2, k2, round(p2 - p1, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS signal, round(z, 6) AS z, round(least(1, {Z} * sqrt(0.25 * (1 / n1 + 1 / n2))), 6) AS floor,
round(1 - abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * exp(-0.5 * (z * i / 2000) * (z * i / 2000)) / sqrt(2 * pi()))), 9) AS p
FROM (SELECT *, (p2 - p1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM y)"""


@query(_compare_sql("family"))
def vis_compare_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.compare(observations(spark, sf_dir), "family"), "diff", "low", "high", "z", "floor").withColumn("p", F.round("p", 9))


@query(_compare_sql("engine"))
def vis_compare_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.compare(observations(spark, sf_dir), "engine"), "diff", "low", "high", "z", "floor").withColumn("p", F.round("p", 9))


@query(OBS + ", p AS (SELECT count(*) AS n FROM o GROUP BY prompt_id, engine) SELECT count(*) AS pairs, min(n) AS least, max(n) AS most, list_sort(list(n))[count(*) // 2 + 1] AS median FROM p")
def vis_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repetitions(observations(spark, sf_dir))


@query(OBS + ", b AS (SELECT DISTINCT event_id, unnest(string_split(brands, '|')) AS brand FROM o) SELECT brand, count(*) AS mentions, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY brand")
def vis_share_of_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.share_of_voice(observations(spark, sf_dir), F.split("brands", r"\|")), "share")


@query(OBS + _DOMAIN + f" SELECT domain, count(*) AS answers, round(count(*) / (SELECT count(*) FROM o), 6) AS share, {_TYPE} AS type FROM d GROUP BY domain")
def vis_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.domain_reach(observations(spark, sf_dir), urls(), OWN), "share")


@query(OBS + _DOMAIN + f""", a AS (SELECT prompt_id, engine, count(*) AS absent FROM o WHERE NOT cited GROUP BY ALL), p AS (SELECT prompt_id, engine, domain, count(*) AS n FROM d WHERE NOT cited AND domain <> 'me.com' GROUP BY ALL)
SELECT domain, count(DISTINCT CASE WHEN absent >= 4 AND n / absent >= 0.75 THEN prompt_id END) AS core_in, CAST(sum(n) AS BIGINT) AS absent_answers, count(DISTINCT prompt_id) AS prompts, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, {_TYPE} AS type,
CASE WHEN count(DISTINCT CASE WHEN absent >= 4 AND n / absent >= 0.75 THEN prompt_id END) >= 2 THEN 'core' ELSE 'rotating' END AS stability FROM p JOIN a USING (prompt_id, engine) GROUP BY domain""")
def vis_source_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source_gap(observations(spark, sf_dir), urls(), OWN)


@query(OBS + " SELECT prompt_id FROM o GROUP BY prompt_id HAVING NOT bool_or(cited AND event_id % 29 = 0)")
def vis_never_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where only every 29th of the answers that cite counts: else every prompt of the large tables is cited."""
    return S.never_cited(observations(spark, sf_dir).withColumn("cited", F.col("cited") & (F.col("event_id") % 29 == 0)))


@query(OBS + " SELECT position, count(*) AS answers FROM o WHERE cited GROUP BY position")
def vis_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mix(observations(spark, sf_dir), "position")


@query(OBS + " SELECT u AS url, string_agg(DISTINCT prompt_id, ',' ORDER BY prompt_id) AS prompts FROM (SELECT prompt_id, unnest(string_split(sources, ' ')) AS u FROM o) WHERE contains(u, '://www.me.com/') GROUP BY u")
def vis_own_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.own_pages(observations(spark, sf_dir), urls(), OWN).withColumn("prompts", F.array_join("prompts", ","))


@query(OBS + ", r AS (SELECT family, count(*) AS n, avg(CASE WHEN cited THEN 1.0 ELSE 0.0 END) AS rate FROM o GROUP BY family), m AS (SELECT quantile_cont(n, 0.5) AS mn, quantile_cont(rate, 0.5) AS mr FROM r) SELECT family, n, round(rate, 6) AS rate, CASE WHEN n >= mn THEN 'large' ELSE 'small' END || '-' || CASE WHEN rate >= mr THEN 'present' ELSE 'absent' END AS quadrant FROM r, m")
def plan_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.quadrants(observations(spark, sf_dir), "family"), "rate")


@query(OBS + ", r AS (SELECT family, count(DISTINCT prompt_id) AS prompts, avg(CASE WHEN cited THEN 1.0 ELSE 0.0 END) AS rate, 1 + CAST(substr(family, 2) AS BIGINT) % 3 AS weight, 1 + CAST(substr(family, 2) AS BIGINT) % 2 AS effort FROM o GROUP BY family) SELECT family, prompts, round(rate, 6) AS rate, round(prompts * weight * (1 - rate) / effort, 6) AS priority FROM r")
def plan_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = observations(spark, sf_dir).groupBy("family").agg(F.count_distinct("prompt_id").alias("prompts"), F.avg(F.col("cited").cast("double")).alias("rate"))
    n = F.substring("family", 2, 10).cast("long")
    return rounded(S.priorities(r.withColumns({"weight": 1 + n % 3, "effort": 1 + n % 2})).drop("weight", "effort"), "rate", "priority")


@query("SELECT conv_id, turn, CASE WHEN i > 0 AND j > 0 THEN CASE WHEN i < j THEN 'the,of' ELSE 'of,the' END WHEN i > 0 THEN 'the' WHEN j > 0 THEN 'of' ELSE '' END AS brands, CASE WHEN i > 0 AND (j = 0 OR i < j) THEN 'first' WHEN i > 0 THEN 'passing' ELSE 'none' END AS position FROM (SELECT conv_id, turn, strpos(t, ' the ') AS i, strpos(t, ' of ') AS j FROM (SELECT conv_id, turn, ' ' || lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')) || ' ' AS t FROM conversations WHERE role = 'assistant'))")
def answer_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.load(spark, sf_dir, "conversations").where("role = 'assistant'")
    clean = F.concat(F.lit(" "), F.regexp_replace("text", "[^A-Za-z]", " "), F.lit(" "))
    return S.answer_brands(c, clean, ["the", "of"]).select("conv_id", "turn", F.array_join("brands", ",").alias("brands"), "position")


@query(OBS + " SELECT count(*) AS answers, count(DISTINCT prompt_id) AS prompts, count(DISTINCT family) AS families, count(DISTINCT engine) AS engines FROM o")
def vis_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overview(observations(spark, sf_dir))


@query(OBS + ", u AS (SELECT split_part(sources, ' ', 1 + event_id % 2) AS url FROM o WHERE cited) SELECT url, count(*) AS answers, contains(url, 'site1') AS own FROM u GROUP BY url ORDER BY answers DESC, url LIMIT 10")
def vis_cited_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return S.cited_urls(o.withColumn("cited_url", F.get(urls(), (F.col("event_id") % 2).cast("int"))), "Site1")


@query("WITH g AS (" + SQL["vis_source_gap"] + ") SELECT * FROM g ORDER BY core_in DESC, absent_answers DESC, domain LIMIT 3")
def vis_top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_gap(vis_source_gap(spark, sf_dir), 3)


@query(OBS + ", n AS (SELECT count(DISTINCT prompt_id) AS n FROM o) SELECT e AS engine, n * 5 AS calls, round(n * 5 * f / 1000, 4) AS fee FROM n, (VALUES ('openai', 10.0), ('perplexity', 2.5), ('gemini', 14.0), ('anthropic', 30.0)) x(e, f)")
def vis_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.costs(observations(spark, sf_dir), {"openai": 1, "perplexity": 1, "gemini": 1, "anthropic": 3}, 5).withColumn("fee", F.round("fee", 4))


@query(OBS + ", w AS (SELECT family, count(*) FILTER (wave = 1 AND family <> 'f2') AS n1, count(*) FILTER (wave = 1 AND family <> 'f2' AND cited) AS k1, count(*) FILTER (wave = 2) AS n2, count(*) FILTER (wave = 2 AND cited) AS k2 FROM o GROUP BY 1) SELECT family, n1, k1, n2, k2, round(k2 / n2 - CASE WHEN n1 > 0 THEN k1 / n1 ELSE 0 END, 6) AS diff FROM w")
def vis_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a family that the first wave doesn't have."""
    o = observations(spark, sf_dir).where("not (wave = 1 and family = 'f2')")
    return rounded(S.compare(o, "family", both=False).select("family", "n1", "k1", "n2", "k2", "diff"), "diff")


@query("SELECT CASE event_id % 7 WHEN 0 THEN 'objection' WHEN 1 THEN 'replacement' WHEN 2 THEN 'qualification' WHEN 3 THEN 'named-comparison' WHEN 4 THEN 'implementation' WHEN 5 THEN 'category-discovery' END AS family, count(*) AS prompts FROM events GROUP BY 1")
def vis_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["Est-ce que Acme est fiable ?", "Alternative à Acme pour {}", "Does Acme support {}", "Acme ou Zeta pour {}", "How to use {} each day", "Quel outil pour {}", "{}"]
    text = F.replace(F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 7).cast("int")), F.lit("{}"), F.col("event_type"))
    return A.load(spark, sf_dir, "events").select(S.prompt_family(text, ["Acme"]).alias("family")).groupBy("family").agg(F.count("*").alias("prompts"))
