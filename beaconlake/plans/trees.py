"""Queries of nested inputs: JSON of any depth, sitemaps that list sitemaps, rewrite rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import redirects as R
from ..sources import sitemaps, variants
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


_ID = "CAST(s_suppkey AS STRING)"
_NET = "'10.' || CAST(s_suppkey % 200 AS STRING) || '.' || CAST(s_nationkey AS STRING) || '.0/24'"
#: A vendor's payload: a documented list, blocks under other names and depths, texts that are no block, metadata.
_PAYLOAD = f"""'{{"_generated": "2026-01-01", "name": "' || {_ID} || '", "prefixes": [{{"ipv4Prefix": "' || {_NET} || '", "service": "x"}}, {{"ipv6Prefix": "2001:db8:' || {_ID} || '::/48"}}], '
|| '"more": ' || repeat('{{"in": [1, null, ', CAST(s_suppkey % 7 AS INT)) || '{{"cidr": "192.168.' || CAST(s_suppkey % 250 AS STRING) || '.0/24", "list": ["172.16.' || CAST(s_nationkey AS STRING) || '.0/22", "no block", "300"], "text": "10.9.9.0/24"}}'
|| repeat(']}}', CAST(s_suppkey % 7 AS INT)) || ', "_old": {{"cidr": "10.99.0.0/16"}}}}'"""
#: Linked data: types alone and in lists, at a depth that differs.
_LINKED = f"""'{{"@graph": [{{"@type": ["Article", "T' || CAST(s_nationkey AS STRING) || '"], "author": {{"@type": "Person", "name": "' || {_ID} || '"}}}}, '
|| repeat('{{"part": {{"@type": "Part", "x": [', CAST(s_suppkey % 5 AS INT)) || '{{"@type": "Leaf"}}' || repeat(']}}}}', CAST(s_suppkey % 5 AS INT)) || '], "@type": "Page"}}'"""
PAYLOAD = [("s_suppkey", "id"), (_PAYLOAD, "json")]
LINKED = [("s_suppkey", "id"), (_LINKED, "json")]
#: name: the nearest key above a node; items of arrays have their array's.
_TREE = """WITH RECURSIVE d AS ({source}),
t AS (SELECT d.id, j.key, j.value, j.type, j.atom, j.id AS node, j.parent FROM d, json_tree(d.json) j),
n AS (SELECT *, CAST(NULL AS VARCHAR) AS name, false AS in_list, 0 AS depth FROM t WHERE parent IS NULL
  UNION ALL SELECT t.*, CASE WHEN n.type = 'ARRAY' THEN n.name ELSE t.key END, n.type = 'ARRAY', n.depth + 1 FROM t JOIN n ON t.id = n.id AND t.parent = n.node)
"""


def payloads(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]]) -> DataFrame:
    return A.derived(A.load(spark, sf_dir, "supplier"), columns)


@query(_TREE.format(source=A.sql(PAYLOAD, "supplier")) + "SELECT id, name, depth, in_list, atom ->> '$' AS value, count(*) AS nodes FROM n WHERE type NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.walk(payloads(spark, sf_dir, PAYLOAD), "json").where("kind not in ('OBJECT', 'ARRAY')")
    return found.groupBy("id", "name", F.col("depth"), "in_list", "value").agg(F.count("*").alias("nodes"))


@query(
    _TREE.format(source=A.sql(PAYLOAD, "supplier"))
    + f"SELECT DISTINCT id, trim(atom ->> '$') AS cidr FROM n WHERE type = 'VARCHAR' AND (in_list OR key IN ({', '.join(map(repr, variants.BLOCK_FIELDS))})) AND regexp_matches(trim(atom ->> '$'), '{variants.BLOCK}')"
)
def json_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.harvest_ranges(payloads(spark, sf_dir, PAYLOAD))


@query(_TREE.format(source=A.sql(PAYLOAD, "supplier")) + ", x AS (SELECT * FROM n WHERE parent IS NULL UNION ALL SELECT n.* FROM n JOIN x ON n.id = x.id AND n.parent = x.node WHERE n.key IS NULL OR n.in_list OR NOT starts_with(n.key, '_')) SELECT id, count(*) AS nodes, max(depth) AS depth FROM x GROUP BY 1")
def json_without_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and depth of the trees without members whose key begins with _, and all below them."""
    found = variants.walk(payloads(spark, sf_dir, PAYLOAD), "json", skip=lambda key: key.startswith("_"))
    return found.groupBy("id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query(_TREE.format(source=A.sql(LINKED, "supplier")) + "SELECT id, atom ->> '$' AS type, count(*) AS n FROM n WHERE name = '@type' AND type = 'VARCHAR' GROUP BY ALL")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.linked_types(payloads(spark, sf_dir, LINKED)).groupBy("id", "type").agg(F.count("*").alias("n"))


_SITE = "'https://www.shop.example/'"
#: (sitemap, loc) of the fetched files: regions list their nations, themselves and the next region; nations list customers; one nation of seven wasn't fetched.
_LISTED = f"""SELECT {_SITE} || 'r' || r_regionkey || '.xml' AS sitemap, {_SITE} || 'n' || n_nationkey || '.xml' AS loc, true AS is_index FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT {_SITE} || 'r' || r_regionkey || '.xml', {_SITE} || 'r' || ((r_regionkey + 1) % 5) || '.xml', true FROM region
UNION ALL SELECT {_SITE} || 'r' || r_regionkey || '.xml', {_SITE} || 'r' || r_regionkey || '.xml', true FROM region
UNION ALL SELECT {_SITE} || 'n' || c_nationkey || '.xml', {_SITE} || 'c?id=' || c_custkey || '&page=1', false FROM customer WHERE c_nationkey % 7 <> 3"""


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, text): the files as XML, with entities."""
    region, nation, customer = (A.load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    site = F.lit("https://www.shop.example/")
    at = lambda kind, key: F.concat(site, F.lit(kind), F.col(key).cast("string"), F.lit(".xml"))
    rows = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(at("r", "r_regionkey").alias("url"), at("n", "n_nationkey").alias("loc"))
    after = region.withColumn("after", (F.col("r_regionkey") + 1) % 5)
    rows = rows.union(after.select(at("r", "r_regionkey"), at("r", "after"))).union(region.select(at("r", "r_regionkey"), at("r", "r_regionkey"))).withColumn("kind", F.lit("sitemapindex"))
    page = F.concat(site, F.lit("c?id="), F.col("c_custkey").cast("string"), F.lit("&amp;page=1"))
    rows = rows.union(customer.where("c_nationkey % 7 <> 3").select(at("n", "c_nationkey"), page, F.lit("urlset")))
    body = F.array_join(F.transform(F.collect_list("loc"), lambda x: F.concat(F.lit("<url><LOC>\n"), x, F.lit(" </LOC></url>"))), "")
    return rows.groupBy("url", "kind").agg(body.alias("body")).select("url", F.concat(F.lit("<?xml version='1.0'?><"), "kind", F.lit(">"), "body", F.lit("</"), "kind", F.lit(">")).alias("text"))


@query(
    f"""WITH RECURSIVE listed AS ({_LISTED}),
reach(url, depth) AS (SELECT {_SITE} || 'r2.xml', 0 UNION SELECT loc, depth + 1 FROM reach JOIN listed ON sitemap = url WHERE is_index AND depth < 10),
s AS (SELECT url, min(depth) AS depth FROM reach GROUP BY 1),
known AS (SELECT DISTINCT sitemap, is_index FROM listed),
f AS (SELECT url, depth, CASE WHEN is_index THEN 'index' WHEN NOT is_index THEN 'urlset' ELSE 'missing' END AS state FROM s LEFT JOIN known ON sitemap = url)
SELECT url, depth, state FROM f UNION ALL SELECT loc, depth + 1, 'page' FROM f JOIN listed ON sitemap = url WHERE state = 'urlset'"""
)
def sitemap_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is reached from one region's index; indexes list each other, and themselves."""
    root = A.load(spark, sf_dir, "region").where("r_regionkey = 2").select(F.lit("HTTPS://www.shop.example/r2.xml#top").alias("url"))
    return sitemaps.follow(site_files(spark, sf_dir), root).select("url", "depth", "state")


@query(f"SELECT sitemap, loc, is_index FROM ({_LISTED})")
def sitemap_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.listed(site_files(spark, sf_dir)).select("sitemap", "loc", "is_index")


#: A rule for each of a thousand folders, then some that need no literal or have a choice; the last one takes what is left.
_RULES = """SELECT i AS at, '^/Shop/cat' || i || '/item-([0-9]+)[.]html$' AS expression, '/c/' || i || '/$1' AS replacement FROM {numbers}
UNION ALL SELECT 1000, '^/(shop|store)/cat([0-9]+)/item-([0-9]*5)[.]html$', '/five/$2/$3'
UNION ALL SELECT 1001, '/shop/cat[0-9]+/', '/all/'"""
_OLD = "SELECT o_orderkey AS id, '/shop/cat' || (o_custkey % 1200) || '/item-' || o_orderkey || '.html' AS path FROM orders"
_NEW = """SELECT '/c/' || (o_custkey % 1200) || '/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0
UNION SELECT '/five/' || (o_custkey % 1200) || '/' || o_orderkey FROM orders WHERE o_orderkey % 2 = 1
UNION SELECT '/all/item-' || o_orderkey || '.html' FROM orders WHERE o_orderkey % 7 < 3"""


@query(
    f"""WITH rules AS ({_RULES.format(numbers='range(1000) r(i)')}), old AS ({_OLD}), new AS ({_NEW}),
cand AS MATERIALIZED (SELECT id, path, rules.at AS k, expression, replacement FROM old JOIN rules ON rules.at = CAST(regexp_extract(path, '/cat([0-9]+)/', 1) AS INTEGER) AND rules.at < 1000
  UNION ALL SELECT id, path, rules.at, expression, replacement FROM old, rules WHERE rules.at >= 1000),
met AS (SELECT id, k, expression, regexp_replace(path, expression, replace(replacement, '$', chr(92)), 'gi') AS target FROM cand WHERE regexp_matches(path, expression, 'i'))
SELECT id, target, expression AS rule FROM met JOIN new ON target = path QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1"""
)
def red_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 002 rules over every old page: the first one whose rewriting is a page."""
    orders = A.load(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders_of_rules")
    rules = spark.sql(_RULES.format(numbers="(SELECT id AS i FROM range(1000))"))
    old, new = (spark.sql(x.replace("FROM orders", "FROM orders_of_rules")) for x in (_OLD, _NEW))
    found = R.by_rules(old.withColumnRenamed("id", "key"), new.select(F.col("path").alias("to"), F.col("path").alias("target")), rules)
    return found.select(F.col("key").alias("id"), "target", "rule")
