"""Portfolios: tones, actions of a site, roll-up with the worst movers, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changes in percent from which a site is up, down, or badly down.
UP, DOWN, BAD = 10.0, -5.0, -15.0


def tone(pct: Column) -> Column:
    return F.when(pct.isNull(), "none").when(pct >= UP, "good").when(pct <= BAD, "bad").when(pct <= DOWN, "warn").otherwise("flat")


def key(name: Column) -> Column:
    """Comparison key of a site's name: letters and digits, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def actions(log: DataFrame, sites: DataFrame, start: str, end: str) -> DataFrame:
    """The actions of each site: done within the period, or planned from its start on. log: site, d, planned and more; sites: site, and names it goes by (an array)."""
    names = sites.select("site", F.explode(F.array_distinct(F.transform("names", key))).alias("key_")).where("key_ <> ''")
    rows = log.withColumn("key_", key(F.col("site"))).drop("site").join(names, "key_").drop("key_")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return rows.where(F.when(F.col("planned"), F.col("d") >= a).otherwise(F.col("d").between(a, b)))


def changes(sites: DataFrame, values: DataFrame) -> DataFrame:
    """Every site with before, after, pct, tone; a site without data stays, with the tone none. values: site, before, after."""
    out = sites.join(values, "site", "left")
    pct = F.round(F.try_divide((F.col("after") - F.col("before")) * 100, F.abs("before")), 1)
    return out.withColumn("pct", pct).withColumn("tone", tone(F.col("pct")))


def rollup(changed: DataFrame) -> DataFrame:
    """One row: sites, up, down, without data, totals."""
    return changed.agg(F.count("*").alias("sites"), F.count_if(F.col("pct") > 0).alias("up"), F.count_if(F.col("pct") < 0).alias("down"), F.count_if(F.col("after").isNull()).alias("no_data"), F.round(F.sum("after"), 2).alias("after"), F.round(F.sum("before"), 2).alias("before"))


def findings(changed: DataFrame, done: DataFrame, k: int = 3) -> DataFrame:
    """The k sites that fell most, by DOWN at least: site, pct, severity, actions (those done on it)."""
    n = done.where("not planned").groupBy("site").agg(F.count("*").alias("actions"))
    worst = changed.where(F.col("pct") <= DOWN).orderBy("pct", "site").limit(k)
    return worst.join(n, "site", "left").select("site", "pct", F.when(F.col("pct") <= BAD, "high").otherwise("medium").alias("severity"), F.coalesce("actions", F.lit(0)).alias("actions"))
