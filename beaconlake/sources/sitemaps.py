"""Sitemaps and sitemap indexes: what files list, and the pages that are reached from some of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .exports import unescaped


def listed(files: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """(sitemap, is_index, loc): a row for each loc element, entities decoded, or for each bare line that is a URL. A file that lists nothing has one row, loc null."""
    body = F.coalesce(F.col(text), F.lit(""))
    locs = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1), unescaped)
    bare = F.filter(F.transform(F.split(body, r"\r?\n"), F.trim), lambda x: x.rlike(r"^https?://\S+$"))
    index = F.lower(body).contains("<sitemapindex")
    rows = files.select(F.col(url).alias("sitemap"), index.alias("is_index"), F.when(F.size(locs) > 0, locs).otherwise(bare).alias("locs"))
    return rows.select("sitemap", "is_index", F.explode_outer("locs").alias("loc"))


def _same(url: Column) -> Column:
    """Addresses of one file: scheme and host in lower case, no fragment."""
    return F.concat(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/#]*)", 1)), F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/#]*", ""), "#.*$", ""))


def follow(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(url, sitemap, depth, state) of what can be reached from the roots (url): page, index, urlset or missing.

    files: (url, text) of all that was fetched. A sitemap is read once, at the least depth it is listed at, so indexes that
    list each other end; a page is there once for each sitemap that lists it. All sitemaps of a depth are read at once, and
    only those that weren't seen before go on."""
    parsed = stored(listed(files.withColumn("url", _same(F.col("url")))).distinct(), "listed")
    known = parsed.select("sitemap", "is_index").distinct()
    frontier = roots.select(_same(F.col("url")).alias("url"), F.lit(None).cast("string").alias("sitemap")).groupBy("url").agg(F.min("sitemap").alias("sitemap")).withColumn("depth", F.lit(0))
    seen, pages = [], []
    while True:
        frontier = stored(frontier, "frontier")
        if frontier.isEmpty():
            break
        state = F.when(F.col("is_index"), "index").when(~F.col("is_index"), "urlset").otherwise("missing")
        seen.append(stored(frontier.join(known.withColumnRenamed("sitemap", "url"), "url", "left").select("url", "sitemap", "depth", state.alias("state")), "seen"))
        below = frontier.select(F.col("url").alias("sitemap"), "depth").join(parsed.where("loc is not null"), "sitemap")
        pages.append(below.where("not is_index").select(F.col("loc").alias("url"), "sitemap", (F.col("depth") + 1).alias("depth"), F.lit("page").alias("state")))
        visited = reduce(DataFrame.union, [s.select("url") for s in seen])
        to = below.where("is_index").select(_same(F.col("loc")).alias("url"), "sitemap", (F.col("depth") + 1).alias("depth"))
        frontier = to.groupBy("url", "depth").agg(F.min("sitemap").alias("sitemap")).join(visited, "url", "left_anti").select("url", "sitemap", "depth")
    return reduce(DataFrame.union, [*seen, *pages]) if seen else frontier.withColumn("state", F.lit("missing"))
