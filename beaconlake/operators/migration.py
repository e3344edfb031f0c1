"""Proof of a migration: clicks before and after through the map, the launch curve, verdicts of live checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web as W

#: What a map says of an old page that has no target.
NOWHERE = ["GONE", "UNDECIDED", "MISSING"]


def url_key(url: Column) -> Column:
    """Key of the path with its query."""
    q = W.query_of(url)
    return F.concat(W.path_key(W.decoded_path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def targets(redirects: DataFrame) -> DataFrame:
    """key, target (a path key, GONE or UNDECIDED) of each row of a map; of several rows of a key the last by line_no, else the largest."""
    key = url_key(F.col("source"))
    to = F.when(F.col("decision") == "keep", key).when((F.coalesce("target", F.lit("")) != "") & (F.col("decision") != "manual"), W.path_key(W.decoded_path(F.col("target")))).when(F.col("decision") == "gone", "GONE").otherwise("UNDECIDED")
    order = F.struct(*(c for c in ("line_no", "target") if c in redirects.columns))
    return redirects.groupBy(key.alias("key")).agg(F.max_by(to, order).alias("target"))


def groups(redirects: DataFrame, before: DataFrame, after: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """target, sources, before, after_new, after_old, kept, lost (and verdicts): clicks of all old pages that lead to a target.

    before, after: url, clicks. A group is lost when it had max(10, 1 %) of the clicks and kept less than half of what the
    site kept. live: source, verdict."""
    to = targets(redirects)
    b = before.select(url_key(F.col("url")).alias("key"), W.host_of(F.col("url")).alias("host"), F.col("url"), "clicks").join(to, "key", "left").withColumn("target", F.coalesce("target", F.lit("MISSING")))
    old_host = b.groupBy("host").agg(F.count("*").alias("n")).agg(F.max_by("host", F.struct("n", "host")).alias("h")).select("h").scalar()
    a = after.select(url_key(F.col("url")).alias("key"), W.host_of(F.col("url")).alias("host"), W.path_key(W.decoded_path(F.col("url"))).alias("path"), "clicks").join(to.select("key", F.col("target").alias("old_to")), "key", "left")
    a = a.withColumn("old", (F.col("host") == old_host) & F.col("old_to").isNotNull())
    stale = a.where("old").groupBy(F.col("old_to").alias("target")).agg(F.sum("clicks").alias("after_old"))
    fresh = a.where("not old").groupBy(F.col("path").alias("target")).agg(F.sum("clicks").alias("after_new"))
    g = b.groupBy("target").agg(F.count("*").alias("sources"), F.sum("clicks").alias("before"))
    g = g.join(stale, "target", "left").join(fresh, "target", "left").fillna(0.0, ["after_old", "after_new"])
    g = g.withColumn("after_new", F.when(F.col("target").isin(NOWHERE), 0.0).otherwise(F.col("after_new")))
    total, now = before.agg(F.sum("clicks")).scalar(), after.agg(F.sum("clicks")).scalar()
    kept = F.try_divide(F.col("after_new") + F.col("after_old"), F.col("before"))
    g = g.withColumns({"kept": kept, "total_": total, "now_": now})
    lost = (F.col("target") != "GONE") & (F.col("before") >= F.greatest(F.lit(10.0), 0.01 * F.col("total_"))) & (F.col("kept") < 0.5 * F.col("now_") / F.col("total_"))
    g = g.withColumn("lost", F.coalesce(lost, F.lit(False))).drop("total_", "now_")
    if live is None:
        return g
    seen = b.select("target", W.path_key(W.decoded_path(F.col("url"))).alias("k")).join(live.select(W.path_key(W.decoded_path(F.col("source"))).alias("k"), "verdict"), "k")
    return g.join(seen.groupBy("target").agg(F.array_sort(F.collect_set("verdict")).alias("verdicts")), "target", "left")


def missing_from_map(redirects: DataFrame, before: DataFrame) -> DataFrame:
    """url, clicks of old pages with clicks that the map doesn't have."""
    return before.where("clicks > 0").withColumn("key", url_key(F.col("url"))).join(targets(redirects).select("key"), "key", "left_anti").select("url", "clicks")


def curve(days: DataFrame, launch: str) -> DataFrame:
    """One row: mean of the 28 days before the launch and of the latest 28 after it, their ratio, days since; under 28 days it is too early, under 7 there is no mean."""
    d, start = F.col("d"), F.lit(launch).cast("date")
    sums = days.groupBy("d").agg(F.sum("v").alias("v"))
    after = sums.where(d >= start).withColumns({"at": F.row_number().over(Window.orderBy(F.desc("d"))), "n": F.count("*").over(Window.partitionBy())})
    recent = after.where("at <= 28 and n >= 7").agg(F.avg("v").alias("mean_recent"))
    m = sums.agg(F.avg(F.when((d < start) & (d >= F.date_sub(start, 28)), F.col("v"))).alias("mean_before"), F.max("d").alias("last"), F.coalesce(F.max(d >= start), F.lit(False)).alias("any"))
    days_after = F.when(F.col("any"), F.date_diff("last", start) + 1).otherwise(0)
    m = m.withColumns({"mean_recent": recent.scalar(), "days_after": days_after}).withColumn("early", F.col("days_after") < 28)
    return m.select("mean_before", "mean_recent", F.try_divide("mean_recent", "mean_before").alias("ratio"), "days_after", "early")


#: Severity of each verdict of a live check.
SEVERITY = {
    "not_redirected": "high", "broken_target": "high", "noindex_target": "high", "loop": "high", "canonical_elsewhere": "high", "home_target": "high",
    "wrong_target": "medium", "temporary": "medium", "chain": "medium", "gone_redirected": "low", "gone_still_live": "medium", "gone_404": "info", "error": "medium", "ok": "ok", "gone_ok": "ok",
}
_MOVED, _FOR_NOW = [301, 308], [302, 303, 307]


def landing(html: Column, header: Column | None = None) -> tuple[Column, Column, Column]:
    """noindex, canonical (as written) and whether the page refreshes to another, from a landing page and its X-Robots-Tag header."""
    metas = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<meta\b(?=[^>]*\sname=["']?(?:robots|googlebot)["'\s>])[^>]*>"""), 0)
    said = F.transform(metas, lambda m: F.lower(F.regexp_extract(m, r"""(?i)content=["']([^"']*)["']""", 1)))
    if header is not None:
        said = F.concat(said, F.array(F.lower(F.coalesce(header, F.lit("")))))
    link = F.regexp_extract(html, r"""(?i)<link\b(?=[^>]*\srel=["']?canonical["'\s>])[^>]*>""", 0)
    return (
        F.exists(said, lambda r: r.contains("noindex") | (F.trim(r) == "none")),
        F.coalesce(F.regexp_extract(link, r"""(?i)href=["']([^"']+)["']""", 1), F.lit("")),
        F.coalesce(html.rlike(r"""(?i)<meta\b(?=[^>]*\shttp-equiv=["']?refresh["'\s>])"""), F.lit(False)),
    )


def live_verdicts(tests: DataFrame, paths_only: bool = False, max_hops: int = 10) -> DataFrame:
    """The rows with verdict and severity. tests: source, expected, gone, hops (array of url, status; a null status is an error), noindex, canonical.

    The hops are what a checker saw, one request after the other; without a redirect the first hop is the last."""
    last = F.element_at("hops", -1)
    codes = F.transform("hops", lambda h: h["status"])
    redirects = F.filter(codes, lambda c: c.isin(_MOVED + _FOR_NOW))
    status, url = last["status"], last["url"]
    moved, n = F.size(redirects) > 0, F.size("hops")
    same = lambda a, b: (W.path_key(W.decoded_path(a)) == W.path_key(W.decoded_path(b))) & (W.query_of(a) == W.query_of(b)) & (F.lit(paths_only) | (W.host_of(a) == W.host_of(b)))
    elsewhere = (F.col("canonical") != "") & ((W.path_key(W.decoded_path(F.col("canonical"))) != W.path_key(W.decoded_path(url))) | (F.lit(not paths_only) & (W.host_of(F.col("canonical")) != W.host_of(url))))
    looped = (F.size(F.array_distinct(F.transform("hops", lambda h: h["url"]))) < n) | (n > max_hops + 1) | ((n == max_hops + 1) & status.isin(_MOVED + _FOR_NOW))
    off = (F.col("expected") != "") & ~same(url, F.col("expected"))
    gone = F.when(~moved & (status == 410), "gone_ok").when(~moved & (status == 404), "gone_404").when(~moved & (status == 200), "gone_still_live").otherwise("gone_redirected")
    still = F.when(status != 200, "broken_target").when((F.col("expected") != "") & same(url, F.col("expected")), "ok").otherwise("not_redirected")
    landed = (
        F.when(status != 200, "broken_target")
        .when(off & (W.path_key(W.decoded_path(url)) == "/"), "home_target").when(off, "wrong_target")
        .when(F.coalesce("noindex", F.lit(False)), "noindex_target").when(F.coalesce(elsewhere, F.lit(False)), "canonical_elsewhere")
        .when(F.exists(redirects, lambda c: c.isin(_FOR_NOW)), "temporary").when(F.size(redirects) > 1, "chain").otherwise("ok")
    )
    verdict = F.when(F.exists(codes, lambda c: c.isNull()), "error").when(looped, "loop").when(F.col("gone"), gone).when(moved, landed).otherwise(still)
    severity = F.element_at(F.create_map(*(F.lit(x) for p in SEVERITY.items() for x in p)), F.col("verdict"))
    return tests.withColumn("verdict", verdict).withColumn("severity", severity)


def to_test(redirects: DataFrame, n: int) -> DataFrame:
    """The n rows of a map that are worth most."""
    return redirects.orderBy(F.desc("value"), "source").limit(n)
