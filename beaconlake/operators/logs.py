"""Crawler forensics over log_record tables. Functions take and return DataFrames and never collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import stats, web
from ..functions.net import address_key
from ..sources.logs import once


def classify(records: DataFrame) -> DataFrame:
    """Adds bot, provider, purpose and ranges: null if the agent claims to be no crawler we know."""
    return records.select("*", once("bot_", web.bot_number("agent"))).withColumns({"bot": web.bot_field("bot_", 1), "provider": web.bot_field("bot_", 2), "purpose": web.bot_field("bot_", 3), "ranges": web.bot_field("bot_", 4)}).drop("bot_")


def with_blocks(hits: DataFrame, cidr: DataFrame) -> DataFrame:
    """Adds inside: whether the address lies in a block of its provider. cidr: ranges, lo, hi (see sources.logs.read_blocks).

    The blocks of a provider become one array (a row for each provider), so a hit joins one row at most: no row is
    doubled, the hits aren't shuffled when that table is small enough for Spark to broadcast, and streams can do the same."""
    blocks = cidr.groupBy(F.col("ranges").alias("r_")).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("blocks_"))
    inside = F.expr("exists(blocks_, b -> key_ between b.lo and b.hi)")
    rows = hits.select("*", once("key_", address_key("ip")))
    return rows.join(blocks, F.col("ranges") == F.col("r_"), "left").withColumn("inside", F.coalesce(inside, F.lit(False))).drop("r_", "blocks_", "key_")


def dns_verdict(addresses: DataFrame, dns: DataFrame) -> DataFrame:
    """(ip, ranges, dns_verdict) by reverse and forward lookups. dns: ip, ptr, forward (array of addresses).

    No name, or a name that leads nowhere, can't be verified; a name outside the provider's domains, or one that leads
    to other addresses, is spoofed."""
    domains = {b[4]: b[5] for b in dims.BOTS if b[5]}
    own = F.lit(False)
    for ranges, ends in domains.items():
        for end in ends:
            own = own | ((F.col("ranges") == ranges) & F.concat(F.lit("."), F.lower("ptr")).endswith(end))
    verdict = F.when(F.col("ptr").isNull(), "unverifiable").when(~own, "spoofed").when(F.coalesce(F.size("forward"), F.lit(0)) == 0, "unverifiable").when(F.array_contains("forward", F.col("ip")), "verified").otherwise("spoofed")
    return addresses.where(F.col("ranges").isin(list(domains))).join(dns, "ip").select("ip", "ranges", verdict.alias("dns_verdict"))


def verify(hits: DataFrame, cidr: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """Adds verdict to crawler hits: verified beats forged beats unverifiable. Names are looked up once for each address, then joined back."""
    out = with_blocks(hits.where("bot is not null"), cidr)
    by_name = F.lit("unverifiable")
    if dns is not None:
        out = out.join(dns_verdict(out.select("ip", "ranges").distinct(), dns), ["ip", "ranges"], "left")
        by_name = F.coalesce("dns_verdict", F.lit("unverifiable"))
    verdict = F.when(F.col("inside"), "verified").when(by_name == "verified", "verified").when(web.forged("url", "method"), "spoofed").otherwise(by_name)
    return out.withColumn("verdict", verdict).drop("inside", "dns_verdict")


def bot_buckets(verified: DataFrame) -> DataFrame:
    """A row for each bot; spoofed hits only count as claims."""
    real = F.col("verdict") != "spoofed"
    return verified.groupBy("bot", "provider", "purpose").agg(
        F.count("*").alias("claimed"), F.count_if(F.col("verdict") == "verified").alias("verified"), F.count_if(~real).alias("spoofed"), F.count_if(F.col("verdict") == "unverifiable").alias("unverifiable"),
        F.coalesce(F.sum(F.when(real, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_distinct(F.when(real, F.col("ip"))).alias("ips"), F.min(F.when(real, F.col("ts"))).alias("first_seen"), F.max(F.when(real, F.col("ts"))).alias("last_seen"),
    )


def histogram(verified: DataFrame, key, name: str, by: str = "bot") -> DataFrame:
    """(by, name, hits) of the hits that aren't spoofed."""
    return verified.where("verdict <> 'spoofed'").groupBy(by, key.alias(name)).agg(F.count("*").alias("hits"))


def purposes(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("purpose").agg(F.count("*").alias("bots"), F.sum("claimed").alias("claimed"), F.sum("verified").alias("verified"), F.sum("spoofed").alias("spoofed"), F.sum("unverifiable").alias("unverifiable"), F.array_join(F.array_sort(F.collect_set("bot")), ",").alias("names"))


def ai_hits(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("purpose").isin(dims.AI_PURPOSES) & (F.col("verdict") != "spoofed"))


def response_times(hits: DataFrame, by: str) -> DataFrame:
    """Exact ranks of the response times: the value at floor(share * n) of the sorted ones. Equal times (to 0.1 ms) are counted first, so a group is as large as its different times."""
    v = hits.where("rt_ms is not null").groupBy(by, F.round("rt_ms", 1).alias("v")).agg(F.count("*").alias("c"), F.sum("rt_ms").alias("s"))
    group = Window.partitionBy(by)
    v = v.withColumns({"upto": F.sum("c").over(group.orderBy("v")), "n": F.sum("c").over(group)})
    return v.groupBy(by, "n").agg(F.round(F.sum("s") / F.sum("c"), 3).alias("mean_ms"), *(stats.at_rank_of_counts(F.col("v"), F.col("upto"), F.col("n"), s).alias(f"p{int(s * 100)}") for s in (0.5, 0.9, 0.99)))


def query_parameters(hits: DataFrame) -> DataFrame:
    """Names of query parameters and the hits that carry them."""
    query = F.when(F.col("url").contains("?"), F.regexp_extract("url", r"\?([^#]*)", 1))
    names = F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1)))
    return hits.where(F.col("url").contains("?")).select(F.explode(names).alias("parameter")).groupBy("parameter").agg(F.count("*").alias("hits"))


PAGINATION = r"(?i)/(?:page|p)/\d+|[?&](?:page|paged|p)=\d+"


def coverage(crawled: DataFrame, sitemap: DataFrame, cited: DataFrame) -> DataFrame:
    """path with three flags: crawled, in the sitemap, cited. Inputs have a column path."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("path", F.lit(True).alias(name)).distinct()

    out = flag(crawled, "crawled").join(flag(sitemap, "listed"), "path", "full_outer").join(flag(cited, "cited"), "path", "full_outer")
    return out.fillna(False, ["crawled", "listed", "cited"])


def malformed(parsed: DataFrame) -> DataFrame:
    """Lines, malformed ones, their share and whether it is over 20 %."""
    bad = F.count_if(~F.col("parsed"))
    return parsed.agg(F.count("*").alias("lines"), bad.alias("malformed"), F.try_divide(bad, F.count("*")).alias("ratio"), F.coalesce(F.try_divide(bad, F.count("*")) > 0.2, F.lit(False)).alias("refuse"))


def diagnostics(verified: DataFrame) -> DataFrame:
    """(bot, diagnostic, value) beyond the thresholds: refusals over 2 %, redirects over 10 %, query hits over 15 %, pagination over 20 %."""
    real = verified.where("verdict <> 'spoofed'")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rates = real.groupBy("bot").agg(share(F.col("status").isin(401, 403, 429)).alias("refused"), share(F.col("status").between(300, 399)).alias("redirected"), share(F.col("url").contains("?")).alias("query"), share(F.col("url").rlike(PAGINATION)).alias("pagination"))
    limits = {"refused": 0.02, "redirected": 0.10, "query": 0.15, "pagination": 0.20}
    long = rates.select("bot", F.explode(F.array(*(F.struct(F.lit(k).alias("diagnostic"), F.col(k).alias("value"), F.lit(v).alias("threshold")) for k, v in limits.items()))).alias("d")).select("bot", "d.*")
    return long.where("value > threshold")


def months(verified: DataFrame) -> DataFrame:
    """Hits by bot and month, months without a hit between the first and the last of all included, with the month before; a drop over 90 % from more than 50 hits is flagged."""
    real = verified.where("verdict <> 'spoofed'").select("bot", F.trunc("ts", "month").alias("month"))
    n = real.groupBy("bot", "month").agg(F.count("*").alias("hits"))
    span = n.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.sequence("a", "b", F.expr("interval 1 month")).alias("s"))
    every = n.select("bot").distinct().withColumn("month", F.explode(span.scalar()))
    m = every.join(n, ["bot", "month"], "left").fillna(0, ["hits"])
    before = F.lag("hits").over(Window.partitionBy("bot").orderBy("month"))
    return m.withColumn("before", before).withColumn("dropped", F.coalesce((F.col("before") > 50) & (F.col("hits") < 0.1 * F.col("before")), F.lit(False)))


def totals(verified: DataFrame) -> DataFrame:
    """One row over all bots: claimed (previews too), verified, spoofed, unverifiable, counted (AI purposes, not spoofed)."""
    v = F.col("verdict")
    counts = [F.count_if(v == x).alias(x) for x in ("verified", "spoofed", "unverifiable")]
    return verified.agg(F.count("*").alias("claimed"), *counts, F.count_if((v != "spoofed") & F.col("purpose").isin(dims.AI_PURPOSES)).alias("counted"))


def kpis(verified: DataFrame, coverage_rows: DataFrame | None = None) -> DataFrame:
    """kpi, value, tone: verification rate (warn under 90 %, bad under 60), real-time fetches, errors served (bad over 2 %), sitemap coverage (bad under 40)."""
    ai, v = F.col("purpose").isin(dims.AI_PURPOSES), F.col("verdict")
    counted = ai & (v != "spoofed")
    m = verified.agg(
        F.count_if(counted).alias("hits"),
        F.try_divide(F.count_if(ai & (v == "verified")), F.count_if(ai)).alias("rate"),
        F.count_if(counted & (F.col("purpose") == "user_fetch")).alias("fetches"),
        F.try_divide(F.count_if(counted & (F.col("status") >= 400)), F.count_if(counted)).alias("errors"),
    )
    row = lambda kpi, value, tone: F.struct(F.lit(kpi).alias("kpi"), value.cast("double").alias("value"), tone.alias("tone"))
    rows = [
        row("verified_hits", F.col("hits"), F.when(F.col("hits") > 0, "good").otherwise("neutral")),
        row("verification_rate", F.col("rate"), F.when(F.col("rate") < 0.6, "bad").when(F.col("rate") < 0.9, "warn").otherwise("good")),
        row("real_time_fetches", F.col("fetches"), F.when(F.col("fetches") > 0, "good").otherwise("bad")),
        row("errors", F.col("errors"), F.when(F.col("errors") > 0.02, "bad").otherwise("good")),
    ]
    if coverage_rows is not None:
        m = m.withColumn("covered", coverage_rows.agg(F.try_divide(F.count_if(F.col("listed") & F.col("crawled")), F.count_if("listed"))).scalar())
        rows.append(row("sitemap_coverage", F.col("covered"), F.when(F.col("covered") < 0.4, "bad").otherwise("good")))
    return m.select(F.explode(F.array(*rows)).alias("k")).select("k.*")


def slow(bots: DataFrame, humans: DataFrame, limit_ms: float = 1500.0) -> DataFrame:
    """bot, p50, human_p50 where a bot's median is over the limit or twice that of humans. Both: rows of response_times, humans one."""
    human = humans.select("p50").scalar()
    return bots.select("bot", "p50", human.alias("human_p50")).where((F.col("p50") > limit_ms) | (F.col("p50") > 2 * F.col("human_p50")))


def unseen(verified: DataFrame, days: int = 21) -> DataFrame:
    """Bots last seen more than ``days`` before the end of the log."""
    real = verified.where("verdict <> 'spoofed'")
    last = real.groupBy("bot").agg(F.max(F.to_date("ts")).alias("last_seen"))
    return last.withColumn("days", F.date_diff(verified.agg(F.max(F.to_date("ts"))).scalar(), "last_seen")).where(F.col("days") > days)


def common_parameters(hits: DataFrame, share: float = 0.10) -> DataFrame:
    """Query parameters that more than ``share`` of the hits carry."""
    every = hits.agg(F.count("*")).scalar()
    return query_parameters(hits).withColumn("share", F.col("hits") / every).where(F.col("share") > share)


def redirected_often(hits: DataFrame, limit: int = 20) -> DataFrame:
    """URLs that were redirected more than ``limit`` times."""
    return hits.where("status between 300 and 399").groupBy("url").agg(F.count("*").alias("hits")).where(F.col("hits") > limit)


def orphans(hits: DataFrame, sitemap: DataFrame, least: int = 2) -> DataFrame:
    """Paths asked for ``least`` times or more that the sitemap (path) doesn't have."""
    n = hits.groupBy(web.strip_query(F.col("url")).alias("path")).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return n.join(sitemap.select("path").distinct(), "path", "left_anti")


def around(hits: DataFrame, updates: DataFrame, days: int = 14) -> DataFrame:
    """Hits of each path in the ``days`` before and after its update. updates: path, updated (a date)."""
    rows = hits.select(web.strip_query(F.col("url")).alias("path"), F.to_date("ts").alias("d")).join(updates, "path")
    gap = F.date_diff("d", "updated")
    return rows.groupBy("path", "updated").agg(F.count_if((gap < 0) & (gap >= -days)).alias("before"), F.count_if((gap >= 0) & (gap < days)).alias("after"))


def within(records: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records of the days from since to until, both included; None is open."""
    d = F.to_date("ts")
    out = records if since is None else records.where(d >= F.lit(since).cast("date"))
    return out if until is None else out.where(d <= F.lit(until).cast("date"))


def gates(parsed: DataFrame, cidr: DataFrame, since: str, until: str) -> DataFrame:
    """gate, state (ok, warn, stop): malformed share (5 %, 20 %), ranges loaded, records cover the period."""
    m = malformed(parsed).select("ratio", "refuse")
    ok = parsed.where("parsed").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    m = m.withColumns({"ranges": cidr.agg(F.count("*")).scalar(), "a": ok.select("a").scalar(), "b": ok.select("b").scalar()})
    state = {
        "malformed": F.when(F.col("refuse"), "stop").when(F.col("ratio") >= 0.05, "warn").otherwise("ok"),
        "ranges": F.when(F.col("ranges") > 0, "ok").otherwise("stop"),
        "period": F.when((F.col("a") <= F.lit(since).cast("date")) & (F.col("b") >= F.lit(until).cast("date")), "ok").otherwise("warn"),
    }
    return m.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("state")) for k, v in state.items()))).alias("g")).select("g.*")
