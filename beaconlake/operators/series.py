"""Daily series: totals, movers, change points, difference in differences, verdicts."""

from __future__ import annotations

import math
import random
from array import array
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..storage import stored


def trim(series: DataFrame, n: int) -> DataFrame:
    """Without the n last rows of each series."""
    return series.withColumn("r_", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("d")))).where(F.col("r_") > n).drop("r_")


def totals(perf: DataFrame, by: list[str]) -> DataFrame:
    """Clicks, impressions, unweighted mean position and click rate in percent."""
    return perf.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("position").alias("position")).withColumn("ctr", F.try_divide(F.col("clicks") * 100.0, F.col("impressions")))


def weekly(series: DataFrame) -> DataFrame:
    """Sums of seven rows each, from the first one on."""
    week = F.floor((F.row_number().over(Window.partitionBy("series_id").orderBy("d")) - 1) / 7)
    return series.withColumn("week", week.cast("long")).groupBy("series_id", "week").agg(F.min("d").alias("start"), F.count("*").alias("days"), F.sum("v").alias("v"))


def movers(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Difference of v by key; a key that one side lacks counts as 0."""
    b, a = before.groupBy(key).agg(F.sum("v").alias("before")), after.groupBy(key).agg(F.sum("v").alias("after"))
    out = b.join(a, key, "full_outer").fillna(0.0, ["before", "after"])
    return out.withColumn("change", F.col("after") - F.col("before"))


def changepoint(series: DataFrame, least: int = 7, limit: float = 3.0) -> DataFrame:
    """The date that best splits each series (Welch statistic, both sides have ``least`` rows or more), if it reaches the limit.

    Prefix sums of the values and squares, centred first, make it linear in the rows."""
    whole = Window.partitionBy("series_id")
    upto = whole.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    x = series.withColumn("x", F.col("v") - F.avg("v").over(whole))
    p = x.select("series_id", "d", F.count("x").over(upto).alias("n1"), F.sum("x").over(upto).alias("s1"), F.sum(F.col("x") ** 2).over(upto).alias("q1"), F.count("x").over(whole).alias("n"), F.sum("x").over(whole).alias("s"), F.sum(F.col("x") ** 2).over(whole).alias("q"))
    p = p.withColumns({"n2": F.col("n") - F.col("n1"), "s2": F.col("s") - F.col("s1"), "q2": F.col("q") - F.col("q1")}).where((F.col("n1") >= least) & (F.col("n2") >= least))
    var = lambda i: F.greatest(F.lit(0.0), (F.col(f"q{i}") - F.col(f"s{i}") ** 2 / F.col(f"n{i}")) / (F.col(f"n{i}") - 1)) / F.col(f"n{i}")
    stat = F.when(var(1) + var(2) > 0, F.abs(F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")) / F.sqrt(var(1) + var(2))).otherwise(0.0)
    best = p.withColumn("stat", F.round(stat, 9)).groupBy("series_id").agg(F.max_by("d", F.struct(F.col("stat"), -F.unix_date("d"))).alias("d"), F.max("stat").alias("stat"))
    return best.where(F.col("stat") >= limit)


def split(series: DataFrame, action: str, lag: int) -> DataFrame:
    """Adds side: 0 before the action, 1 from ``lag`` days after it, null between."""
    a = F.lit(action).cast("date")
    return series.withColumn("side", F.when(F.col("d") < a, 0).when(F.col("d") >= F.date_add(a, lag), 1))


def gaps(treated: DataFrame, control: DataFrame) -> DataFrame:
    """One row: how many days only one of the two series has."""
    both = treated.select("d", F.lit(1).alias("t")).join(control.select("d", F.lit(1).alias("c")), "d", "full_outer")
    return both.agg(F.count_if(F.col("t").isNull() | F.col("c").isNull()).alias("gaps"))


def top_movers(moved: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys that fell most and the k that rose most, with direction and rank."""
    ranked = lambda order, name: moved.orderBy(order, key).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(order, key))).withColumn("direction", F.lit(name))
    return ranked(F.asc("change"), "down").unionByName(ranked(F.desc("change"), "up"))


def window_before(start: str, end: str) -> tuple[str, str]:
    """First and last day of the window of equal length that ends the day before start."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return (a - ((b - a) + timedelta(days=1))).isoformat(), (a - timedelta(days=1)).isoformat()


def between(series: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The days from start to end, both included; None is open."""
    out = series if start is None else series.where(F.col("d") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("d") <= F.lit(end).cast("date"))


def describe(series: DataFrame, action: str, lag: int = 0) -> DataFrame:
    """One row for each series: days, total and mean on both sides of an action, their change in percent, first and last day."""
    side = lambda i, f, c="v": f(F.when(F.col("side") == i, F.col(c)))
    m = split(series, action, lag).groupBy("series_id").agg(
        F.count_if(F.col("side") == 0).alias("days_before"), F.count_if(F.col("side") == 1).alias("days_after"), side(0, F.sum).alias("total_before"), side(1, F.sum).alias("total_after"),
        side(0, F.avg).alias("mean_before"), side(1, F.avg).alias("mean_after"), side(0, F.min, "d").alias("start"), side(1, F.max, "d").alias("end"),
    )
    return m.withColumn("pct_change", stats.pct_change(F.col("mean_after"), F.col("mean_before")))


def difference(treated: DataFrame, control: DataFrame, action: str, lag: int = 0) -> DataFrame:
    """Difference in differences over the treated days: a row. A day that the control lacks counts as 0; the control is scaled to the treated mean before the action, by the means of its own days."""
    filled = control.select("d", F.col("v").alias("c"))
    both = split(treated.select("d", F.col("v").alias("t")).join(filled, "d", "left").fillna(0.0, ["c"]), action, lag)
    side = lambda c, i, f: f(F.when(F.col("side") == i, F.col(c)))
    m = both.agg(*(side(c, i, F.avg).alias(f"{n}{i}") for c, n in (("t", "t"), ("c", "f")) for i in (0, 1)), F.count_if(F.col("side") == 0).alias("days_before"), F.count_if(F.col("side") == 1).alias("days_after"), side("t", 0, F.sum).alias("total_before"), side("t", 1, F.sum).alias("total_after"))
    own = split(control, action, lag).agg(*(side("v", i, F.avg).alias(f"c{i}") for i in (0, 1)))
    m = m.crossJoin(own)  # one row each
    tp, cp = stats.pct_change(F.col("t1"), F.col("t0")), stats.pct_change(F.col("c1"), F.col("c0"))
    scale = F.coalesce(F.try_divide("t0", "c0"), F.lit(1.0))
    return m.withColumns({"treated_pct": tp, "control_pct": cp, "points": F.round(tp - cp, 1), "per_day": (F.col("t1") - scale * F.col("f1")) - (F.col("t0") - scale * F.col("f0"))})


def shuffle_states(sizes: DataFrame, rounds: int, block: int, seed: int) -> DataFrame:
    """(n, block, first, rounds, order, state): of the seeded shuffles of a list of n, what a task needs to go on from each ``block`` rounds on.

    sizes: n, distinct. A shuffle's draws depend on n alone, so the states of one n serve every series of that length; what
    the shuffles do to the list before a block is its order."""

    def states(batches):
        for b in batches:
            for n in b.column("n").to_pylist():
                rng, order, rows = random.Random(seed), list(range(n)), []
                for first in range(0, rounds, block):
                    rows.append((n, first // block, min(block, rounds - first), array("i", order).tobytes(), array("L", rng.getstate()[1]).tobytes()))
                    for _ in range(min(block, rounds - first)):
                        rng.shuffle(order)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["n", "block", "rounds", "order", "state"])

    return sizes.select(F.col("n").cast("long")).mapInArrow(states, "n long, block long, rounds long, order binary, state binary")


def permutation_p(treated: DataFrame, control: DataFrame, action: str, lag: int = 0, rounds: int = 5000, seed: int = 20260101, block: int = 250) -> DataFrame:
    """(series_id, p): for each treated series the p of the difference between the sides' means of treated minus scaled control, by seeded shuffles: (hits + 1) / (rounds + 1). Null where a side has fewer than two days.

    The rounds are dealt out in blocks, each of which goes on where the one before ends (see shuffle_states), so the hits are
    those of one loop over all rounds. Tasks get (series, block) ordered by length and block, and shuffle the places of a length
    once for all series that have it. A series (some hundred days) is one row."""
    c = control.select("d", F.col("v").alias("c"))
    rows = split(treated.join(c, "d", "left").fillna(0.0, ["c"]), action, lag).where("side is not null")
    own = split(control, action, lag).agg(F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("control_mean"))
    means = rows.groupBy("series_id").agg(F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("mean")).crossJoin(own)  # one row
    scale = F.when(F.coalesce(F.col("control_mean"), F.lit(0.0)) != 0, F.col("mean") / F.col("control_mean")).otherwise(1.0)
    lists = rows.join(means, "series_id").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("d", "side", (F.col("v") - scale * F.col("c")).alias("x")))).alias("x"))
    lists = lists.select("series_id", F.col("x.x").alias("x"), F.size(F.filter("x", lambda r: r["side"] == 0)).cast("long").alias("before"), F.size("x").cast("long").alias("n"))
    enough = (F.col("before") >= 2) & (F.col("n") - F.col("before") >= 2)
    good = stored(lists.where(enough), "lists")
    dealt = good.join(stored(shuffle_states(good.select("n").distinct(), rounds, block, seed), "states"), "n")
    parts = int(treated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "n", "block", F.pmod(F.xxhash64("series_id"), F.lit(8))).sortWithinPartitions("n", "block")

    def hits(batches):
        key, places = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if key != (r["n"], r["block"]):
                    key, rng, order = (r["n"], r["block"]), random.Random(), array("i", r["order"]).tolist()
                    rng.setstate((3, tuple(array("L", r["state"])), None))
                    places = np.empty((r["rounds"], r["n"]), np.int32)
                    for i in range(r["rounds"]):
                        rng.shuffle(order)
                        places[i] = order
                x, k = np.array(r["x"]), r["before"]
                apart = lambda v, k=k: abs(math.fsum(v[k:]) / (len(v) - k) - math.fsum(v[:k]) / k)
                seen = apart(x) - 1e-12
                shuffled = x[places]
                rough = np.abs(shuffled[:, k:].mean(axis=1) - shuffled[:, :k].mean(axis=1))
                close = np.abs(rough - seen) <= 1e-9 * (1 + np.abs(x).max())  # decided by exact sums
                out.append((r["series_id"], int((rough[~close] >= seen).sum()) + sum(apart(v) >= seen for v in shuffled[close])))
            ids, n = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(n, pa.int64())], ["series_id", "hits"])

    counted = dealt.select("series_id", "n", "block", "rounds", "order", "state", "x", "before").mapInArrow(hits, "series_id string, hits long")
    p = counted.groupBy("series_id").agg(F.round((F.sum("hits") + 1) / (rounds + 1), 4).alias("p"))
    return p.unionByName(lists.where(~enough).select("series_id", F.lit(None).cast("double").alias("p")))


def conclude(did: DataFrame, p: str, points: DataFrame, action: str, min_days: int = 28, noisy: float = 200) -> DataFrame:
    """Adds verdict, confidence and coincides. points: change points (side: treated or control, d).

    A change point of the treated series within 7 days of the action coincides with it; one that the control has within 3
    days of it makes an effect a movement of the market."""
    out = verdict(did, p)
    one = lambda side: points.where(F.col("side") == side).agg(F.min("d")).scalar()
    out = out.withColumns({"t_": one("treated"), "c_": one("control")})
    near = F.coalesce(F.abs(F.date_diff("t_", F.lit(action).cast("date"))) <= 7, F.lit(False))
    shared = F.coalesce(F.abs(F.date_diff("t_", "c_")) <= 3, F.lit(False))
    effect = F.col("verdict") == "consistent_with_the_action"
    sure = F.when(~effect, "none").when((F.col("days_after") >= min_days) & (F.col("total_after") >= noisy), "moderate").otherwise("low")
    out = out.withColumns({"confidence": sure, "coincides": near, "s_": shared})
    return out.withColumn("verdict", F.when(effect & F.col("s_"), "market_wide_movement").otherwise(F.col("verdict"))).drop("t_", "c_", "s_")


def verdict(did: DataFrame, p: str | None = None, min_days: int = 14, min_total: float = 50, effect: float = 5.0, market: float = 20.0) -> DataFrame:
    """Adds verdict: refusals come before any statistic."""
    few = (F.col("days_before") < min_days) | (F.col("days_after") < min_days) | (F.least("total_before", "total_after") < min_total)
    strong = (F.abs("points") >= effect) & ((F.col(p) < 0.05) if p else F.lit(True))
    same = (F.col("treated_pct") * F.col("control_pct") > 0) & (F.abs("control_pct") >= market)
    return did.withColumn("verdict", F.when(few, "insufficient_data").when(F.col("control_pct").isNull(), "no_control").when(strong, "consistent_with_the_action").when(same, "market_wide_movement").otherwise("no_detectable_effect"))
