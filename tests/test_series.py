"""Seeded shuffles against the plain loop, gaps in the control, the verdict's conclusions, p values."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from beaconlake.functions import stats
from beaconlake.operators import series as S

DAY = datetime.date(2024, 1, 1)


def rows(spark, series):
    data = [(name, DAY + datetime.timedelta(i), float(v)) for name, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "series_id string, d date, v double")


def plain(before, after, rounds, seed=20260101):
    if min(len(before), len(after)) < 2:
        return None
    pool, k, rng, hits = [*before, *after], len(before), random.Random(seed), 0
    seen = abs(statistics.fmean(after) - statistics.fmean(before))
    for _ in range(rounds):
        rng.shuffle(pool)
        hits += abs(statistics.fmean(pool[k:]) - statistics.fmean(pool[:k])) >= seen - 1e-12
    return round((hits + 1) / (rounds + 1), 4)


@pytest.mark.parametrize(("rounds", "block"), [(500, 60), (500, 500), (37, 250)])
def test_dealt_rounds_are_one_loop(spark, rounds, block):
    rng = random.Random(4)
    shifts = {"a": 0, "b": 3, "c": 0.5, "d": 9}
    treated = {k: [rng.choice([1, 2, 2, 5]) + (s if i >= 20 else 0) for i in range(40)] for k, s in shifts.items()}
    treated |= {"short": [1, 2, 3] + [None] * 30 + [5, 6], "one side": [1, 2, 3], "even": [2.0] * 40, "odd": [rng.random() for _ in range(33)]}
    control = [rng.choice([1, 2, 3]) if i % 11 else None for i in range(40)]
    found = {r.series_id: r.p for r in S.permutation_p(rows(spark, treated), rows(spark, {"x": control}), "2024-01-21", rounds=rounds, block=block).collect()}
    c = [x or 0.0 for x in control]
    mean = statistics.fmean(x for x in control[:20] if x is not None)
    for k, values in treated.items():
        v = [(i, x) for i, x in enumerate(values) if x is not None]
        b = [x for i, x in v if i < 20]
        scale = sum(b) / len(b) / mean
        diff = [[x - scale * c[i] for i, x in v if (i < 20) == first] for first in (True, False)]
        assert found[k] == plain(*diff, rounds), k
    assert found["d"] < 0.05 < found["a"] and found["one side"] is None


def test_days_without_control_count_as_none(spark):
    treated, control = rows(spark, {"t": [10.0] * 10 + [20.0] * 10}), rows(spark, {"c": [5.0] * 10 + [5.0] * 5 + [None] * 5})
    (r,) = S.difference(treated, control, "2024-01-11").collect()
    assert (r.days_before, r.days_after, r.treated_pct, r.control_pct, r.points) == (10, 10, 100.0, 0.0, 100.0)
    assert r.per_day == pytest.approx((20 - 2 * 2.5) - (10 - 2 * 5))  # five of ten days lack the control


@pytest.mark.parametrize(
    ("p", "treated", "control", "want"),
    [
        (0.01, 0, None, ("consistent_with_the_action", "moderate", True)),
        (0.2, 0, None, ("no_detectable_effect", "none", True)),
        (0.01, 5, 7, ("market_wide_movement", "moderate", True)),
        (0.01, 20, None, ("consistent_with_the_action", "moderate", False)),
        (0.01, None, 1, ("consistent_with_the_action", "moderate", False)),
    ],
)
def test_conclusions(spark, p, treated, control, want):
    did = spark.createDataFrame([(40, 40, 900.0, 900.0, 30.0, 2.0, 28.0, p)], "days_before int, days_after int, total_before double, total_after double, treated_pct double, control_pct double, points double, p double")
    points = spark.createDataFrame([(s, DAY + datetime.timedelta(n)) for s, n in (("treated", treated), ("control", control)) if n is not None] + [("none", DAY)], "side string, d date")
    (r,) = S.conclude(did, "p", points, "2024-01-01").collect()
    assert (r.verdict, r.confidence, r.coincides) == want


def test_p_of_z_to_twelve_digits(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, 2.5, 4.2426406, 4.2426407, 5.0, 7.0, 12.0, 25.0, -1.5]
    found = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_p(F.col("z")).alias("p")).collect()
    for r in found:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11, abs=1e-14), r.z
