"""Exact ranks without gathering a group."""

import random
from collections import Counter, defaultdict

from beaconlake.operators import logs, surveys


def gathers(df):
    return "collect_list" in df._jdf.queryExecution().toString()


def test_response_times_count_before_they_rank(spark):
    rng = random.Random(5)
    rows = [(b, rng.choice([None, 0.04, 0.05, *(rng.uniform(0, 9) for _ in range(4))])) for b in ["a"] * 500 + ["b"] * 3 + ["c"] for _ in range(2)] + [("d", None), ("e", 7.26)]
    found = logs.response_times(spark.createDataFrame(rows, "bot string, rt_ms double"), "bot")
    assert found.columns == ["bot", "n", "mean_ms", "p50", "p90", "p99"] and not gathers(found)
    by = defaultdict(list)
    for b, t in rows:
        if t is not None:
            by[b].append(t)
    got = {r.bot: r for r in found.collect()}
    assert sorted(got) == sorted(by) and "e" in by
    for b, ts in by.items():
        v, r = sorted(ts), got[b]
        assert r.n == len(v) and abs(r.mean_ms - sum(v) / len(v)) < 6e-4
        assert all(abs(r[f"p{int(s * 100)}"] - v[min(int(len(v) * s), len(v) - 1)]) < 0.0501 for s in (0.5, 0.9, 0.99))


def test_repetitions_count_before_they_rank(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(9), rng.choice("xyz")) for _ in range(300)]
    found = surveys.repetitions(spark.createDataFrame(rows, "prompt_id long, engine string"))
    n = sorted(Counter(rows).values())
    assert not gathers(found) and [tuple(r) for r in found.collect()] == [(len(n), n[0], n[-1], n[len(n) // 2])]
    assert [tuple(r) for r in surveys.repetitions(spark.createDataFrame([], "prompt_id long, engine string")).collect()] == [(0, None, None, None)]
