"""Rates, intervals and series statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import Z


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 0) without observations."""
    n_, z = n.cast("double"), F.lit(Z)
    p = k / n_
    d = 1 + z * z / n_
    mid = (p + z * z / (2 * n_)) / d
    half = z / d * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    return tuple(F.when(n == 0, 0.0).otherwise(x) for x in (F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """95 % interval of the second share minus the first."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1 / n1, k2 / n2
    d = p2 - p1
    return d - F.sqrt((p2 - l2) ** 2 + (u1 - p1) ** 2), d + F.sqrt((u2 - p2) ** 2 + (p1 - l1) ** 2)


def pooled_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """z of two shares with the pooled variance; 0 where it has none."""
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.when((n1 == 0) | (n2 == 0) | (se == 0), 0.0).otherwise((k2 / n2 - k1 / n1) / se)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to about 1e-14: up to 3 by the series of erf whose terms are all positive, beyond by its continued fraction."""
    two = 2 / math.sqrt(math.pi)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    near = 1 - two * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(70)), start, add, lambda acc: acc["sum"])
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda acc, i: i / 2 / (x + acc))
    return F.when(x <= 3, near).otherwise(two / 2 * F.exp(-x * x) / (x + below))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return erfc(F.abs(z) / math.sqrt(2))


def noise_floor(n1: Column, n2: Column) -> Column:
    """The difference that two samples of these sizes can show by chance."""
    return F.when((n1 == 0) | (n2 == 0), 1.0).otherwise(F.least(F.lit(1.0), F.lit(Z) * F.sqrt(0.25 * (1 / n1 + 1 / n2))))


def pct_change(new: Column, old: Column) -> Column:
    return F.round(F.try_divide((new - old) * 100.0, F.abs(old)), 1)


def at_rank(values: Column, share: float) -> Column:
    """The value at floor(share * n) of the sorted values (from 0), the last one at most."""
    v = F.array_sort(values)
    return F.get(v, F.least(F.floor(F.size(v) * share), F.size(v) - 1).cast("int"))


def at_rank_of_counts(value: Column, upto: Column, n: Column, share: float) -> Column:
    """An aggregate: at_rank of values that are counted (upto: how many there are up to each value, n: of all)."""
    return F.min(F.when(upto > F.least(F.floor(n * share), n - 1), value))


def upper_median(values: Column) -> Column:
    return at_rank(values, 0.5)
