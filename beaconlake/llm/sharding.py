"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows are written once with a stable number (input partition and position). From the counts of the input partitions
the driver draws how many rows each partition sends to each shard: row by row a multivariate hypergeometric draw from
the places still free, which is the law of a uniform permutation cut into shards. Inside a partition a seeded
permutation decides which rows those are (the local permutation), one exchange moves them, and inside a shard rows are
ordered by a 64-bit hash of their number (the second permutation). A shard is never one task: the hash's first bits cut
it into blocks, whose counts give each block's first slot.

Shard sizes differ by one at most. Nulls, empty and very long texts, repeated rows and extra columns travel unchanged:
only the number of a row counts; equal hashes are ordered by it. An empty table gives an empty result. Input partitions beyond ``max_parts`` are drawn as one, so
the matrix has at most ``max_parts * n_shards`` entries however large the input is.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, ship, written


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn are good. numpy's draw stops at 10**9; beyond it see by_ratios."""
    if not n or not good:
        return 0
    if not bad:
        return n
    return int(rng.hypergeometric(good, bad, n)) if good + bad < 10**9 else by_ratios(rng, good, bad, n)


def by_ratios(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for any sizes, by the inverse of the distribution.

    Chances are taken relative to that of the mode, as running products of the exact ratios of neighbours, up and down
    until they are below 2**-80 of it; a draw falls beyond with less than 2**-60, and its chances are right to about 10**-11."""
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    span = 64 + 4 * math.isqrt(mode * (n - mode) // n + 1)

    def side(step: int, end: int) -> np.ndarray:
        parts, at, last = [], mode, 1.0
        while at != end and last > 2.0**-80:
            x = np.arange(at, at + step * min(span, abs(end - at)), step)
            up, down = (good - x.astype(float)) * (n - x), (x + 1.0) * (bad - n + x + 1.0)
            if step < 0:
                up, down = x.astype(float) * (bad - n + x), (good - x + 1.0) * (n - x + 1.0)
            parts.append(last * np.cumprod(up / down))
            at, last = at + step * len(x), parts[-1][-1]
        return np.concatenate(parts) if parts else np.empty(0)

    above, below = side(1, hi), side(-1, lo)
    chance = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(chance)
    return mode - len(below) + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """[partition, shard] counts: rows sum to sizes, columns to shard sizes that differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    free = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    left = total
    out = np.zeros((len(sizes), n_shards), np.int64)
    for p, size in enumerate(sizes):
        need, rest = size, left
        for s in range(n_shards):
            rest -= free[s]
            out[p, s] = x = hypergeometric(rng, free[s], rest, need) if s < n_shards - 1 else need
            need -= x
            free[s] -= x
        left -= size
    return out


def size_of(df: DataFrame) -> Column:
    """About the bytes of a row: texts and binaries by their length, other columns of variable size as JSON, 8 for the rest."""
    found = F.lit(16)
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary", "varchar", "char"):
            found = found + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            found = found + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            found = found + 8
    return found.cast("long")


def shuffle_to_shards(df: DataFrame, n_shards: int, seed: int = 0, block_bytes: int = 1 << 25, max_parts: int = 4096) -> DataFrame:
    """The rows with columns shard (int, from 0) and slot (long, gapless from 0 in each shard); names get a leading underscore if they are taken.

    A block has about block_bytes, so what one task sorts doesn't grow with the table."""
    spark = df.sparkSession
    ship(spark)
    shard, slot, row, part, block, start = (free_name(df, x) for x in ("shard", "slot", "row_number_", "part_", "block_", "first_slot_"))
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = F.shiftright(row, 33)
    counted = rows.groupBy(own.alias("p")).agg(F.count("*").alias("n"), F.sum(size_of(df)).alias("b")).collect()  # two numbers for each input partition
    sizes = {r.p: r.n for r in counted}
    group = -(-(max(sizes, default=0) + 1) // max_parts)
    merged: dict[int, int] = {}
    first: dict[int, int] = {}  # where an input partition begins in its group
    for p in sorted(sizes):
        first[p] = merged.get(p // group, 0)
        merged[p // group] = first[p] + sizes[p]
    order = sorted(merged)
    matrix = dict(zip(order, communication_matrix([merged[g] for g in order], n_shards, seed), strict=True))

    def dealt(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: tuple = (None, None)
        for x in numbers:
            x = x.to_numpy()
            p, at = x >> 33, x & ((1 << 33) - 1)
            out = np.empty(len(x), np.int32)
            for q in np.unique(p):
                g = int(q) // group
                if held[0] != g:
                    labels = np.repeat(np.arange(n_shards, dtype=np.int32), matrix[g])
                    np.random.default_rng([seed, 1, g]).shuffle(labels)
                    held = (g, labels)
                here = p == q
                out[here] = held[1][first[int(q)] + at[here]]
            yield pd.Series(out)

    to_shard = F.pandas_udf(dealt, "int")
    total = sum(r.b for r in counted)
    blocks = max(1, -(-total // n_shards // block_bytes))
    key = F.xxhash64(F.lit(seed), F.col(row))
    cut = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(row)), F.lit(blocks))
    counts = rows.select(row).select(to_shard(row).alias(shard), cut.alias(block)).groupBy(shard, block).agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    before = counts.selectExpr(f"`{shard}`", f"`{block}`", f"sum(n) over (partition by `{shard}` order by `{block}`) - n as `{start}`")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards * blocks)
    in_block = Window.partitionBy(shard, block).orderBy(part, row)
    return (
        rows.withColumn(shard, to_shard(row))
        .withColumn(block, cut)
        .repartition(min(tasks, 100_000), shard, block)
        .join(before, [shard, block])
        .withColumn(part, key)
        .withColumn(slot, (F.row_number().over(in_block) - 1 + F.col(start)).cast("long"))
        .select(*df.columns, shard, slot)
    )
