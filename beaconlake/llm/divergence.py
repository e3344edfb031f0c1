"""How far the sources of a language are apart in their words, over integer dictionaries.

For each (lang, source) the smoothed shares p of the language's kept terms (those of at least ``least`` of its documents)
are compared with every other source's and with the language's own, by f = floor((p - q)^2 / (p + q)), in exact integers.

1. A task counts the terms of its documents for each (lang, source), then Spark adds the counts up; documents with the
   term are counted beside, so a language, a source or a term with most of the rows adds a row for each task only.
2. Kept terms are numbered in UTF-8 order within their language, by a range partitioning and the sizes of its partitions;
   a run of ``chunk`` ids is a sorted array. The first terms of the runs (``max_runs`` at most) route counts to runs.
3. A run meets the counts of ``block`` sources: searchsorted gives ids, bincount a dense matrix of sources by ids.
4. Two blocks of a language meet for each run and give partial sums of f for their pairs of sources; and each row of a
   matrix gives its best terms, where equal values are in id order, which is the terms' order.

Null text, lang and source read as ''. A repeated document counts as often as it is there. Languages without kept terms give
value 0 for each pair and no terms. A very long word is a term like any other. Other columns, of any name, are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, utf8, written

#: Bytes after lower-casing A-Z; every byte below 0x80 that is no ASCII letter becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1000  # its cube is the scale of the shares


def terms(text: str | bytes | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return utf8(text).translate(_LETTERS).split()


def count(flush: int = 400_000):
    """For mapInArrow over (lang, source, text): lang, source, term, documents with it, occurrences."""

    def counted(batches):
        df, n, held = {}, {}, 0

        def out():
            rows = [(*key, term, df[key][term], c) for key, found in n.items() for term, c in found.items()]
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "df", "n"])

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                found = Counter(terms(text.as_py()))
                if not found:
                    continue
                own, seen = n.setdefault((lang, source), Counter()), df.setdefault((lang, source), Counter())
                held -= len(own)
                own.update(found)
                seen.update(found.keys())
                held += len(own)
                if held >= flush:
                    yield from out()
                    df, n, held = {}, {}, 0
        yield from out()

    return counted


def shares(counts: np.ndarray, total: np.ndarray, terms_kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms_kept)), digit by digit of base 1000, so nothing overflows below 9 * 10^15."""
    size = total + 2 * terms_kept
    whole, rest = np.divmod(counts + 2, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * SCALE, size)
        whole = whole * SCALE + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _route(bounds, batches):
    """Each count with the run of its term; terms before the first run are in none that is kept."""
    firsts = bounds.value
    for b in batches:
        runs = [bisect_right(firsts.get(lang, ()), term) - 1 for lang, term in zip(b.column("lang").to_pylist(), b.column("term").to_pylist(), strict=True)]
        yield b.append_column("run", pa.array(runs, pa.int64())).filter(pa.array([r >= 0 for r in runs], pa.bool_()))


def _matrix(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a run and a block of sources: the dense counts, sources by terms. left: one row; right: the sources' counts."""
    sources, kept = left.column("sources")[0].as_py(), np.empty(len(left.column("terms")[0]), object)
    kept[:] = left.column("terms")[0].as_py()
    found = np.empty(right.num_rows, object)
    found[:] = right.column("term").to_pylist()
    ids = np.minimum(np.searchsorted(kept, found), len(kept) - 1)
    known = kept[ids] == found if len(found) else np.zeros(0, bool)
    row = {s: i for i, s in enumerate(sources)}
    at = np.array([row[s] for s in right.column("source").to_pylist()], np.int64)
    n = right.column("n").to_numpy()
    cells = (at * len(kept) + ids)[known.astype(bool)]
    dense = np.zeros(len(sources) * len(kept), np.int64)
    np.add.at(dense, cells, n[known.astype(bool)])  # a bincount in integers: its weights would be doubles
    return left.select(["lang", "run", "block"]).append_column("sources", pa.array([sources], pa.list_(pa.string()))).append_column("counts", pa.array([dense.tobytes()], pa.binary()))


def _pairs(batches):
    """Partial sums of f, a run's, between the sources of two blocks."""
    for b in batches:
        out = {c: [] for c in ("lang", "a", "b", "value")}
        for r in b.to_pylist():
            size = len(r["one"]["sources"])
            p, q = (shares(np.frombuffer(x["counts"], np.int64).reshape(len(x["sources"]), -1), np.array(x["totals"], np.int64)[:, None], r["kept"]) for x in (r["one"], r["two"]))
            for i in range(size):
                f = apart(p[i], q).sum(axis=1)
                for j in range(i + 1 if r["same"] else 0, len(q)):
                    for c, v in zip(out.values(), (r["lang"], r["one"]["sources"][i], r["two"]["sources"][j], int(f[j])), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (*[pa.string()] * 3, pa.int64()), strict=True)], list(out))


def _best(top: int):
    """The best terms of each source in a run: f against the language's share, larger ones first, ids of equal ones ascending."""

    def best(batches):
        for b in batches:
            out = {c: [] for c in ("lang", "source", "item", "value")}
            for r in b.to_pylist():
                n = np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1)
                p = shares(n, np.array(r["totals"], np.int64)[:, None], r["kept"])
                q = shares(np.array(r["lang_n"], np.int64), np.int64(r["lang_total"]), r["kept"])
                f = apart(p, q)
                for i, source in enumerate(r["sources"]):
                    ids = np.flatnonzero((n[i] > 0) & (p[i] > q))
                    for k in ids[np.argsort(-f[i][ids], kind="stable")[:top]]:
                        for c, v in zip(out.values(), (r["lang"], source, r["terms"][k], int(f[i][k])), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], list(out))

    return best


def dictionaries(counts: DataFrame, least: int, chunk: int, max_runs: int) -> DataFrame:
    """Runs of kept terms: lang, run, terms (sorted), lang_n (occurrences in the language). A run has ``chunk`` terms, or more if else there were more than max_runs."""
    kept = written(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= least).drop("df"), "kept")
    chunk = max(chunk, -(-kept.count() // max_runs))
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").withColumn("place", F.monotonically_increasing_id()), "placed")
    part, w = F.shiftright("place", 33).alias("part"), Window.partitionBy("lang").orderBy("part")
    sizes = placed.groupBy("lang", part).agg(F.count("*").alias("size"), F.min("place").alias("first"))  # a row for each language and partition
    starts = sizes.select("lang", "part", "first", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = placed.withColumn("part", F.shiftright("place", 33)).join(starts, ["lang", "part"]).withColumn("id", F.col("before") + F.col("place") - F.col("first"))
    runs = ids.groupBy("lang", F.floor(F.col("id") / chunk).alias("run")).agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("t"))
    return written(runs.select("lang", "run", F.col("t.term").alias("terms"), F.col("t.n").alias("lang_n")), "runs")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, chunk: int = 4096, block: int = 64, max_runs: int = 1 << 16) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module."""
    spark = docs.sparkSession
    ship(spark)
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*read, F.col("text").cast("string").cast("binary").alias("text"))
    raw = rows.mapInArrow(count(), "lang string, source string, term binary, df long, n long")
    counts = written(raw.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "counts")
    runs = dictionaries(counts, least, chunk, max_runs)
    bounds: dict[str, list[bytes]] = {}
    for r in runs.select("lang", "run", F.col("terms")[0].alias("first")).orderBy("lang", "run").toLocalIterator():  # max_runs at most, and one for each language
        bounds.setdefault(r.lang, []).append(bytes(r.first))
    shipped = spark.sparkContext.broadcast(bounds)
    routed = counts.select("lang", "source", "term", "n").mapInArrow(lambda batches: _route(shipped, batches), "lang string, source string, term binary, n long, run long")
    # The groups, numbered in their language, in blocks; also those without terms.
    groups = written(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")
    numbered = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / block)).drop("docs")
    numbered = written(numbered, "numbered")
    blocks = numbered.groupBy("lang", "block").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    left = runs.select("lang", "run", "terms").join(blocks, "lang").select("sources", "terms", *(F.col(c).alias(c) for c in ("lang", "run", "block")))
    right = routed.join(numbered, ["lang", "source"]).select("source", "term", "n", *(F.col(c).alias(c) for c in ("lang", "run", "block")))
    key = ["lang", "run", "block"]
    dense = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_matrix, "lang string, run long, block long, sources array<string>, counts binary")
    dense = written(dense, "dense")
    # Totals over kept terms: of the sources from the matrices, of the languages from the dictionary.
    kept = runs.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"), F.sum(F.aggregate("lang_n", F.lit(0).cast("long"), lambda x, y: x + y)).alias("lang_total"))
    sums = dense.mapInArrow(_totals, "lang string, block long, totals array<struct<at: int, n: long>>")
    sums = sums.select("lang", "block", F.explode("totals").alias("t")).groupBy("lang", "block", "t.at").agg(F.sum("t.n").alias("n"))
    totals = sums.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("t")).select("lang", "block", F.col("t.n").alias("totals"))
    dense = written(dense.join(totals, ["lang", "block"]).join(kept, "lang"), "weighted")
    side = F.struct("sources", "counts", "totals")
    one = dense.select("lang", "run", "kept", F.col("block").alias("i"), side.alias("one"))
    two = dense.select("lang", "run", F.col("block").alias("j"), side.alias("two"))
    met = one.join(two, ["lang", "run"]).where("i <= j").select("lang", "kept", "one", "two", (F.col("i") == F.col("j")).alias("same"))
    sums = met.mapInArrow(_pairs, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    # Languages without kept terms: every pair has value 0.
    bare = groups.join(kept, "lang", "left_anti").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = both.union(zero).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    best = dense.join(runs, ["lang", "run"]).select("lang", "sources", "counts", "totals", "kept", "lang_total", "terms", "lang_n").mapInArrow(_best(top), "lang string, source string, item binary, value long")
    named = best.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)
    return pairs.union(named)


def _totals(batches):
    for b in batches:
        sums = [np.frombuffer(c, np.int64).reshape(len(s), -1).sum(axis=1) for c, s in zip(b.column("counts").to_pylist(), b.column("sources").to_pylist(), strict=True)]
        rows = [[{"at": i, "n": int(n)} for i, n in enumerate(x)] for x in sums]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("block"), pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())])))], ["lang", "block", "totals"])
