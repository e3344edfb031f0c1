"""Importance resampling towards a target's word distribution, over an integer word dictionary.

Texts are read in blocks of about ``block_bytes``. A block numbers its distinct words and keeps its distinct n-grams as
tuples of these numbers, and each document as (n-gram, count). Then, on tables that have a row for each word or n-gram of a
block and none for each occurrence,

1. the blocks' words become the dictionary, a written table (word, id); joined back it turns a block's numbers into ids;
2. n-grams are tuples of ids; they are counted over all blocks of the documents and of the target;
3. each distinct tuple's bytes are put together from the dictionary and hashed once, to its bucket;
4. a bucket's gain is joined back to the tuples, and a block's gains to the block, whose documents are then summed.

A word is at most once in a block, however often documents repeat it, so no key is hot. Only the totals of the buckets
(``buckets`` rows) are broadcast. Ranks come from a range partitioning by score and the sizes of its partitions.

Null texts have no words, no features and weight 0. A null id hashes as the empty string and comes first among ties.
Repeated ids are drawn row by row; equal rows tie and share out the ranks. A text longer than a block is a block of its own.
Other columns, of any name, are ignored in both tables. With an empty target every bucket has t = T = 0; without documents
the result is empty.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, ship, written

_DOC = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.binary())), ("tuples", pa.list_(pa.list_(pa.int32()))), ("totals", pa.list_(pa.int64())), ("docs", pa.list_(_DOC))])
BLOCKS = "block long, words array<binary>, tuples array<array<int>>, totals array<long>, docs array<struct<doc_id: long, n_words: long, grams: binary, counts: binary>>"


def encode(n: int, block_bytes: int, keep_docs: bool):
    """For mapInArrow over (doc_id, text): a row for each block, see BLOCKS. totals: how often the block's documents have the tuple."""

    def blocks(batches):
        first, made, held = TaskContext.get().partitionId() << 33, 0, 0
        words, grams, totals, docs = {}, {}, [], []

        def out():
            if n == 1:
                grams.update(((i,), i) for i in range(len(words)))
            values = [[first + made], [list(words)], [[list(g) for g in grams]], [totals], [docs if keep_docs else []]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = text.as_py()
                found = alnum_words(raw)
                if n == 1:
                    count = Counter(found)
                    at = [words.setdefault(w, len(words)) for w in count]
                else:
                    ids = [words.setdefault(w, len(words)) for w in found]
                    count = Counter(chain.from_iterable(zip(*(ids[j:] for j in range(g)), strict=False) for g in range(1, n + 1)))
                    at = [grams.setdefault(g, len(grams)) for g in count]
                totals += [0] * (max(len(words) if n == 1 else 0, len(grams)) - len(totals))
                for i, c in zip(at, count.values(), strict=True):
                    totals[i] += c
                if keep_docs:
                    docs.append({"doc_id": doc_id, "n_words": len(found), "grams": np.array(at, "<i4").tobytes(), "counts": np.array(list(count.values()), "<i4").tobytes()})
                held += len(raw or b"") + 64
                if held >= block_bytes:
                    yield out()
                    words, grams, totals, docs = {}, {}, [], []
                    made, held = made + 1, 0
        if held:
            yield out()

    return blocks


def weigh(batches):
    """Documents of joined blocks: their features and the sum of the features' gains."""
    for b in batches:
        for gains, docs in zip(b.column("gains").to_pylist(), b.column("docs"), strict=True):
            gain, rows = np.array(gains or [], np.int64), docs.as_py()
            counts = [np.frombuffer(d["counts"], "<i4").astype(np.int64) for d in rows]
            weights = [int(gain[np.frombuffer(d["grams"], "<i4")] @ c) for d, c in zip(rows, counts, strict=True)]
            values = [d["doc_id"] for d in rows], [d["n_words"] for d in rows], [int(c.sum()) for c in counts], weights
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document; runs of 1 to n words, joined by one space, are features."""
    ship(docs.sparkSession)

    def read(df: DataFrame, doc_id: str | None) -> DataFrame:
        text = F.col(text_col).cast("string").cast("binary").alias("text")
        key = (F.col(doc_id) if doc_id else F.lit(None)).cast("long").alias("doc_id")
        return written(df.select(key, text).mapInArrow(encode(n, block_bytes, doc_id is not None), BLOCKS), "blocks")

    blocks, others = read(docs, id_col), read(target, None)
    both = blocks.select("block", "words", "tuples", "totals", F.lit(False).alias("target")).unionByName(others.select("block", "words", "tuples", "totals", F.lit(True).alias("target")))
    words = both.select("block", "target", F.posexplode("words").alias("at", "word"))
    dictionary = written(words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("id")), "dictionary")
    numbered = words.join(dictionary, "word").groupBy("block", "target").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"))
    of_block = both.select("block", "target", "tuples", "totals").join(numbered, ["block", "target"])
    each = F.transform("tuples", lambda x, k: F.struct(k.alias("k"), F.transform(x, lambda i: F.get(F.col("ids.id"), i)).alias("tuple"), F.get("totals", k).alias("n")))
    tuples = of_block.select("block", "target", each.alias("each")).select("block", "target", F.inline("each"))
    tuples = written(tuples, "tuples")
    counted = tuples.groupBy("tuple").agg(F.sum(F.when(~F.col("target"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t"))
    # Of each distinct tuple the bytes are put together, and hashed, once.
    parts = counted.select("*", F.posexplode("tuple").alias("at", "id")).join(dictionary, "id")
    spelled = parts.groupBy("tuple").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    hashed = written(spelled.select("tuple", "s", "t", (F.crc32(F.array_join("w.word", " ").cast("binary")) % buckets).alias("bucket")), "hashed")
    of_bucket = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))  # at most as many rows as there are buckets
    total = of_bucket.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gains = of_bucket.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).alias("gain"))
    known = hashed.join(F.broadcast(gains), "bucket").select("tuple", "gain")
    own = tuples.where(~F.col("target")).select("block", "k", "tuple").join(known, "tuple").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "gain"))).alias("g"))
    joined = blocks.select("block", "docs").join(own.select("block", F.col("g.gain").alias("gains")), "block", "left")
    return joined.select("docs", "gains").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: tuple[int, int], order: list) -> DataFrame:
    """The rows with ``rank``: 1, 2, ... of the first ``share`` of them in this order, else null. No task sees more than a range of the order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("place_", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place_", 33)
    sizes = placed.groupBy(part.alias("part_")).count()  # a row for each partition of the range
    before = F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("before_"), F.floor(F.sum("count").over(Window.partitionBy()) * share[0] / share[1]).alias("drawn_"))
    at = F.col("before_") + F.col("place_").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(F.broadcast(starts), part == F.col("part_"))
    return out.withColumn("rank", F.when(at <= F.col("drawn_"), at)).drop("place_", "part_", "before_", "drawn_")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024, **options) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank.

    score: the weight and Gumbel noise of the seed and the id, so the highest scores are a draw without replacement by the
    weights. share: of the documents with ``min_words`` words or more, the part that is drawn."""
    found = weights(docs, target, **options)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(found.withColumn("score", F.col("weight") + noise).withColumn("row_", F.monotonically_increasing_id()), "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("row_")]
    drawn = ranked(scored.where(F.col("n_words") >= min_words), share, order)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("row_")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose ids were drawn, in all their columns. Ids should be unique: rows that share a drawn one are all there."""
    ids = resample(docs, target, id_col=id_col, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id_")).distinct()
    return docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("drawn_id_")), "left_semi")
