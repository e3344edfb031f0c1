"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

Examples are labelled documents that may be learned from: those with the smallest hash of their id, at most
``max_examples`` of them and of ``max_bytes`` of text together (whole texts); equal texts are one example with counts of
both labels. Terms are all words of the examples, and beginnings of words of 4 to 7 bytes (compounds share these) that tell
the labels apart. A term weighs (1 + ln tf) * idf, and idf is ln((1 + n) / (1 + df)) times 0.02 + phi, where phi is the
correlation of the term with the label (0 to 1): every word counts, telling ones count more. Vectors have length 1.

Everything over the examples is counted by Spark: term frequencies, document frequencies by label, weights and lengths; the
driver only gets the finished postings, whose size the two bounds limit. The most frequent terms are held as a dense matrix
(their cosines are one product for a batch of texts); the others are posting lists, cut into blocks of examples with the
largest weight of each block. A block's bound is its largest dense cosine plus the sum of its largest weights times those of
the text. Blocks are added up in the order of their bounds until the next bound is below the k-th best cosine, so
neighbours are exact.

Votes are weighted by ``sim ** power``; a calibration curve (fitted by leaving each example out) turns the vote into the
share of toxic examples. Evidence: the ids of the five nearest neighbours. A text that shares no term with any example
(an empty text too) gets the share of toxic examples.

Null and empty texts have no terms. Very long texts are taken whole. Labels that are null, or whose id is, are left out; of
several labels of a document the largest counts; other columns of the labels are ignored. Without examples all scores are
0. Equal texts are scored alike, ties of the k-th neighbour are all taken. An empty table gives an empty result. Extra
columns stay; names that are taken get leading underscores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, free_name, ship, written

#: Lengths in bytes of the beginnings of words that can be terms.
STARTS = (4, 5, 6, 7)
TILE_ROWS, TILE_EXAMPLES = 8, 64


class Index:
    """Examples as unit vectors: dense columns of the most frequent terms, posting lists of the others.

    terms, example numbers and weights of the postings come sorted by term and example."""

    def __init__(self, names: list[bytes], idf: np.ndarray, term: np.ndarray, example: np.ndarray, value: np.ndarray, ids: np.ndarray, votes: np.ndarray, k: int, power: float, block: int = 64, dense: int = 256):
        self.k, self.power, self.block, self.idf, self.ids, self.votes = k, power, block, idf, ids, votes
        self.number = {name: i for i, name in enumerate(names)}
        n, df = len(ids), np.bincount(term, minlength=len(names))
        self.column = np.full(len(names), -1, np.int32)
        often = np.argsort(-df, kind="stable")[:dense]
        often = often[df[often] > block]
        self.column[often] = np.arange(len(often))
        here = self.column[term] >= 0
        # [stack, column, example]: products of TILE rows with one of a stack are small enough to stay in one thread.
        self.matrix = np.zeros((-(-n // TILE_EXAMPLES), len(often), TILE_EXAMPLES))
        self.matrix[example[here] // TILE_EXAMPLES, self.column[term[here]], example[here] % TILE_EXAMPLES] = value[here]
        term, self.example, self.value = term[~here], example[~here].astype(np.int32), value[~here]
        # Entries of a term by block: where its postings begin, and the largest of their weights.
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.example[1:] // block != self.example[:-1] // block)]) if len(term) else np.empty(0, np.int64)
        self.entry_start = np.append(at, len(term)).astype(np.int64)
        self.entry_block = (self.example[at] // block).astype(np.int32)
        self.entry_top = np.maximum.reduceat(self.value, at) if len(at) else np.empty(0)
        self.first_entry = np.searchsorted(term[at], np.arange(len(names) + 1))
        self.blocks = -(-n // block)
        self.curve, self.base = ([0.0], [0.0]), 0.0
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def bag(self, text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their unit weights."""
        known, found = self.known, Counter()
        if len(known) > 1 << 18:
            known.clear()
        for w, c in Counter(alnum_words(text)).items():
            terms = known.get(w)
            if terms is None:
                names = (w, *(w[:n] + b"*" for n in STARTS if len(w) > n))
                terms = known[w] = tuple(self.number[x] for x in names if x in self.number)
            for i in terms:
                found[i] += c
        ids = np.fromiter(found.keys(), np.int64, len(found))
        x = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.idf[ids]
        some = x > 0
        ids, x = ids[some], x[some]
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        return ids, x / np.sqrt(x @ x) if len(x) else x

    def neighbours(self, bags: list[tuple[np.ndarray, np.ndarray]], leave_out: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each bag the k nearest examples (more if the last tie) and their cosines, exactly. leave_out: an example for each, that loses one vote."""
        dense = np.zeros((-(-len(bags) // TILE_ROWS) * TILE_ROWS, self.matrix.shape[1]))
        for row, (ids, x) in zip(dense, bags, strict=False):
            c = self.column[ids]
            row[c[c >= 0]] = x[c >= 0]
        near = np.zeros((len(dense), len(self.ids)))
        if dense.size and self.matrix.size:
            for i in range(0, len(dense), TILE_ROWS):
                tile = np.matmul(dense[None, i : i + TILE_ROWS], self.matrix)  # [stack, row, example]
                near[i : i + TILE_ROWS] = tile.transpose(1, 0, 2).reshape(TILE_ROWS, -1)[:, : len(self.ids)]
        return [self._nearest(*bag, sims, None if leave_out is None else leave_out[i]) for i, (bag, sims) in enumerate(zip(bags, near, strict=False))]

    def _nearest(self, ids: np.ndarray, x: np.ndarray, sims: np.ndarray, out: int | None) -> tuple[np.ndarray, np.ndarray]:
        alone = out is not None and self.votes[out].sum() <= 1
        rare = self.column[ids] < 0
        ids, x = ids[rare], x[rare]
        a, b = self.first_entry[ids], self.first_entry[ids + 1]
        entry = _ranges(a, b - a)
        weight = np.repeat(x, b - a)
        block = self.entry_block[entry]
        whole = np.pad(sims, (0, self.blocks * self.block - len(sims)), constant_values=-1.0).reshape(self.blocks, self.block)
        bound = whole.max(1) + np.bincount(block, weight * self.entry_top[entry], self.blocks)
        order, done, kth = np.argsort(-bound, kind="stable"), 0, 0.0
        taken = max(2, -(-2 * self.k // self.block))
        near, cos = np.empty(0, np.int64), np.empty(0)
        while done < len(order) and bound[order[done]] > 0 and (len(near) < self.k or bound[order[done]] >= kth - 1e-12):
            now = order[done : done + taken]
            if len(near) >= self.k:
                now = now[bound[now] >= kth - 1e-12]
            done += len(now)
            mine = np.zeros(self.blocks, bool)
            mine[now] = True
            hit = mine[block]
            e = entry[hit]
            size = self.entry_start[e + 1] - self.entry_start[e]
            p = _ranges(self.entry_start[e], size)
            local = np.flatnonzero(mine)
            row = np.full(self.blocks, -1)
            row[local] = np.arange(len(local))
            j = self.example[p]
            acc = np.bincount(row[j // self.block] * self.block + j % self.block, np.repeat(weight[hit], size) * self.value[p], len(local) * self.block)
            place = (local[:, None] * self.block + np.arange(self.block)).ravel()
            inside = place < len(sims)
            place, acc = place[inside], acc[inside]
            acc = acc + sims[place]
            good = (acc > 0) if not alone else (acc > 0) & (place != out)
            near, cos = np.concatenate([near, place[good]]), np.concatenate([cos, acc[good]])
            if len(near) >= self.k:
                kth = np.partition(cos, -self.k)[-self.k]
            taken *= 2
        keep = cos >= kth - 1e-12
        near, cos = near[keep], cos[keep]
        best = np.lexsort((near, -cos))
        return near[best], cos[best]

    def vote(self, near: np.ndarray, cos: np.ndarray, out: int | None = None, toxic: int = 0) -> float:
        votes = self.votes[near].astype(float)
        if out is not None:
            votes[near == out, toxic] -= 1
        w = np.minimum(cos, 1.0) ** self.power
        yes, no = w @ votes[:, 1], w @ votes[:, 0]
        return float(yes / (yes + no)) if yes + no > 0 else 0.0

    def scores(self, texts: list[str | bytes | None]) -> list[tuple[float, list[int]]]:
        bags = [self.bag(t) for t in texts]
        found = []
        for near, cos in self.neighbours(bags):
            found.append((float(np.interp(self.vote(near, cos), *self.curve)) if len(near) else self.base, self.ids[near[:5]].tolist()))
        return found


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def rising(votes: list[float], truth: list[int], weight: list[float]) -> tuple[list[float], list[float]]:
    """A rising curve through the shares of toxic examples by vote (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, t, w in sorted(zip(votes, truth, weight, strict=True)):
        pools.append([v * w, t * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools] or [0.0], [p[1] / p[2] for p in pools] or [0.0]


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_examples: int, max_bytes: int) -> DataFrame:
    """doc_id, text, toxic of the examples: labelled documents whose crc32 of the id, mod 5, isn't 0, in the order of a hash of their id up to both bounds; a text that doesn't fit any more is passed over, not those after it."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = written(texts.join(F.broadcast(known), "doc_id"), "examples")  # at most max_examples ids are broadcast
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    chosen, held = [], 0
    for r in some.groupBy("doc_id").agg(F.sum(size).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # max_examples numbers
        if held + r["size"] <= max_bytes:
            chosen.append((r["doc_id"],))
            held += r["size"]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    return some.join(F.broadcast(chosen.select("doc_id")), "doc_id")


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all else from U+0080 on, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def build(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, k: int, max_examples: int, max_bytes: int, min_df: int, chi2: float, power: float) -> Index:
    """The index of the examples, counted by Spark."""
    rows = examples(docs, labels, id_col, text_col, max_examples, max_bytes)
    toxic = (F.col("toxic") == 1).cast("long")
    whole = written(rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("id"), F.sum(toxic).alias("yes"), F.count("*").alias("n")), "whole")
    size = whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("yes"), F.lit(0)).alias("t")).first()
    n, t = size["n"], size["t"]
    words = whole.select("id", "yes", "n", F.explode(words_of(F.col("text"))).alias("w")).groupBy("id", "yes", "n", "w").agg(F.count("*").alias("c"))
    raw = F.col("w").cast("binary")
    starts = words.select("id", "yes", "n", "c", F.explode(F.filter(F.array(*(F.when(F.octet_length("w") > b, F.concat(F.substring(raw, 1, b), F.lit(b"*"))) for b in STARTS)), lambda x: x.isNotNull())).alias("term"))
    starts = starts.groupBy("id", "yes", "n", "term").agg(F.sum("c").alias("c"), F.lit(True).alias("start"))
    bags = written(words.select("id", "yes", "n", raw.alias("term"), "c", F.lit(False).alias("start")).unionByName(starts), "bags")
    a, b = F.col("a").cast("double"), F.col("df") - F.col("a")
    low = (a + b) * (F.lit(float(n)) - a - b) * float(t) * float(n - t)
    phi = F.when(low > 0, F.abs(a * (F.lit(float(n - t)) - b) - b * (F.lit(float(t)) - a)) / F.sqrt(low)).otherwise(0.0)
    known = bags.groupBy("term", "start").agg(F.sum("yes").alias("a"), F.sum("n").alias("df")).withColumn("phi", phi)
    known = known.where(~F.col("start") | (F.col("df") >= min_df) & (F.col("phi") * F.col("phi") * n >= chi2))
    known = known.select("term", "start", (F.log((1.0 + n) / (1 + F.col("df"))) * (0.02 + F.col("phi"))).alias("idf")).where("idf > 0")
    known = written(known, "terms")
    weighted = bags.join(known, ["term", "start"]).select("term", "id", ((1 + F.log("c")) * F.col("idf")).alias("x"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    postings = weighted.join(norm, "id").select("term", "id", (F.col("x") / F.col("norm")).alias("x"))
    # From here on sizes are bounded: max_bytes of text have max_bytes / 2 words at most.
    vocabulary = known.select("term", "idf").orderBy("term").toArrow()
    texts = whole.select("id", "yes", "n").orderBy("id").toArrow()
    table = postings.toArrow()
    names = [x.as_py() for x in vocabulary.column("term")]
    ids = texts.column("id").to_numpy()
    votes = np.stack([texts.column("n").to_numpy() - texts.column("yes").to_numpy(), texts.column("yes").to_numpy()], 1) if len(ids) else np.empty((0, 2), np.int64)
    at = {name: i for i, name in enumerate(names)}
    coded = table.column("term").combine_chunks().dictionary_encode() if table.num_rows else None
    term = np.array([at[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if coded is not None else np.empty(0, np.int64)
    example, value = np.searchsorted(ids, table.column("id").to_numpy()), table.column("x").to_numpy()
    # Like examples share blocks: ordered by their strongest term.
    strongest, heaviest = np.zeros(len(ids), np.int64), np.lexsort((value, example))
    strongest[example[heaviest]] = term[heaviest]
    order = np.lexsort((ids, strongest))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    example, ids, votes = place[example], ids[order], votes[order]
    order = np.lexsort((example, term))
    idf = vocabulary.column("idf").to_numpy()
    index = Index(names, idf, term[order], example[order], value[order], ids, votes, k, power)
    index.base = t / n if n else 0.0
    return calibrated(index, whole)


def calibrated(index: Index, whole: DataFrame) -> Index:
    """The index with its curve, from the votes of each example's neighbours without itself."""
    spark = whole.sparkSession
    held = spark.sparkContext.broadcast(index)

    def voted(batches):
        ix = held.value
        place = {int(x): i for i, x in enumerate(ix.ids)}
        for b in batches:
            outs = [place[x] for x in b.column("id").to_pylist()]
            yes, n = b.column("yes").to_pylist(), b.column("n").to_pylist()
            votes, truth, weight = [], [], []
            bags = [ix.bag(t) for t in b.column("text").to_pylist()]
            for (near, cos), out, y, m in zip(ix.neighbours(bags, outs), outs, yes, n, strict=True):
                for toxic, w in ((1, y), (0, m - y)):
                    if w and len(near):
                        votes.append(ix.vote(near, cos, out, toxic))
                        truth.append(toxic)
                        weight.append(float(w))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(truth, pa.int64()), pa.array(weight, pa.float64())], ["vote", "toxic", "weight"])

    some = whole.select("id", "text", "yes", "n").repartition(max(8, spark.sparkContext.defaultParallelism))
    got = some.mapInArrow(voted, "vote double, toxic long, weight double").toArrow()  # two rows for each example at most
    index.curve = rising(*(got.column(c).to_pylist() for c in ("vote", "toxic", "weight")))
    held.unpersist()
    return index


def score(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 15, max_examples: int = 4000, max_bytes: int = 1 << 26, min_df: int = 5, chi2: float = 15.0, power: float = 2.0, batch: int = 64) -> DataFrame:
    """The rows of docs with score (0 to 1) and evidence (ids of near examples). Examples come from labelled and labels."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(build(labelled, labels, id_col, text_col, k, max_examples, max_bytes, min_df, chi2, power))
    names = [free_name(docs, x) for x in ("score", "evidence")]
    columns = list(docs.columns)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` double", f"`{names[1]}` array<long>"])
    raw = free_name(docs, "raw_")

    def scored(batches):
        index = held.value
        for b in batches:
            texts, found = b.column(raw).to_pylist(), []
            for i in range(0, len(texts), batch):
                found += index.scores(texts[i : i + batch])
            new = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, *names])

    return docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(scored, kinds)
