"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles. A pair that links
shares a token in its prefixes (the first ``n - ceil(n * percent / 100) + 1`` tokens) under *every* global order, so

1. all shingles are counted (sorted key blobs are the map-side combine; a reducer owns a range of keys), which gives
   bitmaps: keys that occur in two documents or more, and those that many documents share, in four steps of 8 times as
   many. Their size follows the bytes of the texts, up to ``max_bits``;
2. three orders place much-shared tokens last (the most shared ones last of all) and deal those of a step by three hashes;
   a document's prefix under each is kept without tokens that occur nowhere else, and a document for which one of them is
   empty has no partner;
3. documents with equal sets collapse into one representative;
4. tokens that only one document has are shared with nobody, which bounds a document's best similarity and a pair's;
5. representatives that share a prefix token under the first order are compared with one centre for each token; links
   become components; then only pairs of different components that share a token are compared. All candidates must
   share prefix tokens under the other two orders too before their sets are intersected;
6. of what is left, a token's representative only stays if its tokens that nobody shares and the fewest such of any
   other of that token leave room for a link; tokens that still have many representatives are split further, by the
   tokens of the second order and by set size (sizes of a pair that links are at most a class apart).

The bitmaps only decide the order and which tokens can't matter; a false positive never loses a link, so texts beyond
what ``max_bits`` can tell apart cost more but lose nothing. Nothing is capped. Pairs inside a component are never emitted,
so a group of n near copies costs about n comparisons.

Null, empty and blank texts have the empty set, link with nothing and are their own component. Null ids stay: each row
has its component, and a row without id joins the component of its text's set. Repeated ids are one document with
several texts: its rows share a component only if their sets link. Input columns other than the two named are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, free_name, owned, release, ship, written

ORDERS, STEPS = 3, 4
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHash()
KEPT["word hashes"] = _hash.clear


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ _C[salt]
    x = (x ^ (x >> np.uint64(32))) * _C[1]
    x = (x ^ (x >> np.uint64(29))) * _C[2]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased."""
    words = [t.lower().split() if t else [] for t in texts]
    flat = list(chain.from_iterable(words))
    w = np.fromiter(map(_hash.__getitem__, flat), np.uint64, len(flat))
    n = max(0, len(w) - k + 1)
    at = np.zeros(n, np.uint64)
    for j in range(k):
        at += w[j : n + j] * (_C[j % 8] + np.uint64(2 * j))
    at = mixed(at, 5)
    out, start = [], 0
    for x in words:
        end = start + len(x)
        if not x:
            h = at[:0]
        elif len(x) < k:
            h = np.array([xxhash.xxh3_64_intdigest(w[start:end].tobytes(), seed=len(x))], np.uint64)
        else:
            h = np.sort(at[start : end - k + 1])
            new = h[1:] != h[:-1]
            if not new.all():
                h = h[np.r_[True, new]]
        out.append(h)
        start = end
    return out


def grouped(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches whose values are about ``size`` bytes together."""
    for b in batches:
        values = b.column(column).to_pylist()
        start = held = 0
        for i, v in enumerate(values):
            held += len(v or b"") + 64
            if held >= size or i + 1 == len(values):
                yield b.slice(start, i + 1 - start), values[start : i + 1]
                start, held = i + 1, 0


def count_blobs(bits: int, k: int, flush: int = 4_000_000):
    """For mapInArrow: sorted keys of many documents, a blob for each range (the hash's first ``bits``)."""

    def blobs(batches):
        held, size = [], 0

        def out():
            h = np.sort(np.concatenate(held))
            cuts = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            key = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            rows = [(i, encode(x)) for i, x in enumerate(np.split(key, cuts)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "keys"])

        for _, texts in grouped(batches, "text"):
            sets = shingle_sets(texts, k)
            held += sets
            size += sum(map(len, sets))
            if size >= flush:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return blobs


def encode(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed planes of their differences."""
    d = np.diff(keys, prepend=np.uint32(0))
    return zlib.compress(d.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _bits(values: np.ndarray, size: int) -> bytes:
    """A bitmap of ``2 ** size`` bits, of the first bits of the 32-bit values."""
    on = np.zeros(1 << size, bool)
    on[values >> np.uint32(32 - size) if size else np.zeros(len(values), int)] = True
    return np.packbits(on, bitorder="little").tobytes()


def recurring(docs: DataFrame, k: int, map_bits: int, heavy: int, shingles: int) -> tuple[bytes, list[bytes], int]:
    """Bitmaps of the shingles that two documents or more have, and of those that ``heavy``, 8 * heavy, ... or more have.

    A reducer owns a range of keys: as many as the shuffle has partitions times four, or more, so that a range has about eight million keys."""
    spark = docs.sparkSession
    bits = max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (shingles >> 23).bit_length())
    bits = min(bits, map_bits - 6)
    few = map_bits - 3
    steps = [f"often{i}" for i in range(STEPS)]

    def count(t: pa.Table) -> pa.Table:
        keys = np.concatenate([decode(x) for x in t.column("keys").to_pylist()])
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[starts, len(keys)])
        values = keys[starts]
        many = {x: pa.array([_bits(values[n >= heavy * 8**i], few - bits)], pa.binary()) for i, x in enumerate(steps)}
        return pa.table({"part": t.column("part")[:1], "twice": pa.array([_bits(values[n > 1], map_bits - bits)], pa.binary())} | many)

    blobs = docs.select("text").mapInArrow(count_blobs(bits, k), "part int, keys binary")
    rows = blobs.groupBy("part").applyInArrow(count, "part int, twice binary, " + ", ".join(f"{x} binary" for x in steps))
    twice, often = np.zeros(1 << (map_bits - 3), np.uint8), [np.zeros(1 << (few - 3), np.uint8) for _ in steps]
    for r in rows.toLocalIterator():  # bitmaps of bounded size, a range at a time
        for whole, name, size in ((twice, "twice", map_bits - bits - 3), *((o, x, few - bits - 3) for o, x in zip(often, steps, strict=True))):
            whole[r.part << size : (r.part + 1) << size] = np.frombuffer(r[name], np.uint8)
    return twice.tobytes(), [o.tobytes() for o in often], map_bits


def _on(bitmap: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    at = (h >> np.uint64(64 - size)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def prefixes(sets: list[np.ndarray], twice: np.ndarray, often: list[np.ndarray], size: int, percent: int) -> Iterator[tuple[int, float, list[np.ndarray]]]:
    """Of each document: how many tokens recur, the share of its first prefix that few others have, the recurring tokens of its prefixes."""
    every = np.concatenate(sets)
    late, again = _on(often[0], every, size - 3), _on(twice, every, size)
    step = np.zeros(len(every), np.uint64)
    shared = np.flatnonzero(late)
    for o in often:
        shared = shared[_on(o, every[shared], size - 3)]
        step[shared] += np.uint64(1)
    top = step << np.uint64(61)
    keys = [(every if k == 0 else mixed(every, k)) >> np.uint64(3) | top for k in range(ORDERS)]
    start = 0
    for h in sets:
        part, start = slice(start, start + len(h)), start + len(h)
        n, recur = len(h), int(again[part].sum())
        if not n or recur * 100 < percent * n:  # shares too little with all others together
            yield recur, 1.0, [h[:0]] * ORDERS
            continue
        p, found, own = n - -(-n * percent // 100) + 1, [], 1.0
        for k in range(ORDERS):
            first = np.argpartition(keys[k][part], p - 1)[:p] if p < n else slice(None)
            if k == 0:
                own = float(1 - late[part][first].mean())
            found.append(h[first][again[part][first]])
        yield recur, own, found


SKETCH = [f"x{i}" for i in range(8)]
SIGNED = "doc_id long, low long, high long, n long, s long, own double, sketch struct<%s>, pa array<long>, pb array<long>, pc array<long>, tokens array<long>" % ", ".join(f"{x} long" for x in SKETCH)


def sketch(h: np.ndarray) -> np.ndarray:
    """512 parities: two sets differ in at least as many tokens as their sketches differ in bits."""
    return np.packbits(np.bincount((mixed(h, 4) & np.uint64(511)).astype(np.int64), minlength=512) & 1, bitorder="little").view(np.int64)


def sign(maps, k: int, percent: int):
    """For mapInArrow: digest, size and recurring prefix tokens of each document; its whole set if it may have a partner."""

    def signed(batches):
        a, b, size = maps.value
        twice, often = np.frombuffer(a, np.uint8), [np.frombuffer(x, np.uint8) for x in b]
        for batch, texts in grouped(batches, "text"):
            cols = {c: [] for c in ("low", "high", "n", "s", "own", "sketch", "pa", "pb", "pc", "tokens")}
            sets = shingle_sets(texts, k)
            for h, (recur, own, found) in zip(sets, prefixes(sets, twice, often, size, percent), strict=True):
                d = xxhash.xxh3_128_digest(h.tobytes())
                alone = any(len(x) == 0 for x in found)
                row = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(h), recur, own, dict(zip(SKETCH, sketch(h).tolist(), strict=True)), *([] if alone else x.view(np.int64) for x in found), None if alone else h.view(np.int64))
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.float64(), pa.struct([(x, pa.int64()) for x in SKETCH])] + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))], ["doc_id", *cols])

    return signed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids in links; component is the smallest id reachable. Labels spread to neighbours and jump along labels; every round is written, and the one before it deleted."""
    spark, run, k = links.sparkSession, uuid4().hex, 0
    with owned(f"{run} both"):
        both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct(), "both")
    with owned(f"{run} 0"):
        labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        at = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        with owned(f"{run} {k + 1}"):
            new = written(step.join(at, "to", "left").select("id", F.least("to", F.coalesce("beyond", "to")).alias("component"), "was"), "labels")
        release(spark, f"{run} {k}")
        moved = new.where("component <> was").limit(1).count()
        labels, k = new.drop("was"), k + 1
        if not moved:
            labels = written(labels, "components")
            for name in ("both", k):
                release(spark, f"{run} {name}")
            return labels


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether the sets described by the structs x and y can link: they share at most min(s) tokens and differ in at least as many as their sketches do."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    both = F.least(F.col(f"{x}.s"), F.col(f"{y}.s"))
    apart = sum((F.bit_count(F.col(f"{x}.sketch.{i}").bitwiseXOR(F.col(f"{y}.sketch.{i}"))) for i in SKETCH[1:]), F.bit_count(F.col(f"{x}.sketch.x0").bitwiseXOR(F.col(f"{y}.sketch.x0"))))
    return (both * 100 >= (n + m - both) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _linked(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that share prefix tokens under every order and link."""
    one = reps.select(F.col("rep").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("n", "pb", "pc")))
    two = reps.select(F.col("rep").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "pb", "pc")))
    near = pairs.join(one, "a").join(two, "b").where(F.arrays_overlap("pb_a", "pb_b") & F.arrays_overlap("pc_a", "pc_b")).select("a", "b", "n_a", "n_b")
    near = near.join(reps.select(F.col("rep").alias("b"), F.col("tokens").alias("t_b")), "b").join(reps.select(F.col("rep").alias("a"), F.col("tokens").alias("t_a")), "a")
    both = F.size(F.array_intersect("t_a", "t_b"))
    return near.where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b")


def _split(rows: DataFrame, other: DataFrame, reps: DataFrame, percent: int, hot: int) -> DataFrame:
    """Pairs (a, b) of rows and other that share a token and may link. Both: token, rep, x (see jaccard_components), component.

    Where more than ``hot`` pairs share a token, both sides are keyed by the tokens of their prefix under the second order
    as well, and by the class of their set size; a pair that links meets under such a key."""
    n = other.groupBy("token").agg(F.count("*").alias("n")).join(rows.groupBy("token").agg(F.count("*").alias("m")), "token")
    busy = written(n.where(F.col("n") * F.col("m") > hot).select("token"), "busy")
    second = reps.select("rep", F.col("pb").alias("second"))
    size = F.floor(F.log(F.col("x.n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("long")

    def keyed(df: DataFrame, near: list[int]) -> DataFrame:
        far = df.join(busy, "token", "left_semi").join(second, "rep").withColumn("second", F.explode("second"))
        far = far.withColumn("class", F.explode(F.array(*(size + i for i in near))))
        plain = df.join(busy, "token", "left_anti").withColumns({"second": F.lit(0).cast("long"), "class": F.lit(0).cast("long")})
        return plain.select("token", "second", "class", "rep", "x", "component").unionByName(far.select("token", "second", "class", "rep", "x", "component"))

    left = keyed(rows, [0]).select("token", "second", "class", F.col("rep").alias("other"), F.col("x").alias("y"), F.col("component").alias("cy"))
    pairs = left.join(keyed(other, [-1, 0, 1]), ["token", "second", "class"]).where((F.col("cy") != F.col("component")) & _fits("x", "y", percent))
    return pairs.select(F.least("other", "rep").alias("a"), F.greatest("other", "rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, max_bits: int = 29, heavy: int = 64, hot: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    max_bits: the bitmaps have 2 ** max_bits and STEPS times an eighth of that many bits at most (96 MB), and about two bits for each shingle below that."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    shingles = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    map_bits = min(max_bits, max(16, shingles.bit_length() + 1))
    maps = spark.sparkContext.broadcast(recurring(docs, k, map_bits, heavy, shingles))
    signed = written(docs.mapInArrow(sign(maps, k, percent), SIGNED), "signed")
    whole = F.struct("n", "s", "own", "sketch", "pa", "pb", "pc", "tokens")
    # A row without id still stands for its set; ids that repeat get apart by their digests. A representative is numbered as it is written.
    reps = signed.where("size(pa) > 0").groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.first(whole).alias("x"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "low", "high", "least", "x.*"), "reps")
    tokens = reps.select("rep", F.struct("own", "rep", "n", "s", "sketch").alias("x"), F.explode("pa").alias("token"))
    centre = tokens.groupBy("token").agg(F.count("*").alias("in"), F.min("x").alias("c")).where("in > 1").select("token", "c")
    shared = tokens.join(centre, "token").select("token", "rep", "x", F.col("c.rep").alias("a"), ((F.col("rep") != F.col("c.rep")) & _fits("x", "c", percent)).alias("near"))
    run = uuid4().hex  # tables that are deleted as soon as nothing reads them
    with owned(f"{run} shared"):
        shared = written(shared, "shared")
    tried = written(shared.where("near").select("a", F.col("rep").alias("b")).distinct(), "tried")
    links = written(_linked(tried, reps, percent), "links")
    part = components(links)
    # What is left: pairs of different components that share a token. One of them isn't in its centre's component.
    own = shared.select("token", "rep", "x", "a").join(part.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = part.select(F.col("id").alias("a"), F.col("component").alias("main"))
    with owned(f"{run} own"):
        own = written(own.join(main, "a", "left").withColumn("main", F.coalesce("main", "a")).drop("a"), "own")
    release(spark, f"{run} shared")
    # A pair shares min(s) tokens at most, and the tokens that nobody shares with either are all in the union.
    alone = F.col("x.n") - F.col("x.s")
    fewest = own.groupBy("token").agg(F.min(F.struct(alone.alias("u"), F.col("rep").alias("rep"))).alias("f"), F.count_if(F.col("component") != F.col("main")).alias("minor")).where("minor > 0")
    second = own.join(fewest.select("token", "f"), "token").where(F.col("rep") != F.col("f.rep")).groupBy("token").agg(F.min(alone).alias("u2"))
    room = fewest.join(second, "token").select("token", "f", "u2")
    least = F.when(F.col("rep") == F.col("f.rep"), F.col("u2")).otherwise(F.col("f.u"))
    own = own.join(room, "token").where((alone + least) * percent <= F.col("x.s") * (100 - percent)).drop("f", "u2")
    own = written(own, "left")
    release(spark, f"{run} own")
    rest = _split(own.where("component <> main"), own, reps, percent, hot)
    seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(seen, ["a", "b"], "left_anti"), "rest")
    links = written(links.union(_linked(rest, reps, percent)), "links")
    part = components(links).withColumnRenamed("id", "rep")
    # Labels of the components are the smallest ids of their documents.
    named = reps.select("rep", "low", "high", "least").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    to = named.join(smallest, "component").select("low", "high", "component_id")
    return signed.select("doc_id", "low", "high", "n").join(to, ["low", "high"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a linked document with a smaller id stands for, same columns.

    Ids should be unique: rows that share one go together when any of them is linked with a smaller id, and stay together
    else. Rows without id and rows without words stay. Very long texts are compared whole; columns of any name are fine."""
    found = jaccard_components(docs, **options)
    key = free_name(docs, "gone_")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[options.get("id_col", "doc_id")].cast("long") == F.col(key), "left_anti")
