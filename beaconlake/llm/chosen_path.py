"""Near duplicates by chosen paths: documents branch by minwise tokens, small nodes are compared exhaustively, trees repeat.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of word shingles.

1. A document is signed once: a digest of its set, COORDS minwise values and a sketch of 512 parities. Documents with equal
   sets are one representative from there on.
2. A node of a tree branches by BRANCHES coordinates, which the node itself draws among those that its path hasn't used: a
   representative goes on to the child of each one's value. Two sets of similarity s share a child with probability s for
   each coordinate, so a pair at the threshold gets lost in a tree with a chance q that solves q = (1 - s + s q) ^ BRANCHES;
   as many trees are grown as bring the chance below 1 - ``recall``.
3. Nodes of the first level are compared with one centre each: the member whose minwise values and parities most others have,
   which of a group of edited copies is the text that they were made from, or what is nearest to it. (A copy with one edit often
   has all minwise values of its text, but never all parities; as a centre it would miss copies that only the text links.) Verified links
   make components, and only nodes of several components go on, where only pairs of different components are compared: a group
   of n near copies costs about n comparisons.
4. Nodes of at most ``small`` members are compared exhaustively. So are larger ones in which the members outside the main
   component times all members are ``pairs`` at most, and those whose path has used up the coordinates: members outside
   that component meet all others, in blocks of ``small`` by ``small``. The rest branch again, all nodes of a level at once.
5. Candidates that sizes, parities (a lower bound of the difference) and minwise values (more than LOST of linked pairs agree in
   that many) let through are verified on their full sets, which are computed again from the texts of those that are needed.

Nothing is capped; what is lost is lost by chance, at most 1 - ``recall`` of the links at the threshold and less above it, and
then only if no other path of links joins the two documents. The draws are fixed by hashes, so results repeat.

Null, empty and blank texts have the empty set, link with nothing and are their own component. A row without id has its
component; it joins that of its text's set. Repeated ids are one document with several texts: rows share a component only if
their sets link. Other columns, of any name, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, written
from .ngram_join import components, grouped, mixed, shingle_sets, sketch

COORDS, BRANCHES, LOST = 64, 2, 1e-9
#: Longs of a sketch.
PARITIES = 8
#: Members from which on a node's centre is chosen by all minwise values, and not only by those that lead to the first level.
CROWD = 16
#: Coordinates that a path may use and still branch.
DEPTH = COORDS - BRANCHES
_rng = np.random.default_rng(20240)
_ADD, _MUL = _rng.integers(0, 2**64, COORDS, np.uint64), _rng.integers(0, 2**64, COORDS, np.uint64) | np.uint64(1)
SIGNED = "doc_id long, low long, high long, n long, sketch array<long>, sig binary"


def trees_for(percent: int, recall: float) -> int:
    """Trees that lose a pair at the threshold with a chance of at most 1 - recall."""
    s, q = percent / 100, 0.0
    for _ in range(10_000):
        q = (1 - s + s * q) ** BRANCHES
    if q > 0.9:
        raise ValueError("such a low threshold needs more branches")
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def fewest_equal(percent: int) -> int:
    """The number of equal minwise values below which a pair at the threshold falls with a chance of less than LOST."""
    s, below = percent / 100, 0.0
    for c in range(COORDS + 1):
        below += math.comb(COORDS, c) * s**c * (1 - s) ** (COORDS - c)
        if below > LOST:
            return c
    return COORDS


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDS minwise values for each set that isn't empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every, out = np.concatenate(sets), np.empty((len(sets), COORDS), np.uint32)
    for i in range(COORDS):
        out[:, i] = np.minimum.reduceat(((every ^ _ADD[i]) * _MUL[i]) >> np.uint64(32), starts)
    return out


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sign(k: int):
    def signed(batches):
        for batch, texts in grouped(batches, "text"):
            sets = shingle_sets(texts, k)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            rows = [(*_digest(s), len(s), sketch(s), next(sig).tobytes()) if len(s) else (0, 0, 0, None, None) for s in sets]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.list_(pa.int64()), pa.binary()), strict=True))], ["doc_id", "low", "high", "n", "sketch", "sig"])

    return signed


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def children(node: np.ndarray, used: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the BRANCHES nodes it goes on to, and the coordinates that their paths have used."""
    coords = np.arange(COORDS, dtype=np.uint64)
    drawn = mixed(node[:, None] + coords * np.uint64(0x9E3779B97F4A7C15), 3)
    drawn[(used[:, None] >> coords) & np.uint64(1) == 1] = np.uint64(2**64 - 1)
    at = np.argsort(drawn, axis=1, kind="stable")[:, :BRANCHES]
    values = np.take_along_axis(sig, at, 1).astype(np.uint64)
    return mixed(mixed(node[:, None] + at.astype(np.uint64), 6) ^ values, 7), used[:, None] | np.uint64(1) << at.astype(np.uint64)


def branch(trees: int = 0):
    """For mapInArrow: (node, used, rep) of the children. trees: rows (rep, sig) are in the roots of so many trees; else rows have node and used."""

    def out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig, rep = _matrix(b.column("sig"), "<u4", COORDS), b.column("rep").to_numpy()
            for t in range(trees or 1):
                node = np.full(b.num_rows, t, np.uint64) if trees else b.column("node").to_numpy().view(np.uint64)
                used = np.zeros(b.num_rows, np.uint64) if trees else b.column("used").to_numpy().view(np.uint64)
                to, paths = children(mixed(node, 2) if trees else node, used, sig)
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().view(np.int64)), pa.array(paths.ravel().view(np.int64)), pa.array(np.repeat(rep, BRANCHES))], ["node", "used", "rep"])

    return out


def _candidates(t: pa.Table, percent: int, least: int):
    """Pairs (a, b) of rows of one key: one of ``one``, one of ``two``, of different components, which may link."""
    sides, comp, n, rep = (t.column(c).to_numpy() for c in ("side", "component", "n", "rep"))
    key = t.column("key").to_numpy()
    parity, sig = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 8), _matrix(t.column("sig"), "<u4", COORDS)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        two = np.arange(start, end)[sides[start:end] & 2 > 0]
        for i in np.arange(start, end)[sides[start:end] & 1 > 0]:
            j = two[(two > i) | (sides[two] & 1 == 0)]
            j = j[comp[j] != comp[i]]
            j = j[(np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
            if len(j):
                j = j[np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (n[j] + n[i]) * (100 - percent)]
            if len(j):
                j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
            if len(j):
                yield np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])


def compare(percent: int, least: int):
    """For mapInArrow over rows sorted by key: candidates. Only the last key's rows are held from one batch to the next."""

    def pairs(batches):
        held = None

        def out(t: pa.Table):
            found = list(_candidates(t, percent, least))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                yield from out(t.slice(0, cut)) if cut else ()
                held = t.slice(cut)
        if held is not None:
            yield from out(held)

    return pairs


def tokens_of(k: int):
    """For mapInArrow: digest and tokens of each text."""

    def out(batches):
        for _, texts in grouped(batches, "text"):
            sets = shingle_sets(texts, k)
            low, high = zip(*map(_digest, sets), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["low", "high", "tokens"])

    return out


def overlap(percent: int):
    """For mapInArrow over (a, b, one, two): the pairs whose sets link."""

    def out(batches):
        for b in batches:
            on = []
            for x, y in zip(b.column("one"), b.column("two"), strict=True):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                both = int((both[1:] == both[:-1]).sum())
                on.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return out


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link by their full sets."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    needed = written(reps.join(needed, "rep", "left_semi").select("rep", "low", "high", "least"), "needed")
    ids = needed.select(F.col("least").alias("needed_id")).distinct()
    sets = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("needed_id")), "left_semi").select("text").mapInArrow(tokens_of(k), "low long, high long, tokens binary")
    sets = sets.join(needed.select("low", "high", "rep"), ["low", "high"]).groupBy("rep").agg(F.first("tokens").alias("tokens"))
    sets = written(sets, "sets")
    met = pairs.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("two")), "b").join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("one")), "a")
    return written(met.select("a", "b", "one", "two").mapInArrow(overlap(percent), "a long, b long"), "links")


def _near(percent: int) -> Column:
    """Whether rows with n, m and the sketches one, two can link, by size and parities."""
    apart = F.aggregate(F.zip_with("one", "two", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    n, m = F.col("n"), F.col("m")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of large nodes (with component, main, size, minor) for compare(): those outside the main component meet all, in blocks of about ``block`` by ``block``."""
    h = lambda parts: F.pmod(F.xxhash64("rep"), parts)
    ones, twos = F.ceil(F.col("minor") / block), F.ceil(F.col("size") / block)
    first = rows.where("component <> main").withColumns({"i": h(ones), "j": F.explode(F.sequence(F.lit(0).cast("long"), twos - 1)), "side": F.lit(1).cast("long")})
    second = rows.withColumns({"j": h(twos), "i": F.explode(F.sequence(F.lit(0).cast("long"), ones - 1)), "side": F.lit(2).cast("long")})
    return first.unionByName(second).withColumn("key", F.xxhash64("node", "i", "j")).select("key", "rep", "component", "side")


def paths(live: DataFrame, data: DataFrame, percent: int, small: int, most: int) -> DataFrame:
    """Candidates of all nodes. live: node, used, rep, component of nodes with several components; data: rep, n, sketch, sig."""
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, least = None, fewest_equal(percent)
    while True:
        by = live.groupBy("node", "component").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("n_components"))
        by = by.where("n_components > 1").select("node", "size", (F.col("size") - F.col("top.c")).alias("minor"), F.col("top.component").alias("main"))
        rows = written(live.join(by, "node"), "nodes")
        done = (F.col("minor") * F.col("size") <= most) | (F.bit_count("used") > DEPTH)
        exhaustive = rows.where(F.col("size") <= small).select(F.col("node").alias("key"), "rep", "component", F.lit(3).cast("long").alias("side"))
        exhaustive = exhaustive.unionByName(_blocks(rows.where((F.col("size") > small) & done), small))
        keyed = exhaustive.join(data, "rep").repartition(parts, "key").sortWithinPartitions("key")
        pairs = written(keyed.select("key", "rep", "component", "side", "n", "sketch", "sig").mapInArrow(compare(percent, least), "a long, b long").distinct(), "candidates")
        found = pairs if found is None else found.union(pairs)
        more = rows.where((F.col("size") > small) & ~done).select("node", "used", "rep", "component")
        if not more.limit(1).count():
            return found.distinct()
        parents = more.select("rep", "component").distinct()
        live = more.join(data.select("rep", "sig"), "rep").select("node", "used", "rep", "sig").mapInArrow(branch(), "node long, used long, rep long").join(parents, "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, recall: float = 0.999999, small: int = 512, pairs: int = 1 << 24) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    signed = written(docs.mapInArrow(sign(k), SIGNED), "signed")
    reps = signed.where("n > 0").groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "sketch", "sig")).alias("x"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "low", "high", "least", "x.*"), "reps")
    nodes = reps.select("rep", "sig").mapInArrow(branch(trees_for(percent, recall)), "node long, used long, rep long")
    nodes = written(nodes, "nodes")
    shared = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = written(nodes.join(shared, "node"), "members")
    crowd = members.where(F.col("size") >= CROWD).select("rep").distinct()
    places = F.explode(F.sequence(F.lit(0), F.lit(COORDS + PARITIES - 1)))
    value = F.when(F.col("i") < COORDS, F.xxhash64(F.substring("sig", F.col("i") * 4 + 1, F.lit(4)))).otherwise(F.get("sketch", F.col("i") - COORDS))
    values = reps.join(crowd, "rep").select("rep", "sig", "sketch", places.alias("i")).select("rep", "i", value.alias("value"))
    values = written(values, "values")
    common = values.groupBy("i", "value").agg(F.count("*").alias("n")).where("n > 1")
    typical = values.join(common, ["i", "value"]).groupBy("rep").agg(F.sum("n").alias("typical"))
    weight = members.groupBy("rep").agg(F.sum("size").alias("shared")).join(typical, "rep", "left").select("rep", F.coalesce("typical", "shared").alias("weight"))
    weighted = members.join(weight, "rep")
    centre = weighted.groupBy("node").agg(F.max(F.struct("weight", "rep")).alias("c")).select("node", F.col("c.rep").alias("centre"))
    met = members.join(centre, "node").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    one, two = (reps.select(F.col("rep").alias(c), F.col("n").alias(n), F.col("sketch").alias(s)) for c, n, s in (("a", "n", "one"), ("b", "m", "two")))
    links = verified(met.join(one, "a").join(two, "b").where(_near(percent)).select("a", "b"), reps, docs, k, percent)
    part = components(links).withColumnRenamed("id", "rep")
    live = members.select("node", "used", "rep").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = paths(live, reps.select("rep", "n", "sketch", "sig"), percent, small, pairs)
    links = written(links.union(verified(rest.select("a", "b"), reps, docs, k, percent)), "links")
    part = components(links).withColumnRenamed("id", "rep")
    named = reps.select("rep", "low", "high", "least").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    to = named.join(smallest, "component").select("low", "high", "component_id")
    out = signed.select("doc_id", "low", "high", "n").join(to.withColumn("m", F.lit(1)), ["low", "high"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a linked document with a smaller id stands for, same columns. Rows without id or words stay; ids should be unique."""
    found = near_duplicates(docs, **options)
    key = free_name(docs, "gone_")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[options.get("id_col", "doc_id")].cast("long") == F.col(key), "left_anti")
