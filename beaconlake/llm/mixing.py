"""Soft-membership mixing to target weights, in DataFrame functions only.

Domains are the four cells (quality, toxic) of the labelled table. Two naive Bayes classifiers on hashed words, fitted
to at most ``max_labelled`` labelled documents (those with the smallest hash of their id), give each document posteriors
of the cells; log odds are divided by the square root of the length, so long documents stay soft. Then rates r, ``floor`` at
least, minimise

    sum_d ((sum_i r_i t_i p_id - T_d) / T)^2 / 2  +  ridge * sum_i t_i / T * (r_i - 1)^2 / 2

(t: words, T_d: target words of a domain, T: all words). The ridge only settles which of the rates that reach the targets
are taken (those nearest to 1, by words), and how far rates go for targets that can't be reached. The least squares are
solved by projected gradient steps: the gradient of a document's rate is the sum over the domains of residual times
posterior, so the gradients of all steps add up to one number y_d for each domain, and a rate is the projection
max(floor, 1 - sum_d y_d p_id) of what they lead to. Steps of plain size need thousands of rounds where domains overlap, so
a step is scaled by the inverse of the domains' Gram matrix over the documents that aren't at the floor (which makes it a
Newton step on the dual) and halved until the dual rises. A round needs sums over all documents (totals, Gram matrix,
value), so nothing but these numbers is ever gathered. ``residual`` says how far the totals are from the targets.

With ``growth`` None only the shares of the domains are set and all words may grow (or shrink) as the least change needs:
then (p_id - target share of d) takes the place of p_id, and T_d is 0.

Null and empty texts have no words; their rate is got in the same way, and they carry no weight. Very long texts are
counted whole. Equal texts have equal rates; copies of rows with equal ids are rounded alike. Documents with several labels
count with their largest; labels that are null, or whose id is, are left out, as are other columns of the labels. With no
labels all posteriors are equal. An empty table gives an empty result. Extra columns stay; names that are taken get leading
underscores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .quality import let, words_of

DOMAINS = ["low_clean", "low_toxic", "high_clean", "high_toxic"]


def _buckets(text: Column, buckets: int) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int, max_labelled: int) -> DataFrame:
    """One row: weights (array of struct q, t by bucket) and the log odds of quality and toxicity of a document without words."""
    known = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")  # max_labelled rows at most
    words = rows.select("q", "t", F.explode(_buckets(F.col("text"), buckets)).alias("b")).groupBy("b").agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("q1", F.col("q") == 1), ("q0", F.col("q") == 0), ("t1", F.col("t") == 1), ("t0", F.col("t") == 0))))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(words, "b", "left").fillna(0.0)
    total = every.selectExpr("sort_array(collect_list(struct(b, q1, q0, t1, t0))) as w", "sum(q1) + count(*) as q1", "sum(q0) + count(*) as q0", "sum(t1) + count(*) as t1", "sum(t0) + count(*) as t0")
    weights = total.selectExpr("transform(w, x -> named_struct('q', ln((x.q1 + 1) / q1) - ln((x.q0 + 1) / q0), 't', ln((x.t1 + 1) / t1) - ln((x.t0 + 1) / t0))) as weights")
    prior = some.selectExpr("ln((count_if(q = 1) + 1D) / (count_if(q = 0) + 1D)) as q", "ln((count_if(t = 1) + 1D) / (count_if(t = 0) + 1D)) as t")
    return weights.select("weights", F.lit(1).alias("k")).join(prior.withColumn("k", F.lit(1)), "k").select("weights", "q", "t")


def posteriors(docs: DataFrame, model: DataFrame, text_col: str, tokens: str, post: str, buckets: int) -> DataFrame:
    """The rows with their number of words and the posteriors of the four domains (array, in the order of DOMAINS)."""
    m = model.select(F.struct("weights", "q", "t").alias("m")).scalar()

    def scored(b: Column, m: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("t"))
        got = F.aggregate(b, zero, lambda a, i: let(F.get(m["weights"], i), lambda w: F.struct((a["q"] + w["q"]).alias("q"), (a["t"] + w["t"]).alias("t"))))
        root = F.sqrt(F.greatest(F.size(b), F.lit(1)))
        odds = let(got, lambda g: F.struct((m["q"] + g["q"] / root).alias("q"), (m["t"] + g["t"] / root).alias("t")))
        p = let(odds, lambda o: F.struct((1 / (1 + F.exp(-o["q"]))).alias("q"), (1 / (1 + F.exp(-o["t"]))).alias("t")))
        return let(p, lambda x: F.array((1 - x["q"]) * (1 - x["t"]), (1 - x["q"]) * x["t"], x["q"] * (1 - x["t"]), x["q"] * x["t"]))

    held, found = free_name(docs, "model_"), free_name(docs, "found_")
    both = let(_buckets(F.col(text_col), buckets), lambda b: F.struct(F.size(b).cast("long").alias("n"), let(F.col(held), lambda x: scored(b, x)).alias("p")))
    return docs.withColumn(held, m).withColumn(found, both).select(*docs.columns, F.col(f"{found}.n").alias(tokens), F.col(f"{found}.p").alias(post))


def rate_of(post: str, duals: list[float], shift: list[float], floor: float) -> Column:
    """A document's rate by the dual numbers of the domains; shift: what is taken off the posteriors."""
    return F.greatest(F.lit(float(floor)), 1 - _pull(post, duals, shift))


def _pull(post: str, duals: list[float], shift: list[float]) -> Column:
    return sum((F.lit(float(y)) * F.get(F.col(post), F.lit(d)) for d, y in enumerate(duals)), F.lit(-float(np.dot(duals, shift))))


def solve(rows: DataFrame, tokens: str, post: str, goal: list[float], shift: list[float], floor: float, ridge: float, steps: int, tolerance: float) -> list[float]:
    """The dual numbers, to a tolerance of the domains' shares of all words."""
    n, goal = len(DOMAINS), np.array(goal)
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    total = rows.agg(F.sum(tokens)).first()[0] or 0
    if not total:
        return [0.0] * n
    base = rows.select((F.col(tokens) / F.lit(float(total))).alias("w"), F.col(post).alias("p"))
    q = [F.get(F.col("p"), F.lit(d)) - F.lit(float(shift[d])) for d in range(n)]

    def value(y: np.ndarray) -> Column:
        u, r = _pull("p", y, shift), rate_of("p", y, shift, floor)
        return F.sum(F.col("w") * ((r - 1) * (r - 1) / 2 + u * r))

    def at(y: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Gradient and curvature of the dual at y, and its value there and at others, in one pass."""
        r = rate_of("p", y, shift, floor)
        free = F.when(1 - _pull("p", y, shift) > floor, F.col("w")).otherwise(0.0)
        got = base.agg(*(F.sum(F.col("w") * r * c) for c in q), *(F.sum(free * q[a] * q[b]) for a, b in pairs), *map(value, [y, *others])).first()
        gram = np.zeros((n, n))
        for (a, b), v in zip(pairs, got[n : n + len(pairs)], strict=True):
            gram[a, b] = gram[b, a] = v
        values = [v - z @ goal - ridge / 2 * (z @ z) for z, v in zip([y, *others], got[n + len(pairs) :], strict=True)]
        return np.array(got[:n]) - goal - ridge * y, gram + ridge * np.eye(n), values

    y = np.zeros(n)
    gradient, curve, (best,) = at(y, [])
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.solve(curve, gradient)
        tries = [y + step / 2**k for k in range(8)]
        gradient, curve, values = at(tries[0], tries[1:])
        k = 0
        if values[0] < max(best, *values[1:]) - 1e-15:  # too far: the best of the shorter steps
            k = int(np.argmax(values))
            if k:
                gradient, curve, _ = at(tries[k], [])
        y, best = tries[k], values[k]
    return [round(float(v), 9) for v in y]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float | None = 1.0, floor: float = 0.0, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-7, steps: int = 60, tolerance: float = 1e-7, buckets: int = 4096, max_labelled: int = 20_000, seed: int = 0) -> DataFrame:
    """The columns in ``carry`` (all if None) with n_tokens, posterior, rate and copies (rate rounded up or down by a hash of the id, so its mean is the rate).

    targets: weights by domain; growth: expected words after mixing over words now, or None if only shares count; floor: least rate."""
    carry = docs.columns if carry is None else carry
    kept = docs.select(*carry)
    tokens, post, rate, copies = (free_name(kept, c) for c in ("n_tokens", "posterior", "rate", "copies"))
    model = written(fit(docs, labels, id_col, text_col, buckets, max_labelled), "model")
    text, number = free_name(kept, "text_"), free_name(kept, "id_")
    rows = posteriors(docs.select(*carry, F.col(text_col).alias(text), F.col(id_col).cast("string").alias(number)), model, text, tokens, post, buckets).drop(text)
    rows = written(rows, "posteriors")
    share = sum(targets.values())
    shares = [targets.get(d, 0.0) / share for d in DOMAINS]
    goal, shift = ([0.0] * len(DOMAINS), shares) if growth is None else ([s * growth for s in shares], [0.0] * len(DOMAINS))
    duals = solve(rows.select(tokens, post), tokens, post, goal, shift, floor, ridge, steps, tolerance)
    out = rows.withColumn(rate, rate_of(post, duals, shift, floor))
    chance = F.pmod(F.xxhash64(F.lit(seed), number, tokens), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn(copies, (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("long")).cast("long")).drop(number)


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The documents, each as often as its copies say, same columns."""
    n = free_name(docs, "copies")
    rows = mix(docs, labels, targets, **options).where(F.col(n) > 0)
    return rows.withColumn(free_name(rows, "again_"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def residual(mixed: DataFrame, targets: dict[str, float], by: str = "rate", tokens: str = "n_tokens", post: str = "posterior") -> DataFrame:
    """domain, target share, share and difference of the words that a result of ``mix`` leads to, by its rates or its copies."""
    sums = mixed.agg(*(F.sum(F.col(tokens) * F.col(by) * F.get(post, F.lit(d))).alias(x) for d, x in enumerate(DOMAINS)))
    every, goal = sum(F.col(x) for x in DOMAINS), sum(targets.values())
    rows = F.array(*(F.struct(F.lit(x).alias("domain"), F.lit(targets.get(x, 0.0) / goal).alias("target"), F.try_divide(F.col(x), every).alias("share")) for x in DOMAINS))
    return sums.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.share") - F.col("r.target")).alias("difference"))
