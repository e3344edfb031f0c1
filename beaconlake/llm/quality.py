"""Quality rules with host verdicts, in DataFrame functions only.

Rules of a document: the base rule (too few words, or too many words inside repeated windows) and three soft rules
(symbols, repeated lines, mean word length). The share of a host's documents that fail any rule is shrunk towards an
empirical beta prior, fitted to all hosts by moments that weigh hosts by their documents (see host_rates), so a host with a
handful of documents isn't judged by them alone. A host of ``least`` documents or more is strict if its rate is above the mean
with a probability of ``sure`` or more, by its posterior (in the normal approximation). On a strict host a document must pass every rule; elsewhere soft failures are forgiven. A
document that fails the base rule is never kept, one that passes all rules always is.

Null and empty texts have no words (and fail the base rule). Very long texts are measured whole. Equal rows are judged
alike. A null host counts as the empty name. Extra columns stay; names that are taken get leading underscores. An empty
table gives an empty result. The features are computed once and written with the rows; hosts are counted by partial sums,
so one large host is no hot spot, and their rates join back by host (a small table that Spark broadcasts by its size).
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

SPACE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(x: Column, f) -> Column:
    """f(x), where x is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words inside windows that occur twice or more: windows are hashed; those of equal hash are neighbours once sorted."""

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            places = F.sort_array(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, twice))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def base_features(text: Column) -> list[Column]:
    """by_words (n_words, n_repeat_words), word_chars, n_symbols, by_lines (n_lines, n_dup_lines)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [
        by_words.alias("by_words"),
        F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        by_lines.alias("by_lines"),
    ]


def host_rates(rows: DataFrame, host: str, failed: Column, sure: float, least: int, most: float = 1000.0) -> DataFrame:
    """host, rate (shrunk by the empirical beta prior) and strict. rows: anything with a host and a failure.

    The prior's strength is 1 / r - 1, at most ``most`` and 1 at least, for the correlation r of the failures within a host by
    the analysis of variance: what hosts differ more than their own documents' scatter explains, hosts weighted by their
    documents. A host of one document tells nothing of its scatter and adds none, so small hosts don't pass for different
    ones; where nothing tells scatter and difference apart, all are shrunk with ``most``. No host of fewer than ``least``
    documents is strict."""
    hosts = written(rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("k")), "hosts")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    m = hosts.agg(F.count("*").alias("m"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()
    mean = m["k"] / m["n"] if m["m"] else 0.0
    strength = most
    if m["m"] > 1 and m["n"] > m["m"]:
        between = (m["kk"] - m["k"] ** 2 / m["n"]) / (m["m"] - 1)
        within = (m["k"] - m["kk"]) / (m["n"] - m["m"])
        size = (m["n"] - m["nn"] / m["n"]) / (m["m"] - 1)
        if between > within:
            strength = min(max((size * within) / (between - within), 1.0), most)
    shrunk = hosts.withColumn("rate", (F.col("k") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1)))
    strict = (F.col("n") >= least) & (F.col("rate") - F.lit(mean) > F.lit(NormalDist().inv_cdf(sure)) * spread)
    return shrunk.select("host", "rate", strict.alias("strict"))


def host_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None, sure: float = 0.6, least: int = 5) -> DataFrame:
    """The columns in ``carry`` (all if None) with the base features, n_failed (rules), base_failed, host_rate, host_strict and kept."""
    kept_columns = docs.columns if carry is None else carry
    # Features are fields of one struct, so no column of the input can clash with them; let() keeps the optimiser from
    # computing the struct again for each of its fields.
    made = docs.select(*(F.col(f"`{c}`") for c in kept_columns))
    feature, host = free_name(made, "feature_"), free_name(made, "host_")
    rows = docs.select(*made.columns, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias(host), let(F.struct(*base_features(F.col(text_col))), lambda x: x).alias(feature))
    f = {name: F.col(f"{feature}.{at}") for name, at in [("n_words", "by_words.n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "by_lines.n_dup_lines"), ("n_repeat_words", "by_words.n_repeat_words"), ("n_lines", "by_lines.n_lines")]}
    base = (f["n_words"] < 20) | (f["n_repeat_words"] * 100 > f["n_words"] * 30)
    soft = [
        f["n_symbols"] * 100 > f["n_words"] * 10,
        f["n_dup_lines"] * 100 > f["n_lines"] * 30,
        (f["word_chars"] * 2 < f["n_words"] * 5) | (f["word_chars"] > f["n_words"] * 12),
    ]
    own = {c: free_name(made, c) for c in [*BASE, "n_failed", "base_failed", "host_rate", "host_strict", "kept"]}
    failed = sum((r.cast("int") for r in soft), base.cast("int"))
    rows = rows.select(*made.columns, host, *(f[c].alias(own[c]) for c in BASE), failed.alias(own["n_failed"]), base.alias(own["base_failed"]))
    rows = written(rows, "quality")
    rates = host_rates(rows.select(host, own["n_failed"]), host, F.col(own["n_failed"]) > 0, sure, least)
    rates = rates.select(F.col("host").alias(host), F.col("rate").alias(own["host_rate"]), F.col("strict").alias(own["host_strict"]))
    kept = ~F.col(own["base_failed"]) & (~F.col(own["host_strict"]) | (F.col(own["n_failed"]) == 0))
    return rows.join(rates, host).drop(host).withColumn(own["kept"], kept)


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", sure: float = 0.6, least: int = 5) -> DataFrame:
    """The documents the rules keep, same columns."""
    flag = free_name(docs, "kept")
    return host_quality(docs, text_col, host_col, sure=sure, least=least).where(F.col(flag)).select(*docs.columns)
