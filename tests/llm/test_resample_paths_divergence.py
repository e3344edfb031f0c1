"""Importance resampling, chosen paths and divergence against brute force, on messy and on generated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from beaconlake.llm import chosen_path, divergence, importance

LONG = "alpha beta gamma delta epsilon " * 20_000
ROWS = [(1, "One two three four", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id in this row", "en", "a"), (4, LONG, "en", "b"), (5, "One two three four", "fr", "a"), (5, "one TWO three four", "fr", None), (6, " \t\n ", "fr", "c"), (7, "été ÉTÉ x9y", "", "")]
CLASHES = "n_words n_features weight score rank row_ place_ part_ before_ drawn_ block words tuples totals docs node used rep component n low high least sketch sig gone_ needed_id term df run id value item part sources counts".split()


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASHES)) for r in ROWS], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def generated(spark):
    """Texts of a few templates with edits, a passage that many share, copies, and plain noise."""
    rng, rows = random.Random(7), []
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 20])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    for _ in range(60):
        rows.append(" ".join([word() for _ in range(rng.randrange(1, 60))] + (passage if rng.random() < 0.6 else [])))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def drawn(rows, target, n, buckets, share, least):
    """The contract, one document after the other."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: [" ".join(w[i : i + g]) for g in range(1, n + 1) for i in range(len(w) - g + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in grams(words(x))), Counter(bucket(f) for x in target for f in grams(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for doc_id, x in rows:
        w = words(x)
        weight = sum(gain(bucket(f)) for f in grams(w))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((i for i, r in enumerate(out) if r[4] >= least), key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][1]))
    rank = {i: k + 1 for k, i in enumerate(order[: len(order) * share[0] // share[1]])}
    return Counter((*r[:4], rank.get(i)) for i, r in enumerate(out))


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_is_the_plain_loop(spark, messy, generated, n):
    target = [" ".join(x.split()[:7]) for _, x in generated[:20]] + [None, "", "One two"]
    others = spark.createDataFrame([(x, "t!") for x in target], "text string, weight string")
    for docs, rows in ((messy, [r[:2] for r in ROWS]), (spark.createDataFrame(generated, "doc_id long, text string"), generated)):
        found = importance.resample(docs, others, share=(30, 100), min_words=4, n=n, buckets=500, block_bytes=2000).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == drawn(rows, target, n, 500, (30, 100), 4)
    assert importance.resample(messy.where("false"), others).count() == 0
    none = importance.resample(messy, others.where("false"), buckets=500, min_words=1).collect()
    assert len(none) == len(ROWS) and {r.weight for r in none if r.n_features == 0} == {0}


def test_drawn_documents_keep_their_columns(spark, messy):
    others = spark.createDataFrame([("alpha beta",)], "text string")
    kept = importance.drawn_documents(messy, others, share=(1, 1), min_words=20).collect()
    assert [r.doc_id for r in kept] == [4] and all(kept[0][c] == f"{c}!" for c in CLASHES)


def linked(rows, percent, k):
    sets = []
    for _, t in rows:
        w = lower(t).encode().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)].append(doc_id)
    return Counter((doc_id, len(sets[i]), min(least[top(i)], default=None)) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize(("small", "pairs", "depth"), [(512, 1 << 24, 62), (8, 60, 2)])
def test_chosen_paths_are_all_pairs(spark, messy, generated, monkeypatch, small, pairs, depth):
    """Also where nodes branch to the end of their coordinates and large ones are compared in blocks."""
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    f = lambda d: chosen_path.near_duplicates(d, small=small, pairs=pairs)
    got = f(spark.createDataFrame(generated, "doc_id long, text string")).collect()
    want = linked(generated, 85, 3)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 20 < sum(a != c for a, _, c in want) < len(generated) - 40
    if depth > 2:
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in f(messy).collect()) == linked([r[:2] for r in ROWS], 85, 3)
        assert f(messy.where("false")).count() == 0


def test_one_of_each_component_stays(messy):
    kept = chosen_path.without_near_duplicates(messy).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 6, 7] and all(r[c] == f"{c}!" for r in kept for c in CLASHES)


def test_trees_for_a_recall():
    """The chance of loss is that of a branching process: simulated, one tree loses as often as is solved for."""
    rng, lost = np.random.default_rng(1), 0
    for _ in range(4000):
        alive = 1
        for _ in range(40):
            alive = rng.binomial(2 * alive, 0.85) if alive < 200 else alive
        lost += alive == 0
    assert abs(lost / 4000 - 0.0311) < 0.01
    assert chosen_path.trees_for(85, 0.999999) == 4 and chosen_path.trees_for(85, 0.9) == 1
    assert 30 < chosen_path.fewest_equal(85) < 45


def test_minwise_values_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**64, 900, np.uint64))
    agreed = []
    for _ in range(60):
        b = np.unique(np.r_[rng.choice(a, 800, replace=False), rng.integers(0, 2**64, 100, np.uint64)])
        agreed.append((chosen_path.signatures([a])[0] == chosen_path.signatures([b])[0]).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.03  # 800 of 1000


def apart(rows, least, top):
    """The contract in Python's integers."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        w, lang, source = terms(text), lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(w))
        n[lang, source].update(w)
        n[lang, None].update(w)
    out = Counter()
    for lang, sources in groups.items():
        kept = sorted((t for t, c in df[lang].items() if c >= least), key=str.encode)
        share = lambda s: [1 + 10**9 * (n[lang, s][t] + 2) // (sum(n[lang, s][x] for x in kept) + 2 * len(kept)) for t in kept]  # noqa: B023, E731
        p = {s: share(s) for s in (*sources, None)}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            parts = {"pair": [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s], "term": [(-f(x, q), t.encode(), t) for t, x, q in zip(kept, p[s], p[None], strict=True) if n[lang, s][t] and x > q]}
            for part, found in parts.items():
                out.update((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[: None if part == "pair" else top]))
    return out


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence_is_the_plain_sum(spark, messy, generated, least):
    rng = random.Random(5)
    more = [(i, " ".join(f"{rng.choice('aébß')}{rng.choice('xyzé')}" for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), f"s{rng.randrange(7)}") for i in range(300)]
    for docs, rows in ((messy, ROWS), (spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), more)):
        found = divergence.divergence(docs, least=least, top=3, chunk=5, block=3).collect()
        assert Counter((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found) == apart(rows, least, 3)
    assert divergence.divergence(messy.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 1, 10**13, 4 * 10**15]), np.int64(5 * 10**15)
    assert divergence.shares(counts, total, 7).tolist() == [1 + 10**9 * (int(c) + 2) // (int(total) + 14) for c in counts]
