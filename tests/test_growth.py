"""What larger tables have and small ones don't: pages of one URL, classes of near copies, many folders."""

import glob
import os
import random
import re
import time
from difflib import SequenceMatcher

import oracle
import pytest
from pyspark.sql import functions as F

from beaconlake import catalogue
from beaconlake.functions import text
from beaconlake.operators import passages, redirects
from beaconlake.storage import shared_folder

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", ["page_diff", "page_diff_summary"])
def test_pages_of_one_url(spark, tmp_path, name):
    rows = [(i, f"https://a.org/{i % 30}", f"<html><head><title>Page {i}</title></head></html>") for i in range(90)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    oracle.same(spark, catalogue.queries()[name], SQL[name], str(tmp_path))


def counting(spark, kind, f):
    """A function for columns that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def counted(*x):
        calls.add(1)
        return f(*x)

    return F.udf(counted, kind), calls


def test_close_slugs_of_one_family(spark, monkeypatch):
    """Slugs that all have two words in common are compared with their like, not with each other."""
    ratio, calls = counting(spark, "double", lambda a, b: SequenceMatcher(None, a, b).ratio())
    monkeypatch.setattr(redirects.T, "seq_ratio", ratio)
    n = 300
    old = redirects.inventory(spark.createDataFrame([(f"/zone/close-match-number-h{i}",) for i in range(n)], "url string"))
    new = redirects.inventory(spark.createDataFrame([(f"/zz/close-match-numbers-h{i}",) for i in range(n)], "url string"))
    assert {(r.key, r.target) for r in redirects._close(old, new).collect()} == {(f"/zone/close-match-number-h{i}", f"/zz/close-match-numbers-h{i}") for i in range(n)}
    assert calls.value <= 20 * n


def test_close_slugs_against_every_pair(spark):
    draw = random.Random(7)
    words = ["red", "read", "shoe", "shoes", "price", "prices", "guide", "big", "bigger", "a", "sale"]

    def slug():
        return "".join(w + draw.choice("-_") for w in draw.choices(words, k=draw.randrange(1, 6)))[:-1]

    olds, news = ({slug() for _ in range(150)} for _ in "ab")
    inventory = lambda slugs, folder: redirects.inventory(spark.createDataFrame([(f"/{folder}/{x}",) for x in sorted(slugs)], "url string"))
    tokens = lambda x: set(x.replace("_", "-").split("-"))
    want = {}
    for a in olds:
        if len(tokens(a)) > 1:
            near = [(-SequenceMatcher(None, a, b).ratio(), b) for b in news if len(tokens(a) & tokens(b)) >= len(tokens(a)) // 2]
            want |= {f"/o/{a}": f"/n/{min(near)[1]}"} if near and min(near)[0] <= -redirects.CLOSE else {}
    assert len(want) > 20
    assert {r.key: r.target for r in redirects._close(inventory(olds, "o"), inventory(news, "n")).collect()} == want


def test_repeated_passages_are_made_once(spark):
    text, calls = counting(spark, "string", lambda k: " ".join(f"w{(k // 3) * 100 + j}" for j in range(40)) + f" x{k}")
    n = 60
    rows = spark.range(n).select("id", F.col("id").alias("k"), text("id").alias("fold_text"))
    found = {r.k: r.other_page for r in passages.repeated(rows, "k").collect()}
    assert found == {k: min(x for x in range(n) if x // 3 == k // 3 and x != k) for k in range(n)}
    assert calls.value <= 2 * n


def test_repeated_passages_against_every_pair(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        w = draw.choice(texts).split() if texts and draw.random() < 0.7 else [f"v{draw.randrange(50)}" for _ in range(draw.randrange(1, 40))]
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w))] = f"v{draw.randrange(50)}"
        texts.append(" ".join(w))
    rows = [(k // 2, k % 2 + 1, t) for k, t in enumerate(texts)]

    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    want = {}
    for page, i, t in rows:
        near = [(p, j, round(len(runs(t) & runs(u)) / len(runs(t) | runs(u)), 2)) for p, j, u in rows if p != page and 2 * len(runs(t) & runs(u)) >= len(runs(t) | runs(u))]
        want |= {(page, i): min(near)} if near else {}
    assert 10 < len(want) < 60
    found = passages.repeated(spark.createDataFrame(rows, "k int, id int, fold_text string"), "k").collect()
    assert {(r.k, r.id): (r.other_page, r.other_id, r.overlap) for r in found} == want


def on_disk(spark):
    """Bytes of scratch tables and of shuffle files."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [blocks.apply(i).getPath() for i in range(blocks.size())]
    files = [f for f in files if os.path.basename(f).startswith("shuffle_")] + glob.glob(f"{shared_folder(spark).removeprefix('file://')}/beaconlake-*/part-*")
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def left_on_disk(spark, before, wanted):
    """Bytes that have come since, once they are few or Spark, which deletes shuffle files in the background, has had five seconds."""
    for _ in range(50):
        if (left := on_disk(spark) - before) < wanted:
            break
        time.sleep(0.1)
    return left


def test_repeated_passages_leave_little_on_disk(spark):
    """Texts, hashes and shuffle files go as soon as nothing reads them."""
    draw = random.Random(3)
    rows = [(k, 1, " ".join(f"w{draw.randrange(10**6)}" for _ in range(300))) for k in range(600)]
    rows += [(k + 600, 1, t + " more") for k, _, t in rows[:20]]
    frame, before = spark.createDataFrame(rows, "k int, id int, fold_text string"), on_disk(spark)
    found = passages.repeated(frame, "k")
    assert left_on_disk(spark, before, 200_000) < 200_000 < sum(len(t) for _, _, t in rows) / 5
    assert {r.k: r.other_page for r in found.collect()} == {a: b for k in range(20) for a, b in ((k, k + 600), (k + 600, k))}


def test_scores_leave_little_on_disk(spark):
    before, most = on_disk(spark), os.path.getsize(f"{oracle.DATA}/documents.parquet") / 3
    found = catalogue.queries()["pas_scores"](spark, oracle.DATA)
    assert left_on_disk(spark, before, most) < most
    assert found.count() > 0


def test_competing_passages_against_every_pair(spark):
    """The texts of a page are dealt out once, and all its pairs are compared."""
    draw = random.Random(8)
    words = [*(f"word{i}" for i in range(40)), "a", "of", "avec"]
    rows = []
    for k in range(80):
        texts, heads = [], []
        for i in range(draw.randrange(1, 7)):
            texts.append(" ".join(draw.choices(draw.choice([words, words[:20], words[20:]]), k=draw.choice([0, 29, 30, 40, 60]))) if not texts or draw.random() < 0.6 else draw.choice(texts) + " more")
            heads.append(draw.choice(["price of it", "prices of it", "what is it", "who made this", ""]))
            rows.append((k, i + 1, draw.choice([1, 2, 3]), len(texts[-1].split()), heads[-1], texts[-1]))

    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for k, i, level, n, h, t in rows:
        for k2, j, level2, n2, h2, t2 in rows:
            if k == k2 and i < j and min(level, level2) > 1 and min(n, n2) >= 30:
                one, two = ({w for w in x.split() if len(w) >= 4 and w not in passages.COMMON} for x in (t, t2))
                ratios = SequenceMatcher(None, h, h2).ratio(), len(runs(t) & runs(t2)) / len(runs(t) | runs(t2)), len(one & two) / min(len(one), len(two))
                if triggers := [x for x, r, least in zip(("heading", "verbatim", "topic"), ratios, (0.75, 0.30, 0.60), strict=True) if r >= least]:
                    want[k, i, j] = (*(round(r, 2) for r in ratios), triggers)
    assert len(want) > 40 and {x for *_, found in want.values() for x in found} == {"heading", "verbatim", "topic"}
    found = passages.competing(spark.createDataFrame(rows, "k int, id int, level int, words int, fold_heading string, fold_text string"), "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.k, r.a, r.b): (r.heading_ratio, r.body_ratio, r.topic_ratio, r.triggers) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(x[3] == want[p][3] and max(abs(a - b) for a, b in zip(x[:3], want[p][:3], strict=True)) < 0.011 for p, x in got.items())


def test_shingles_of_a_slice(spark):
    draw = random.Random(6)
    texts = [None, "", " ", "a", "a b", "a  b", "a b c d", "a b c d e", " ".join("xy" * 40)]
    texts += [" ".join(f"v{draw.randrange(6)}" for _ in range(draw.randrange(60))) for _ in range(200)]

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    slices = [[(r.k, r.n, r.g) for r in text.shingle_rows(rows, "t", 5, 3, at).collect()] for at in range(3)]
    assert all(g % 2**64 % 3 == at for at, found in enumerate(slices) for _, _, g in found)
    by = {}
    for k, n, g in sum(slices, []):
        assert n == len(runs(texts[k]))
        by.setdefault(k, []).append(g)
    assert {k: len(set(x)) for k, x in by.items()} == {k: len(runs(t)) for k, t in enumerate(texts) if runs(t)} == {k: len(x) for k, x in by.items()}
    assert len({g for x in by.values() for g in x}) == len(set().union(*map(runs, texts)))
    assert set(by[4]) == set(by[5])


def test_scores_have_a_short_plan(spark):
    """The driver keeps the text of a plan for each of its stages: measured passages are stored, not planned again at each use."""
    found = catalogue.queries()["pas_scores"](spark, oracle.DATA)
    assert len(found._jdf.queryExecution().toString()) < 300_000


def test_headers_are_read_from_first_lines_only(spark):
    from beaconlake.sources.logs import file_headers

    lines = spark.createDataFrame([("a", 0, 0, "ip\tua\turl"), ("a", 0, 1, "1.2.3.4\tx\t/")], "file string, start long, at long, line string")
    found = file_headers(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter") and "map_filter" in x]
    assert [r.file for r in found.collect()] == ["a"]


def test_passages_are_cut_where_their_page_is(spark):
    """A page's nodes are in one row: nothing is dealt out or sorted by page to cut it."""
    plan = catalogue.queries()["pas_measures"](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_white_space_is_squeezed_as_before(spark):
    draw = random.Random(2)
    rows = [("".join(draw.choices("ab \t\n  \u0085", k=draw.randrange(12))),) for _ in range(500)]
    found = spark.createDataFrame(rows, "t string").select(passages._squeezed(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b"))
    assert found.where("a <> b").count() == 0


def test_names_in_sentences_are_those_of_the_plain_way(spark):
    draw, common = random.Random(4), set(passages.COMMON)
    texts = ["".join(draw.choices(["Ab", "ab", "É", "él", "Øre", "ßa", "'", "-", "’", "The", "7", " ", " ", ",", "İ", "Paris"], k=draw.randrange(14))) for _ in range(800)]
    word = re.compile(passages.T.WORD)
    want = {t: sorted({w for w in word.findall(t)[1:] if w[0].isupper() and len(w) > 2 and w.lower() not in common}) for t in texts}
    one = spark.createDataFrame([(t,) for t in want], "text string").selectExpr("text", "0 AS words", "'' AS heading", "array('') AS hrefs", "array('') AS flags", "0 AS link_words")
    assert {r.text: r.proper_nouns for r in passages.measured(one).select("text", "proper_nouns").collect()} == want


def test_kpis_parse_the_log_once(spark, monkeypatch):
    from beaconlake.plans import logs

    parse, calls = logs.parse_combined, []
    monkeypatch.setattr(logs, "parse_combined", lambda lines: calls.append(1) or parse(lines))
    oracle.same(spark, catalogue.queries()["log_kpis"], SQL["log_kpis"])
    assert len(calls) == 1
