"""The corpus queries against their SQL, brute force or the library that they must agree with."""

import html
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from beaconlake.llm import queries as Q
from beaconlake.llm.common import table
from beaconlake.llm.tokens import vocabulary

DATA = oracle.DATA
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}


def test_op3_verdicts_differ_between_hosts(spark):
    """Soft failures are kept on some hosts and not on others, by the hosts' shrunk rates."""
    rows = Q.op3_host_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r.kept == (not r.base_failed and (r.n_failed == 0 or not r.host_strict)) for r in rows)
    soft = [r for r in rows if r.n_failed and not r.base_failed]
    assert {r.kept for r in soft} == {True, False}
    assert min(r.host_rate for r in rows if r.host_strict) > max(r.host_rate for r in rows if not r.host_strict)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    oracle.same(spark, Q.queries()[name], Q.oracle_sql()[name])


def test_op1_is_a_permutation_with_exact_sizes(spark, docs):
    rows = Q.op1_hypergeometric_sharding(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert len(by) == 40 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op4_base_places(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in Q.op4_license_rules(spark, DATA).collect():
        w = ALNUM.findall(lower(docs[r.doc_id]))
        found = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        base = {x[1] for x in found}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) and 0 <= r.score <= 1


def main_text_of(page):
    """Of the test pages, whose articles are one element with headings and paragraphs: by splitting the article at tags."""
    if not page:
        return ""
    article = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", article[1].replace("<br>", " ")) if article else []
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_op5_gives_the_articles_of_all_pages(spark, data):
    want = {r.page_id: (r.url, main_text_of(r.html)) for r in table(spark, data, "pages").collect()}
    got = {r.page_id: (r.url, r.text) for r in Q.op5_dom_marginals(spark, data).collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in Q.op5_dom_marginals(spark, data).collect())


def test_op7_ranks_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in table(spark, data, "labels").collect()}
    rows = Q.op7_nearest_toxic(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    yes, no = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.85
    # Neighbours by the whole vocabulary: every text with words has evidence, but for those of unknown words only.
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    bare = [r for r in rows if not r.evidence]
    assert len(bare) < len(rows) / 50 and len({r.score for r in bare}) <= 1
    # An exact copy of an example has it, or a copy of it, as a neighbour.
    some = [r for r in rows if r.doc_id in truth and not r.held_out and len((texts[r.doc_id] or "").split()) > 20]
    assert len(some) > 100 and all(r.doc_id in r.evidence or any(texts[e] == texts[r.doc_id] for e in r.evidence) for r in some)


def test_op8_counts_sum_to_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for r in Q.op8_offset_token_counts(spark, DATA).collect():
        got[r.doc_id][r.section] = r
    assert sorted(got) == sorted(docs)
    for doc, sections in got.items():
        text = docs[doc] or ""
        e = tok.encode(text, add_special_tokens=False)
        starts = [0] + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
        want = Counter(int(np.searchsorted(starts, a, "right")) - 1 for a, _ in e.offsets)
        assert [sections[i].section_tokens for i in range(len(starts))] == [want.get(i, 0) for i in range(len(starts))]
        assert {s.n_tokens for s in sections.values()} == {len(e.ids)}


def test_op9_is_what_the_library_encodes(spark, docs):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in Q.op9_sorted_string_tables(spark, DATA).collect()}
    assert sorted(rows) == sorted(docs)
    for doc in sorted(docs):
        ids = [*tok.encode(docs[doc] or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[doc])[1:4] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10_meets_its_targets(spark):
    from beaconlake.llm.mixing import DOMAINS

    rows = Q.op10_soft_mixing(spark, DATA).collect()
    t, r = np.array([x.n_tokens for x in rows], float), np.array([x.rate for x in rows])
    p = np.array([[x[f"p_{d}"] for d in DOMAINS] for x in rows])
    goal = np.array([Q.TARGETS[d] for d in DOMAINS])
    assert (r >= 0).all() and np.allclose(p.sum(1), 1, atol=1e-5)
    # The totals are the targets, to a thousandth of each.
    assert np.allclose((r * t) @ p / t.sum(), goal, rtol=1e-3)
    # Many plain projected gradient steps lead to the same totals.
    x = np.ones(len(rows))
    for _ in range(4000):
        x = np.maximum(0, x - 0.9 * (p @ ((x * t) @ p / t.sum() - goal)))
    assert np.allclose((x * t) @ p / t.sum(), goal, rtol=1e-3)
    assert all(np.floor(a) <= c.copies <= np.ceil(a) for a, c in zip(r, rows, strict=True))


def test_pipeline_against_the_stages_by_brute_force(spark, docs):
    import corpus_pipeline as P
    import duckdb
    from tokenizers import Tokenizer

    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_files"]
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    kept = [x[0] for x in db.execute(f"SELECT doc_id FROM ({Q.SQL['op3_host_quality']}) WHERE kept").fetchall()]
    db.execute("CREATE TABLE good AS SELECT * FROM documents WHERE list_contains(?, doc_id)", [kept])
    one = [x[0] for x in db.execute(f"SELECT doc_id FROM ({re.sub(r'FROM documents', 'FROM good', Q.SQL['op2_ngram_jaccard_join'])}) WHERE doc_id = component_id").fetchall()]
    items = [ALNUM.findall(lower(x[0])) for x in db.execute("SELECT text FROM benchmark").fetchall()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}

    def cut(text):
        """Without hit words, until no window is left; None beyond half of the words."""
        total = gone = 0
        while True:
            at = list(ALNUM.finditer(lower(text or "")))
            w, hit = [m.group() for m in at], set()
            total = total or len(w)
            for n in {len(x) for x in windows}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit.update(range(i, i + n))
            if not hit:
                return text
            gone += len(hit)
            if gone > 0.5 * total:
                return None
            runs, out, last = [], [], 0
            for i in sorted(hit):
                if runs and runs[-1][1] == i:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
            for a, b in runs:
                out.append(text[last : at[a].start()])
                last = at[b - 1].end()
            text = "".join([*out, text[last:]])

    clean = {d: cut(docs[d]) for d in one}
    clean = {d: t for d, t in clean.items() if t is not None}
    tok, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    got = sorted(P.run(spark, DATA).collect(), key=lambda r: r.start)
    assert set(clean) == {r.doc_id for r in got}  # rates are 1 at least
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    for r in got:
        ids = [*tok.encode(clean[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_entry_lists_all_of_them():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    assert len([n for n in e.queries() if re.match(r"op\d+_", n)]) == 10 and "pipeline" in e.queries()
