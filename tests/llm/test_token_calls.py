"""How texts go to the tokenizers library, and that ids and places are its own."""

import random

import pyarrow.parquet as pq

from beaconlake.llm import tokens
from beaconlake.llm.tokens import SpanEncoder, WordEncoder, vocabulary

ODD = ["", " ", "★", "a ★ b", "x★y ★★", "<|endoftext|> a<|endoftext|>b", "don't I'LL 12345 'S", "́a é Å", "한국 \U0001f600\U0001f468‍\U0001f469 z", "  a\n\n b\t c d  ", "q" * 300, "é" * 90, "İ ß \x00 \x85 end "]


def texts() -> list[str]:
    return ODD + [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]


def test_chunks_go_in_runs_and_have_their_own_ids(monkeypatch):
    enc, some = WordEncoder(vocabulary("word_bpe_49k.json")), texts()
    want = [e.ids for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
    sent, ids = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda x: sent.extend(x) or ids(x))
    got = [list(memoryview(x).cast("I")) for x in enc.encode(some)]
    assert got == want
    assert len(sent) < len({c for t in some for c in t.replace("\n", " ").split(" ")}) / 10


def test_places_are_the_librarys_and_cost_no_offsets(monkeypatch):
    enc, some = SpanEncoder(vocabulary("byte_bpe_50k.json")), texts()
    want = [[(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)] for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert enc.sizes is not None
    assert [list(map(tuple, enc.encode(t).tolist())) for t in some] == want


def test_places_of_other_tokenizers_are_asked_for():
    enc = SpanEncoder(vocabulary("word_bpe_49k.json"))
    assert enc.sizes is None and enc.encode("Ab  cd")[:, 1:].tolist() == [[0, 2], [4, 6]]


def test_copies_go_through_one_shuffle(spark, monkeypatch, tmp_path):
    from beaconlake.llm import sstable

    plans, written = [], sstable.written
    monkeypatch.setattr(sstable, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = [(i, f"text {i}") for i in range(300) for _ in range(1 + i % 9)] + [(None, "x"), (None, "x"), (299, None), (299, "")]
    found = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path), vocabulary("word_bpe_49k.json"), combine=True)
    assert sum(r.entries for r in found.collect()) == len(rows)
    assert plans[0].count("Exchange ") == 1


def test_pieces_go_to_the_library_once_and_ids_are_its_own(monkeypatch):
    letters = list("abIsSTtd'’ 09\n\t .,%-<>|_éÉßİıſhHªŸŉ★中²½\xa0\x0b\x1c\x85　﻿…€K한하¨") + ["́", "̱", "​", "‍", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "   "]
    pick = random.Random(1)
    some = texts() + ["".join(pick.choices(letters, k=pick.randrange(1, 30))) for _ in range(5000)] + [f"x{chr(c)} y{chr(c)}  Z'S {chr(c)} " for c in range(0x3100)]
    for kind, name in ((WordEncoder, "word_bpe_49k.json"), (SpanEncoder, "byte_bpe_50k.json")):
        enc = kind(vocabulary(name))
        want = [e.ids for e in enc.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert [list(memoryview(x).cast("I")) for x in enc.ids(some)] == want
    plain, sent = [t for t in texts() if t.isascii() and "<|" not in t], []
    for kind, name in ((WordEncoder, "word_bpe_49k.json"), (SpanEncoder, "byte_bpe_50k.json")):
        enc = kind(vocabulary(name))
        each = enc._each
        monkeypatch.setattr(enc, "_each", lambda x, each=each: sent.extend(x) or each(x))
        enc.ids(plain)
        once = len(sent)
        assert not [x for x in sent if " " in x.lstrip(" ") and len(x) > 1 and x.strip()]  # words, not texts
        enc.ids(plain)
        assert len([x for x in sent[once:] if len(x) <= tokens.LONGEST]) == 0
        sent.clear()


def test_batches_of_long_texts_are_small(spark, monkeypatch, tmp_path):
    from beaconlake.llm import sstable

    plain = sstable.combined

    def small(batches):
        def checked():
            for b in batches:
                assert b.nbytes < 8 << 20
                yield b

        return plain(checked())

    monkeypatch.setattr(sstable, "combined", small)
    rows = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 300000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = sstable.write_shards(rows, str(tmp_path), vocabulary("word_bpe_49k.json"), combine=True)
    assert sum(r.entries for r in found.collect()) == 40
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_copies_are_written_once_and_read_as_often(tmp_path):
    from beaconlake.llm import sstable

    draw, sizes = random.Random(3), []
    rows = [(sstable.key_of(i), draw.randbytes(4000)) for i in range(20)]
    for n in (1, 10):
        path = f"{tmp_path}/{n}.sst"
        out = sstable.Writer(open(path, "wb"), 1 << 16)
        for key, value in rows:
            for _ in range(n):
                out.add(key, value)
        out.add(rows[-1][0], b"")  # the same key, another value
        out.close()
        reader = sstable.Reader(path)
        assert list(reader) == [r for r in rows for _ in range(n)] + [(rows[-1][0], b"")] and len(reader.get(3)) == n
        assert all(sum(len(v) for _, v in reader.block(k)) < (1 << 16) + 4000 for k in range(len(reader.blocks)))
        sizes.append((tmp_path / f"{n}.sst").stat().st_size)
    assert sizes[1] < 1.7 * sizes[0]  # a block begins with its value in full


def test_a_step_takes_over_no_memory_of_others():
    from beaconlake.llm import ngram_join
    from beaconlake.llm.common import give_back

    ngram_join.shingle_sets([b"some words of a text"])
    tokens.encoder(WordEncoder, vocabulary("word_bpe_49k.json"))
    give_back("encoders")
    assert not ngram_join._hash and tokens._encoders
    give_back()
    assert not tokens._encoders


def test_decontamination_holds_few_texts_at_a_time(spark, monkeypatch):
    from beaconlake.llm import decontaminate as D

    def plain(text, sam, most):
        return text

    rows = spark.range(0, 64, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 100000) AS text")
    items = spark.createDataFrame([("a", "nothing of it is there")], "item_id string, text string")
    sizes = []

    def mapped(self, f, kinds):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": "ab " * 100_000} for i in range(64)])
        sizes.extend(x.num_rows for x in f(iter([batch])))
        return self

    monkeypatch.setattr(D, "without", plain)
    monkeypatch.setattr(type(rows), "mapInArrow", mapped)
    D.decontaminate(rows, items)
    assert sum(sizes) == 64 and max(sizes) <= 4
