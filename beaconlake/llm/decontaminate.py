"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of the items (each item starts again at the root, so no match crosses two
items). Documents stream through it word by word; the length of the longest match that ends at a word tells which
windows of ``window`` item words end there. Items shorter than a window count as one window.

The items are a table of bounded size for one automaton (``max_words``, counted by Spark); a larger table is split by a hash
of the items' words and the documents pass through several automata. Nearly all states have one way on: these are flat
arrays, and only states with several have a dict. Items with equal words are one entry with several ids.

Null and empty texts have no words, on both sides. Very long texts are streamed whole. Repeated items and documents are
treated row by row. Words of an item without an id are hit like others, but it isn't named among the items. Extra columns
stay, in the benchmark they are ignored; names that are taken get leading underscores. Empty tables give empty results, and
without items nothing is hit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import alnum_bytes, alnum_words, free_name, give_back, parts, ship, written


class Automaton:
    """Suffix automaton of word numbers. For each state: word and target of its first way on (-1: none), suffix link, length.

    ``more`` has all ways of the states with several; ``ends`` the windows that end in a state, as (length, entry)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.names: list[list[str]] = []
        entries: dict[bytes, int] = {}
        coded: list[array] = []
        for name, words in items:
            if not words:
                continue
            codes = array("i", [self.number.setdefault(w, len(self.number)) for w in words])
            entry = entries.setdefault(codes.tobytes(), len(coded))
            if entry == len(coded):
                coded.append(codes)
                self.names.append([])
                last = 0
                for c in codes:
                    last = self._extend(last, c)
            if name is not None:
                self.names[entry].append(name)
        ends: dict[int, set[tuple[int, int]]] = {}
        for entry, codes in enumerate(coded):
            for length, state in self._windows(codes):
                ends.setdefault(state, set()).add((length, entry))
        self.ends = {state: tuple(sorted(found)) for state, found in ends.items()}
        # The nearest state on the path of suffixes, itself included, where a window ends.
        self.near = array("i", [-1]) * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[v] = v if v in self.ends else self.near[self.link[v]]

    def _next(self, v: int, c: int) -> int:
        """Where word c leads from v, -1 if nowhere."""
        if self.word[v] == c:
            return self.to[v]
        ways = self.more.get(v)
        return -1 if ways is None else ways.get(c, -1)

    def _lead(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (-1, c):
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _state(self, length: int) -> int:
        for a, x in ((self.word, -1), (self.to, -1), (self.link, 0), (self.length, length)):
            a.append(x)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for its strings of up to length[p] + 1 words."""
        copy = self._state(self.length[p] + 1)
        self.word[copy], self.to[copy], self.link[copy] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._next(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self._next(last, c)
        if q >= 0:  # another item has this string already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and self._next(p, c) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _windows(self, codes: array) -> Iterator[tuple[int, int]]:
        length = min(self.window, len(codes))
        v = 0
        for i, c in enumerate(codes):
            v = self._next(v, c)
            if i + 1 >= length:
                u = v
                while self.length[self.link[u]] >= length:
                    u = self.link[u]
                yield length, u

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (from, to) that occurrences cover, joined where they touch, and the ids of the items they are windows of."""
        word, to, link, length, near, ends, more, number = self.word, self.to, self.link, self.length, self.near, self.ends, self.more, self.number.get
        spans: list[list[int]] = []
        entries: set[int] = set()
        root = more.get(0, {})
        v = l = 0
        for i, w in enumerate(words):
            c = number(w, -1)
            if c < 0:
                v = l = 0
                continue
            while True:
                if word[v] == c:
                    v = to[v]
                    break
                ways = root if v == 0 else more.get(v)
                if ways is not None and c in ways:
                    v = ways[c]
                    break
                if v == 0:
                    l = -1
                    break
                v = link[v]
                l = length[v]
            l += 1
            u = near[v]
            while u > 0:
                most = 0
                for n, entry in ends[u]:
                    if n <= l:
                        most = max(most, n)
                        entries.add(entry)
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
                u = near[link[u]]
        return [(a, b) for a, b in spans], {name for e in entries for name in self.names[e]}


def _normal_words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def parts_of(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> tuple[DataFrame, int]:
    """The items (id, text) and how many automata of about max_words words they need."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return items, -(-(items.agg(F.sum(F.size(_normal_words(F.col("text"))))).first()[0] or 0) // max_words)


def automata(items: DataFrame, parts: int, window: int) -> Iterator[Automaton]:
    """One automaton for each part, at least an empty one. Items of equal words are in one part."""
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64(_normal_words(F.col("text"))), F.lit(parts)) == k)
        yield Automaton([(r.id, alnum_words(r.text)) for r in part.toLocalIterator()], window)
    if not parts:
        yield Automaton([], window)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 500_000) -> DataFrame:
    """The documents with n_words, spans (array of first and last-plus-one word) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    ship(spark)
    names = [free_name(docs, x) for x in ("n_words", "spans", "items")]
    kinds = [f"`{n}` {k}" for n, k in zip(names, ("long", "array<struct<a:int,b:int>>", "array<string>"), strict=True)]
    out = docs
    for k, automaton in enumerate(automata(*parts_of(benchmark, item_id, item_text, max_words), window)):
        held = spark.sparkContext.broadcast(automaton)
        columns = list(docs.columns)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

        def match(batches, held=held, again=k > 0, columns=columns):
            sam = held.value
            for b in batches:
                found = []
                for text in b.column(text_col).to_pylist():
                    words = alnum_words(text)
                    found.append((len(words), *sam.hits(words)))
                spans, items = [x[1] for x in found], [x[2] for x in found]
                if again:
                    spans = [joined([(s["a"], s["b"]) for s in old] + new) for old, new in zip(b.column(names[1]).to_pylist(), spans, strict=True)]
                    items = [new | set(old) for old, new in zip(b.column(names[2]).to_pylist(), items, strict=True)]
                kept = [b.column(f) for f in columns]
                new = [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([[{"a": s[0], "b": s[1]} for s in x] for x in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*columns, *names])

        if k:
            out = written(out, "matched")
        out = out.mapInArrow(match, ", ".join([*fields, *kinds]))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[^ ]+")


def word_places(text: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The text's bytes with only its words, and where these stand."""
    norm = alnum_bytes(text)
    return norm, [m.span() for m in _WORD.finditer(norm)]


def cut(text: str, places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
    for a, b in spans:
        parts.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def without(text: str | None, sam: Automaton, max_coverage: float) -> str | None:
    """The text without its hit spans, again until none is left; None if they cover more than max_coverage of its words."""
    total = gone = 0
    while text:
        norm, places = word_places(text)
        spans, _ = sam.hits([norm[a:b] for a, b in places])
        total = total or len(places)
        if not spans:
            break
        gone += sum(b - a for a, b in spans)
        if gone > max_coverage * total:
            return None
        text = cut(text, places, spans)
    return text


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5, max_words: int = 500_000, chars_col: str | None = "n_chars") -> DataFrame:
    """The documents, same columns, with the spans of benchmark windows cut out of their texts, again until none is left. Documents covered beyond max_coverage of their words go.

    chars_col: an integer column with the number of characters, set anew where a text is cut (None, or no such column: none is)."""
    ship(docs.sparkSession)
    columns = list(docs.columns)
    counts = chars_col in columns and chars_col != text_col and isinstance(docs.schema[chars_col].dataType, IntegralType)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def changed(b: pa.RecordBatch, now: list[str | None]) -> dict[str, pa.Array]:
        was = b.column(text_col).to_pylist()
        cols = {f: b.column(f) for f in columns} | {text_col: pa.array(now, b.schema.field(text_col).type)}
        if counts:
            old = b.column(chars_col).to_pylist()
            new = [o if n is None or n == t else len(n) for t, n, o in zip(was, now, old, strict=True)]
            cols[chars_col] = pa.array(new, b.schema.field(chars_col).type)
        return cols

    items, n_parts = parts_of(benchmark, item_id, item_text, max_words)
    if n_parts > 1:
        return _in_rounds(docs, items, n_parts, text_col, window, max_coverage, changed)
    held = docs.sparkSession.sparkContext.broadcast(next(automata(items, n_parts, window)))

    def clean(batches):
        give_back()
        for b in (x.slice(i, n) for x in batches for i, n in parts(x.column(text_col))):  # few texts as Python strings at a time
            was = b.column(text_col).to_pylist()
            now = [without(t, held.value, max_coverage) for t in was]
            cols = changed(b, now)
            keep = pa.array([t is None or n is not None for t, n in zip(was, now, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(keep)

    return docs.mapInArrow(clean, kinds)


def _in_rounds(docs: DataFrame, items: DataFrame, parts: int, text_col: str, window: int, max_coverage: float, changed) -> DataFrame:
    """What one automaton would cut, with several: a round joins the spans that all of them find, and cuts; rounds go on until nothing is found."""
    columns = list(docs.columns)
    total, gone, spans = (free_name(docs, x) for x in ("total_", "gone_", "spans_"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{total}` long", f"`{gone}` long", f"`{spans}` array<struct<a:int,b:int>>"])
    state = [total, gone, spans]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    rows = docs.withColumns({total: F.lit(-1).cast("long"), gone: F.lit(0).cast("long"), spans: F.array().cast("array<struct<a:int,b:int>>")})

    def passed(rows: DataFrame, automaton: Automaton) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(automaton)

        def match(batches):
            for b in batches:
                out = []
                for text, old in zip(b.column(text_col).to_pylist(), b.column(spans).to_pylist(), strict=True):
                    norm, places = word_places(text or "")
                    new, _ = held.value.hits([norm[x:y] for x, y in places])
                    out.append([{"a": x, "b": y} for x, y in joined([(s["a"], s["b"]) for s in old] + new)])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*columns, total, gone]), pa.array(out, kind)], [*columns, *state])

        return written(rows.mapInArrow(match, kinds), "matched")

    def cut_out(batches):
        for b in batches:
            now, totals, sums, keep = [], [], [], []
            for text, n, g, found in zip(*(b.column(c).to_pylist() for c in (text_col, *state)), strict=True):
                _, places = word_places(text or "")
                here = [(s["a"], s["b"]) for s in found]
                n, g = (len(places) if n < 0 else n), g + sum(y - x for x, y in here)
                now.append(cut(text, places, here) if here else text)
                totals.append(n)
                sums.append(g)
                keep.append(not here or g <= max_coverage * n)
            cols = changed(b, now) | {total: pa.array(totals, pa.int64()), gone: pa.array(sums, pa.int64()), spans: pa.array([[]] * len(now), kind)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(keep, pa.bool_()))

    while True:
        for automaton in automata(items, parts, window):
            rows = passed(rows, automaton)
        if not rows.where(F.size(spans) > 0).limit(1).count():
            return rows.select(*columns)
        rows = rows.mapInArrow(cut_out, kinds)
