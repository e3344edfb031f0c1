"""Token counts of the sections of a text by offset mapping.

The ids are those of the whole text, never of a section. Its tokens are intervals of characters, in order, and so are its sections, so a merge (a
binary search of each token's place among the sections' starts) joins them. A token that crosses a boundary is allocated
by an explicit rule:

    "first"     to the section of its first character;
    "last"      to the section of its last character;
    "most"      to the section that has most of its characters, the earlier one on a tie.

Sections are given as their first characters, ascending from 0; the last one ends with the text. The counts of a text's
sections sum to its tokens. A byte-level token without a character of its own (the rest of a character's bytes) goes where
its character is. ``field_counts`` does the same for the fields of a record: they are joined by a separator, encoded once,
and each is a section (the separator belongs to the field that it ends).

Null and empty texts have one section with no token; null fields are empty. Very long texts are not cut. Repeated
rows are counted alike. Extra columns stay; names that are taken get leading underscores. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, ship
from .tokens import SpanEncoder, encoder

RULES = ("first", "last", "most")

#: Rows whose texts go to the encoder together.
TOGETHER = 32


def line_starts(text: str) -> list[int]:
    """A section for each line; the line break belongs to the line that it ends."""
    out, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def allocate(spans: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary; an empty section has none. spans: [token, (first character, last character plus one)]."""
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(starts, a, "right") - 1
    last = np.searchsorted(starts, b - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    to = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        ends = np.append(starts[1:], length)
        for t in crossing:
            inside = np.arange(first[t], last[t] + 1)
            to[t] = inside[np.argmax(np.minimum(ends[inside], b[t]) - np.maximum(starts[inside], a[t]))]
    return np.bincount(to, minlength=len(starts)), len(crossing)


def section_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", sections=line_starts, rule: str = "first") -> DataFrame:
    """The rows with n_tokens, crossing (tokens over a boundary) and sections: array of (first character, characters, tokens)."""
    return _counted(docs, vocabulary, [text_col], lambda fields: (fields[0], sections(fields[0])), rule)


def field_counts(docs: DataFrame, vocabulary: str, fields: list[str], separator: str = "\n", rule: str = "first") -> DataFrame:
    """The same columns for the text columns ``fields`` as one text: a section for each, in their order."""

    def joined(values: list[str]) -> tuple[str, list[int]]:
        sizes = [len(v) + len(separator) for v in values[:-1]]
        return separator.join(values), [0, *accumulate(sizes)]

    return _counted(docs, vocabulary, fields, joined, rule)


def _counted(docs: DataFrame, vocabulary: str, fields: list[str], sectioned: Callable[[list[str]], tuple[str, list[int]]], rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    names = [free_name(docs, x) for x in ("n_tokens", "crossing", "sections")]
    columns = list(docs.columns)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("chars", pa.int64()), ("tokens", pa.int64())]))
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` long", f"`{names[1]}` long", f"`{names[2]}` array<struct<first:bigint,chars:bigint,tokens:bigint>>"]

    def counted(batches):
        enc = encoder(SpanEncoder, vocabulary)
        for b in batches:
            total, over, offsets, flat = [], [], [0], []
            for at in range(0, b.num_rows, TOGETHER):
                rows = [sectioned([v or "" for v in values]) for values in zip(*(b.column(f).slice(at, TOGETHER).to_pylist() for f in fields), strict=True)]
                for (text, first), spans in zip(rows, enc.spans([text for text, _ in rows]), strict=True):
                    starts = np.array(first, np.int64)
                    n, crossing = allocate(spans[:, 1:], starts, len(text), rule)
                    total.append(int(n.sum()))
                    over.append(crossing)
                    flat.append(np.stack([starts, np.diff(np.append(starts, len(text))), n]))
                    offsets.append(offsets[-1] + len(starts))
            values = np.concatenate(flat, axis=1) if flat else np.empty((3, 0), np.int64)
            parts = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(kind.value_type))
            new = [pa.array(total, pa.int64()), pa.array(over, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, *names])

    return docs.mapInArrow(counted, ", ".join(kinds))
