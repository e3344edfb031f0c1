"""License scan: ordered signature rules, gated by a keyword prefilter, with priorities and containment.

A rule is a regular expression over the normalised words of a text (A-Z lower-cased, one space between words) with a
label, a priority and a score. Over two hundred are written by hand (``license_rules``); identifiers and names of licenses
add hundreds by the templates of how they are written. A rule only runs where its keyword occurs: one pass of an
Aho-Corasick automaton over the text finds them. Detections are intervals of words; one that lies inside another of a higher
priority, or of the same priority and longer, is suppressed. The phrases of ``PHRASES`` are detections of their own that
nothing suppresses.

Null and empty texts have no words and no detections. Ties (same interval and priority) keep the label that sorts first.
Whole texts are scanned, however long; equal texts are scanned alike. Extra columns stay; names that are taken get leading
underscores. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import accumulate, groupby
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, free_name, ship
from .license_rules import SIGNATURES, SPDX

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Names of licenses by label, in normalised words; a number may follow a name as its version.
LICENSES = {
    "mit": ["mit", "mit x11", "expat"],
    "apache": ["apache", "apache software", "asl"],
    "gpl": ["gnu general public", "general public", "gnu gpl", "gpl"],
    "lgpl": ["gnu lesser general public", "lesser general public", "gnu library general public", "gnu lgpl", "lgpl"],
    "agpl": ["gnu affero general public", "affero general public", "gnu agpl", "agpl"],
    "bsd": ["bsd", "modified bsd", "new bsd", "simplified bsd", "bsd 2 clause", "bsd 3 clause", "freebsd", "two clause bsd", "three clause bsd"],
    "mpl": ["mozilla public", "mpl"],
    "epl": ["eclipse public", "epl"],
    "cddl": ["common development and distribution", "cddl"],
    "cpl": ["common public", "cpl"],
    "isc": ["isc", "internet systems consortium"],
    "zlib": ["zlib", "zlib libpng"],
    "artistic": ["artistic", "perl artistic", "clarified artistic"],
    "boost": ["boost software", "bsl"],
    "unlicense": ["the unlicense", "unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public"],
    "cc-by": ["creative commons attribution", "cc by", "ccby"],
    "cc-by-sa": ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"],
    "cc-by-nc": ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"],
    "cc-by-nd": ["creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"],
    "cc0": ["cc0", "creative commons zero"],
    "gfdl": ["gnu free documentation", "gfdl"],
    "ofl": ["sil open font", "open font", "ofl"],
    "psf": ["python software foundation", "psf"],
    "ruby": ["ruby"],
    "php": ["php"],
    "postgresql": ["postgresql"],
    "openssl": ["openssl", "ssleay"],
    "eupl": ["european union public", "eupl"],
    "osl": ["open software", "osl"],
    "afl": ["academic free", "afl"],
    "ms-pl": ["microsoft public", "ms pl"],
    "ms-rl": ["microsoft reciprocal", "ms rl"],
    "upl": ["universal permissive", "upl"],
    "ncsa": ["university of illinois ncsa open source", "ncsa"],
    "odbl": ["open database", "odbl"],
    "sspl": ["server side public", "sspl"],
    "busl": ["business source", "busl"],
    "elastic": ["elastic"],
    "bsd-4-clause": ["bsd 4 clause", "original bsd", "four clause bsd"],
}

#: How a license is named, with its score and priority; N stands for the name, V for a version that may follow.
TEMPLATES = [
    (r"(?:licensed|released|distributed|available|published|provided|redistributed?) (?:it )?under (?:the )?(?:terms of (?:the )?)?NV(?: licen[cs]e)?V", 0.95, 80),
    (r"terms (?:and conditions )?of (?:the )?NV licen[cs]eV", 0.9, 70),
    (r"(?:subject to|governed by|covered by|as per) (?:the )?NV licen[cs]eV", 0.85, 65),
    (r"NV licen[cs]e(?: (?:agreement|header|text))?(?: as published by the free software foundation)?(?: version| v)?V", 0.7, 50),
    (r"NV licen[cs]ed", 0.7, 45),
    (r"licen[cs]e (?:is )?NV", 0.6, 40),
]
_VERSION = r"(?: (?:version )?v?\d+(?: \d+)*)?"
#: Names of one short word may have their version glued to them (gplv3, lgpl2).
_GLUED = r"(?:v?\d+)?"


class Rule(NamedTuple):
    expression: re.Pattern
    key: str  # what must stand in the text for the rule to run: a word with its spaces, or the beginning of one
    label: str
    score: float
    priority: int
    named: bool  # made by a template, all of which have one of the words of _NAMING


def keyword(expression: str) -> str:
    """The longest word that every match of the expression has, with a space on both sides; brackets and what follows them are passed over."""
    plain, depth = [], 0
    for i, c in enumerate(expression):
        if c in "([":
            depth += 1
            plain.append("\0")
        elif c in ")]":
            depth -= 1
            plain.append("\0")
        elif not depth:
            plain.append("\0" if c in "?*+|^$\\." else c)
    words = [w for w in "".join(plain).split(" ") if w and "\0" not in w]
    if not words:
        raise ValueError(f"no word that all matches have: {expression}")
    return f" {max(words, key=len)} "


@cache
def rules() -> list[Rule]:
    """All rules, by priority: signatures written out, identifiers, and names in their templates."""
    found = []

    def add(expression: str, label: str, score: float, priority: int, key: str | None = None, named: bool = False) -> None:
        found.append(Rule(re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])"), key or keyword(expression), label, score, priority, named))

    for label, kinds in SIGNATURES.items():
        for score, priority, expressions in kinds:
            for x in expressions:
                add(x, label, score, priority)
    for label, ids in SPDX.items():
        for x in ids:
            add(rf"spdx license identifier {x}(?: only| or later)?", label, 1.0, 91, " spdx ")
    for label, names in LICENSES.items():
        for name in names:
            short = " " not in name and len(name) <= 5
            key = f" {name}" if short else f" {max(name.split(), key=len)} "
            for template, score, priority in TEMPLATES:
                add(template.replace("N", name + _GLUED * short).replace("V", _VERSION), label, score, priority, key, True)
    return sorted(found, key=lambda r: (-r.priority, r.label, r.expression.pattern))


@cache
def gate() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    """The automaton of keys, and the rules that each wakes."""
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.key, []).append(i)
    a = ahocorasick.Automaton()
    for key in by:
        a.add_word(key, key)
    a.make_automaton()
    return a, by


_NAMING = re.compile(r" (?:licen[cs]ed?|under) ")


def places(padded: str, phrase: str) -> list[int]:
    """Words before each place where the phrase stands."""
    found, words, seen, at = [], 0, 0, padded.find(f" {phrase} ")
    while at >= 0:
        words += padded.count(" ", seen, at)
        found.append(words)
        seen, at = at, padded.find(f" {phrase} ", at + 1)
    return found


def detections(padded: str) -> list[tuple[int, int, int, float, str]]:
    """(first word, last word, priority, score, label) of what is left after suppression, in order of place. padded: words with a space before and after each."""
    automaton, by = gate()
    awake = {w for _, w in automaton.iter(padded)}
    naming = bool(_NAMING.search(padded))
    found = set()
    text = padded[1:-1]
    spaces = None
    for i in sorted({i for w in awake for i in by[w]}):
        expression, _, label, score, prio, named = rules()[i]
        if named and not naming:
            continue
        for m in expression.finditer(text):
            if spaces is None:
                spaces = [at for at, c in enumerate(text) if c == " "]
            first = bisect_left(spaces, m.start())
            found.add((first, first + m[0].count(" "), prio, score, label))
    return sorted(uncontained(found))


def uncontained(found: set[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """The detections that lie in no other of a higher priority, or of the same priority and longer; of equal ones, the first label."""
    kept: list[tuple[int, int, int, float, str]] = []
    for _, level in groupby(sorted(found, key=lambda d: (-d[2], d[0], -d[1], d[4])), key=lambda d: d[2]):
        higher = sorted(d[:2] for d in kept)
        starts, reach = [d[0] for d in higher], list(accumulate((d[1] for d in higher), max))
        last = -1
        for d in level:
            before = bisect_right(starts, d[0])
            if d[1] > last and not (before and reach[before - 1] >= d[1]):
                kept.append(d)
                last = d[1]
    return kept


def scan(text: str | bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, float, str]]]:
    """Number of words, base places (word, label) in order, detections."""
    words = alnum_words(text)
    if not words:
        return 0, [], []
    padded = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base = sorted((word, label) for phrase, label in PHRASES.items() for word in places(padded, phrase))
    return len(words), base, detections(padded)


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, base (array of word, label), found (array of first, last, priority, score, label)."""
    ship(docs.sparkSession)
    names = [free_name(docs, x) for x in ("n_words", "base", "found")]
    columns = list(docs.columns)
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("score", pa.float64()), ("label", pa.string())]))
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` long", f"`{names[1]}` array<struct<word:bigint,label:string>>", f"`{names[2]}` array<struct<first:bigint,last:bigint,priority:int,score:double,label:string>>"]

    def scanned(batches):
        for b in batches:
            rows = [scan(t) for t in b.column(text_col).to_pylist()]
            new = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[dict(zip(("word", "label"), x, strict=True)) for x in r[1]] for r in rows], base_type),
                pa.array([[dict(zip(("first", "last", "priority", "score", "label"), x, strict=True)) for x in r[2]] for r in rows], found_type),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, *names])

    return docs.mapInArrow(scanned, ", ".join(kinds))
