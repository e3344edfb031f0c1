"""Delimited files are cut into rows a part at a time."""

import csv
import io
import random
import tracemalloc

import pandas as pd

from beaconlake.sources import exports


class Files:
    def mapInPandas(self, f, schema):  # noqa: N802
        return f


def test_a_files_lines_are_not_held_at_once():
    content = "Date\tClient\n".encode() + b"".join(b'2024-01-01\t"site %d"\n' % i for i in range(200_000))
    cut = exports.cells(Files())
    tracemalloc.start()
    rows = sum(len(x) for x in cut(iter([pd.DataFrame({"file": ["f"], "content": [content]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200_001
    assert peak < 4 * len(content)


def test_lines_are_those_of_the_whole_text():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", '"', "\n", "\r", "\r\n", "\x0b", "\x85", " ", ";"]) for _ in range(rng.randrange(30)))
        want = [x for x in text.splitlines(keepends=True) if x.strip()]
        for size in (1, 7, 1 << 20):
            assert list(exports._pieces(text, size)) == want, repr(text)
        assert list(csv.reader(exports._lines(text))) == list(csv.reader(io.StringIO("".join(want), newline="")))
