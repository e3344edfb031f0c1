"""Packed log files: ranges of any size give each line once, for every packing; the data source on a folder."""

import bz2
import gzip
import io
import lzma
import random

import pytest

from beaconlake.sources import packed


def members(data, size):
    return b"".join(gzip.compress(data[i : i + size], 6) for i in range(0, len(data), size))


def text(lines, seed=3, longest=200):
    rng = random.Random(seed)
    return "\n".join("".join(rng.choices("abcdefghij é€", k=rng.randrange(longest))) for _ in range(lines)).encode()


PACKINGS = {
    "plain": lambda d: d,
    "gzip": gzip.compress,
    "gzip of members": lambda d: members(d, 7_001),
    "gzip with padding": lambda d: gzip.compress(d[:9_000]) + b"\0" * 512 + gzip.compress(d[9_000:]) + b"\0\0",
    "bzip2": lambda d: bz2.compress(d, 1),
    "bzip2 of streams": lambda d: b"".join(bz2.compress(d[i : i + 50_000], 9) for i in range(0, len(d), 50_000)),
    "xz": lzma.compress,
    "xz of streams": lambda d: lzma.compress(d[:30_000]) + b"\0" * 8 + lzma.compress(d[30_000:]),
}


def ranges(raw, size):
    out = []
    for a in range(0, max(len(raw), 1), size):
        f = io.BytesIO(raw)
        out += [x for part in packed.owned_lines(packed.chunks(f, a, min(a + size, len(raw))), a == 0) for x in part]
    return out


@pytest.mark.parametrize("size", [1_000, 4_096, 33_333, 10**9])
@pytest.mark.parametrize("name", PACKINGS)
def test_each_line_once(name, size):
    for data in (text(3_000), text(3_000) + b"\n", text(40, 5, 60_000), b"", b"\n", b"one", b"a\n\n\nb\n"):
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        raw = PACKINGS[name](data)
        if len(raw) / size < 600:
            assert ranges(raw, size) == want


def test_a_mark_by_chance_loses_nothing():
    """Random bytes hold gzip's first bytes and bzip2's mark, uncompressed as they are."""
    rng = random.Random(9)
    data = b"\n".join(rng.randbytes(50).replace(b"\n", b"") + rng.choice([packed.GZIP, packed.BLOCK.to_bytes(6, "big"), gzip.compress(b"x")]) for _ in range(4_000))
    for name in ("gzip", "gzip of members", "bzip2", "bzip2 of streams"):
        assert ranges(PACKINGS[name](data), 20_000) == data.split(b"\n")


def test_folder_of_all_packings(spark, tmp_path):
    want = []
    for i, (name, pack) in enumerate(PACKINGS.items()):
        data = text(2_000, i).replace(b"\n", b"\r\n")
        (tmp_path / f"log{i}").write_bytes(pack(data))  # no extension
        want += [(f"log{i}", x.decode()) for x in data.split(b"\r\n")]
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "log").write_bytes(b"not read")
    rows = packed.packed_lines(spark, str(tmp_path), block_bytes=5_000).collect()
    assert sorted((r.file.rpartition("/")[2], r.start, r.at, r.line) for r in rows) != []
    assert sorted((r.file.rpartition("/")[2], r.line) for r in rows) == sorted(want)
    in_order = [r.line for r in sorted(rows, key=lambda r: (r.file, r.start, r["at"])) if r.file.endswith("log4")]
    assert in_order == [x for f, x in want if f == "log4"]
    with pytest.raises(ValueError, match="no file"):
        packed.packed_lines(spark, str(tmp_path / "deeper" / "none"))
