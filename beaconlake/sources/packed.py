"""Log files in any packing as a data source: ``spark.read.format("packed_lines").load(path)``.

A file or the files of a folder (one level; names that begin with . or _ are left out; none is an error) become rows
(file, start, at, line). The packing is told by the first bytes, whatever the name: gzip, bzip2, xz or none. A file is
read in ranges of ``blockBytes``, and a task holds a block of it, never the file:

* plain text: a range owns the lines that begin in it;
* bzip2: a range owns the blocks whose marks, which needn't be at a byte, are in it; each is unpacked on its own;
* gzip: a range owns the members that begin in it, so a file of one member is one task, in a stream;
* xz: one task, in a stream.

A line that crosses ranges belongs to the range it begins in. Lines end at a line feed, one carriage return before it goes;
bytes that are no UTF-8 become replacement characters. start and at (place in the file of the range, number in it) order
the lines of a file.
"""

from __future__ import annotations

import bz2
import lzma
import sys
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers read files also where they can't import this package

GZIP, BZIP2, XZ = b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00"
BLOCK, END = 0x314159265359, 0x177245385090  # marks of a bzip2 block and of the end of a stream
STEP = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    at = urlparse(path)
    return (pafs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of a folder's files, by name."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(at))
    else:
        found = [info] if info.type == pafs.FileType.File else []
    files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
    if not files:
        raise ValueError(f"no file in {path}")
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [(prefix + p, size) for p, size in files]


def plain_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are in the range), from the range's start on."""
    f.seek(start)
    at = start
    while data := f.read(min(STEP, end - at) if at < end else STEP):
        yield data, at < end
        at += len(data)


def _member(f, at: int) -> Iterator[bytes]:
    """The unpacked bytes of a gzip member; returns where it ends. An error where it is none."""
    d = zlib.decompressobj(31)
    f.seek(at)
    while not d.eof:
        data = f.read(1 << 16)
        if not data:
            raise zlib.error("cut off")
        at += len(data)
        while data and not d.eof:
            if out := d.decompress(data, STEP):
                yield out
            data = d.unconsumed_tail
    return at - len(d.unused_data)


def _is_member(f, at: int) -> bool:
    """Whether a member begins there: 64 kB of it can be unpacked, or all of it (then its checksum is right too)."""
    size = 0
    try:
        for out in _member(f, at):
            size += len(out)
            if size >= 1 << 16:
                return True
    except zlib.error:
        return False
    return True


def _first_member(f, start: int, end: int) -> int | None:
    if start == 0:
        return 0
    at, before = start, b""
    while at < end:
        f.seek(at)
        data = before + f.read(min(STEP, end + len(GZIP) - 1 - at))
        base = at - len(before)
        k = data.find(GZIP)
        while k >= 0:
            if base + k >= end:
                return None
            if k + 3 < len(data) and data[k + 3] & 0xE0 == 0 and _is_member(f, base + k):
                return base + k
            k = data.find(GZIP, k + 1)
        if not data[len(before) :]:
            return None
        at = base + len(data)
        before = data[-3:]  # a mark, or the flags after it, may be cut
    return None


def gzip_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    at = _first_member(f, start, end)
    while at is not None:
        f.seek(at)
        head = f.read(STEP)
        zeros = len(head) - len(head.lstrip(b"\0"))
        if head and zeros == len(head):
            at += zeros
            continue
        at += zeros  # padding between members is fine
        if not head[zeros : zeros + 3] == GZIP:
            return  # the end, or what is no gzip
        own = at < end
        unpacked = _member(f, at)
        while True:
            try:
                yield next(unpacked), own
            except StopIteration as stop:
                at = stop.value
                break


def _marks(data: bytes) -> list[tuple[int, bool]]:
    """Bit positions of the marks in the bytes, and whether they are a block's."""
    found = []
    for mark in (BLOCK, END):
        for shift in range(8):
            seven = (mark << (8 - shift)).to_bytes(7, "big")  # the mark, ``shift`` bits into its first byte
            inner = seven[1:6]
            k = data.find(inner)
            while k >= 0:
                if k >= 1 and (k + 5 < len(data) or shift == 0):
                    first, last = data[k - 1] & (0xFF >> shift), data[k + 5] & (0xFF << (8 - shift)) & 0xFF if shift else 0
                    if first == seven[0] and last == seven[6]:
                        found.append((8 * (k - 1) + shift, mark == BLOCK))
                k = data.find(inner, k + 1)
    return sorted(found)


def _block(data: bytes, a: int, b: int) -> bytes:
    """The unpacked block between two bit positions, as a stream of its own."""
    bits = int.from_bytes(data[a >> 3 : (b + 7) >> 3], "big") >> (-b % 8) & ((1 << (b - a)) - 1)
    crc = bits >> (b - a - 80) & 0xFFFFFFFF
    n = b - a + 80
    return bz2.decompress(b"BZh9" + ((bits << 80 | END << 32 | crc) << (-n % 8)).to_bytes((n + 7) // 8, "big"))


def bzip2_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Blocks from the first mark in the range on. What looks like a mark within a block makes no whole block: then it goes on to the next."""
    f.seek(start)
    base, data, seen = start, b"", 0
    marks: list[tuple[int, bool]] = []  # bit positions in data, in order

    def more() -> bool:
        nonlocal data, seen
        got = f.read(STEP)
        data += got
        old = max(0, seen - 7)
        marks.extend(m for m in ((at + 8 * old, kind) for at, kind in _marks(data[old:])) if m not in marks)
        seen = len(data)
        return bool(got)

    while True:
        while marks and not marks[0][1]:
            marks.pop(0)  # the end of a stream: the next block is another one's
        if not marks:
            cut = max(0, len(data) - 7)
            base, data, seen = base + cut, data[cut:], seen - cut
            if not more():
                return
            continue
        a, out, k = marks[0][0], None, 1
        while out is None and (k < len(marks) or more()):
            if k < len(marks):
                try:
                    out = _block(data, a, marks[k][0])
                except (OSError, ValueError):
                    k += 1
        if out is None:
            marks.pop(0)  # no block: chance made its mark, or the file is cut off
            continue
        yield out, base * 8 + a < end * 8
        cut = marks[k][0] >> 3
        marks[:] = [(m - 8 * cut, kind) for m, kind in marks[k:]]
        base, data, seen = base + cut, data[cut:], seen - cut


def xz_chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    if start:
        return
    f.seek(0)
    d, data = lzma.LZMADecompressor(lzma.FORMAT_XZ), f.read(1 << 16)
    while True:
        if out := d.decompress(data, STEP):
            yield out, True
        data = b""
        if d.eof:  # another stream may follow, after zeros
            data = d.unused_data.lstrip(b"\0")
            while not data:
                if not (data := f.read(1 << 16)):
                    return
                data = data.lstrip(b"\0")
            d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        elif d.needs_input and not (data := f.read(1 << 16)):
            return


def chunks(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    f.seek(0)
    head = f.read(6)
    kind = gzip_chunks if head.startswith(GZIP) else bzip2_chunks if head.startswith(BZIP2) else xz_chunks if head == XZ else plain_chunks
    return kind(f, start, end)


def owned_lines(parts: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[list[bytes]]:
    """Lists of the lines of a range. Its first line is left out, unless the file begins there, and it goes on through the first line feed after its end."""
    held, skipping = b"", not first
    for data, own in parts:
        if not own and skipping:
            return  # all of the range is within one line
        if skipping:
            k = data.find(b"\n")
            if k < 0:
                continue
            data, skipping = data[k + 1 :], False
        if own:
            k = data.rfind(b"\n")
            if k < 0:
                held += data
                continue
            yield (held + data[:k]).split(b"\n")
            held = data[k + 1 :]
        else:
            k = data.find(b"\n")
            held += data if k < 0 else data[:k]
            if k >= 0:
                yield [held]
                return
    if held:
        yield [held]


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("blockBytes", 32 << 20))

    def partitions(self) -> list[Range]:
        return [Range(file, a, min(a + self.size, size)) for file, size in listed(self.path) for a in range(0, max(size, 1), self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(partition.file)
        n = 0
        with fs.open_input_file(at) as f:
            for found in owned_lines(chunks(f, partition.start, partition.end), partition.start == 0):
                for i in range(0, len(found), 8192):
                    lines = [(x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace") for x in found[i : i + 8192]]
                    k = len(lines)
                    columns = [pa.array([partition.file] * k), pa.array([partition.start] * k, pa.int64()), pa.array(range(n, n + k), pa.int64()), pa.array(lines)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "start", "at", "line"])
                    n += k


class PackedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return "file string, start long, at long, line string"

    def reader(self, schema) -> PackedReader:
        return PackedReader(dict(self.options))


def packed_lines(spark: SparkSession, path: str, block_bytes: int = 32 << 20) -> DataFrame:
    """(file, start, at, line) of a file or a folder; see the module."""
    listed(path)  # an empty folder is an error here, not in a task
    spark.dataSource.register(PackedLines)
    return spark.read.format("packed_lines").option("blockBytes", block_bytes).load(path)
