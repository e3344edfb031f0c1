"""Token ids of documents as sorted-string-table shards.

A shard is a file of blocks. A block holds entries in ascending key order; an entry drops what its key shares with the
key before (prefix compression). After the blocks come a sparse index (first key, place and size of each block), a
Bloom filter of the keys and a footer of fixed size. A reader finds a document by the Bloom filter, a binary search in the
index and one block.

    block   zlib of entries: shared u8, rest u8, value bytes u32, key rest, value (ids, little-endian u32);
            of an entry with the key and value of the one before it in its block, value bytes is 2^32 - 1 and nothing follows
    index   entries: key length u8, key, offset u64, size u32
    bloom   bits, k hashes of xxh3_128
    footer  "<QQQQQQB7x8s": index at, bloom at, footer at, entries, ids, Bloom bits, hashes, magic

Keys are a byte 0 for a null id (they come first) or 1 and the id as 8 big-endian bytes with the sign flipped. Repeated
ids keep all their rows, in input order. Null and empty texts have the end id only. Very long texts are one value, encoded
whole. Columns other than the two named are left out. An empty table gives no shards and an empty result. A task writes to a
name of its own and renames at its end, so a repeated task replaces the same file.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, new_path, ship, small_batches, written
from .common import parts as _parts
from .tokens import WordEncoder, encoder

FOOTER, MAGIC = struct.Struct("<QQQQQQB7x8s"), b"BLSSTAB1"
_ENTRY, _INDEX = struct.Struct("<BBI"), struct.Struct("<QI")
#: Value bytes of an entry that is the same as the one before.
_SAME = (1 << 32) - 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    at = urlparse(path)
    return (pafs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pafs.FileSystem.from_uri(path)


def _places(key: bytes, bits: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    def __init__(self, sink, block_bytes: int):
        self.sink, self.block_bytes, self.at = sink, block_bytes, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.block: list[bytes] = []
        self.size, self.n, self.ids, self.last, self.first, self.value = 0, 0, 0, b"", b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.block and key == self.last and value == self.value:
            self.block.append(_ENTRY.pack(len(key), 0, _SAME))
        else:
            self._new(key, value)
        self.size += len(value) + 8  # as read again, so that a block of copies is no larger for who reads it
        self.n, self.ids = self.n + 1, self.ids + len(value) // 4
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last, self.value = key, value
        if self.size >= self.block_bytes:
            self.flush()

    def _new(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]

    def flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append(bytes([len(self.first)]) + self.first + _INDEX.pack(self.at, len(data)))
            self.sink.write(data)
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self, bits_per_key: int = 10, k: int = 7) -> None:
        self.flush()
        bits = -(-max(64, len(self.keys) * bits_per_key) // 8) * 8
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _places(key, bits, k):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index + bytes(bloom) + FOOTER.pack(self.at, self.at + len(index), self.at + len(index) + len(bloom), self.n, self.ids, bits, k, MAGIC))
        self.sink.close()


class Reader:
    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        index, bloom, end, self.n, self.ids, self.bits, self.k, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or end != size - FOOTER.size:
            raise ValueError(f"not a whole shard: {path}")
        self.bloom = self.file.read_at(end - bloom, bloom)
        raw, i, self.keys, self.blocks = self.file.read_at(bloom - index, index), 0, [], []
        while i < len(raw):
            n = raw[i]
            self.keys.append(raw[i + 1 : i + 1 + n])
            self.blocks.append(_INDEX.unpack_from(raw, i + 1 + n))
            i += 1 + n + _INDEX.size

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.blocks[k]
        raw, i, key, value = zlib.decompress(self.file.read_at(size, at)), 0, b"", b""
        while i < len(raw):
            shared, rest, n = _ENTRY.unpack_from(raw, i)
            i += _ENTRY.size
            key = key[:shared] + raw[i : i + rest]
            i += rest
            if n != _SAME:
                value = raw[i : i + n]
                i += n
            yield key, value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with that document id."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self.bits, self.k)):
            return []
        found = []
        for k in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                break
            found += [np.frombuffer(v, "<u4") for x, v in self.block(k) if x == key]
        return found


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id, text and seq of the first of each run of equal ids and texts in a batch, and copies, their number."""
    give_back()
    for b in batches:
        new = np.ones(b.num_rows, bool)
        for c in ("doc_id", "text"):
            x, y = b.column(c).slice(1), b.column(c).slice(0, max(0, b.num_rows - 1))
            alike = pc.fill_null(pc.equal(x, y), False)
            if c == "doc_id":
                alike = pc.or_(alike, pc.and_(pc.is_null(x), pc.is_null(y)))
            same = alike if c == "doc_id" else pc.and_(same, alike)
        if b.num_rows:
            new[1:] = ~np.asarray(same)
            at = np.flatnonzero(new)
            out = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("doc_id", "text", "seq")), pa.array(np.diff(np.append(at, b.num_rows)), pa.int64())], ["doc_id", "text", "seq", "copies"])


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_bytes: int = 1 << 16, file_bytes: int = 1 << 28, combine: bool = False, kept_chunks: int = 1 << 20) -> DataFrame:
    """Writes the shards under path; returns a row for each file: shard, file, entries, ids, least and most (ids).

    combine: rows equal in id and text that follow each other go through the shuffle and the tokenizer once, with their number, and are written as often; for inputs with many copies.
    kept_chunks: encoded chunks that a worker keeps (about 200 bytes each): fewer take less memory and more time."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.mapInArrow(combined, "doc_id long, text string, seq long, copies long") if combine else rows.withColumn("copies", F.lit(1).cast("long"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("seq")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("seq"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        give_back("encoders")
        context = TaskContext.get()
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        enc, part, done, out, names = encoder(WordEncoder, vocabulary, kept_chunks), context.partitionId(), [], None, None

        def close():
            out.close()
            fs.move(*names)
            done.append((f"{part:06d}-{len(done):04d}", f"{path}/{names[1].rpartition('/')[2]}", out.n, out.ids, low, high))

        low = high = None
        for b in batches:
            for i, n in _parts(b.column("text")):  # few texts, and bytes of them, as Python strings at a time
                keys, texts, copies = (b.column(c).slice(i, n).to_pylist() for c in ("doc_id", "text", "copies"))
                each = ((k, x) for k, ids, m in zip(keys, enc.encode(texts), copies, strict=True) for x in repeat(ids + end, m))
                for doc_id, ids in each:
                    if out is not None and out.at >= file_bytes:
                        close()
                        out = None
                    if out is None:
                        final = f"{base}/part-{part:06d}-{len(done):04d}.sst"
                        names = (f"{base}/_{part:06d}-{len(done):04d}-{context.taskAttemptId()}", final)
                        out, low = Writer(fs.open_output_stream(names[0]), block_bytes), doc_id
                    out.add(key_of(doc_id), ids)
                    high = doc_id
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 4), strict=True)], ["shard", "file", "entries", "ids", "least", "most"])

    with small_batches(spark):
        return written(ranged.mapInArrow(write, "shard string, file string, entries long, ids long, least long, most long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), and ids (little-endian u32) of every entry, from the files."""
    first = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each file
    files = first.select("file", F.coalesce("base", F.lit(0)).alias("base"))
    spread = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches):
        give_back()
        for b in batches:
            for path, at in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                reader = Reader(path)
                for k in range(len(reader.blocks)):
                    rows = list(reader.block(k))
                    sizes = np.array([len(v) // 4 for _, v in rows], np.int64)
                    starts = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(x) for x, _ in rows], pa.int64()), pa.array(starts), pa.array([v for _, v in rows], pa.binary())], ["doc_id", "start", "ids"])

    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, combine: bool = False, kept_chunks: int = 1 << 20) -> DataFrame:
    """Writes the shards to the shared folder and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    stored = read_shards(write_shards(docs, new_path(spark, "shards"), vocabulary, combine=combine, kept_chunks=kept_chunks))
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
