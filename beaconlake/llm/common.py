"""Helpers that the corpus operators share: words, scratch tables, shipping code to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[str | None] = ContextVar("owner of the scratch tables", default=None)

#: Bytes after lower-casing A-Z; every byte below 0x80 that is no ASCII letter or digit becomes a space.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def utf8(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text."""
    return utf8(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return utf8(text).translate(_ALNUM).split()


def alnum_bytes(text: str | None) -> bytes:
    """The text with the same byte length in which only the words of ``alnum_words`` aren't spaces."""
    return utf8(text).translate(_ALNUM)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset, a folder of our own in local mode (tests); on a cluster that is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="beaconlake-")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the application ends, or when its owner is released (see owned)."""
    path = f"{shared_dir(spark)}/beaconlake-{name}-{uuid.uuid4().hex}"
    _written(spark).append((_owner.get(), path))
    return path


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition) if partition else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Tables written inside go to Python in Arrow batches of about so many bytes at most (a longer row is a batch). A task holds several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: What modules keep in a Python worker from one task to the next, by name: what empties it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back(*but: str) -> None:
    """For tasks that begin a step: empties what other steps keep in this worker (all of KEPT but those named), and gives freed memory back to the system.

    Spark uses its workers again, and a worker holds what its largest task took; they share an executor's memory."""
    for name, empty in KEPT.items():
        if name not in but:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(texts: pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts: up to so many, and of about so many bytes unless one alone is longer."""
    sizes, first, held = pc.binary_length(texts).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > first and (i - first == rows or held + n > size):
            yield first, i - first
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes) - first


def _written(spark: SparkSession) -> list[tuple[str | None, str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_beaconlake_written"):
        sc._beaconlake_written = []
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), sc._beaconlake_written, None, True)
    return sc._beaconlake_written


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables that are written inside belong to the owner, who may release them together."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of an owner who has stored every result that was read from them. Those of others stay."""
    sc = spark.sparkContext
    _delete(sc._jvm, sc._jsc.hadoopConfiguration(), _written(spark), owner)


def _delete(jvm, conf, paths: list[tuple[str | None, str]], owner: str | None, every: bool = False) -> None:
    for x in [x for x in paths if every or x[0] == owner]:
        paths.remove(x)
        with contextlib.suppress(Exception):  # already gone, or the JVM is
            path = jvm.org.apache.hadoop.fs.Path(x[1])
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once in each session: it goes out through Spark's file server."""
    sc = spark.sparkContext
    if getattr(sc, "_beaconlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="beaconlake-")  # Spark serves the file from there as long as the application runs
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/beaconlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(at, x)
                    z.write(full, os.path.join("beaconlake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._beaconlake_shipped = True


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the DataFrame has no such column (case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
