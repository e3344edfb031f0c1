"""Scratch tables in the folder of spark.checkpoint.dir: cuts of long plans that survive lost executors and go when the application ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: one of our own in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        sc = spark.sparkContext
        path = getattr(sc, "_beaconlake_folder", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = sc._beaconlake_folder = tempfile.mkdtemp(prefix="beaconlake-")
            atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # already gone, or the JVM is
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/beaconlake-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows, computed now and read from the shared folder from here on."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def let_go(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has returned, as nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df._scratch)
