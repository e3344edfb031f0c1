"""Crawler hits on a stream of log lines: windows with a watermark, and daily buckets that take every line, however late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs
from ..sources.logs import parse_combined

BUCKET = ["day", "bot", "verdict"]


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of a folder as they arrive; a file counts once, also over restarts from the same checkpoint."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def hits(lines: DataFrame, cidr: DataFrame) -> DataFrame:
    """Crawler hits with their verdict. cidr is static."""
    found = logs.classify(parse_combined(lines).where("parsed")).where("bot is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    verdict = F.when(F.col("inside"), "verified").when(logs.web.forged("url", "method"), "spoofed").otherwise("unverifiable")
    return logs.with_blocks(found, cidr).withColumn("verdict", verdict)


def windowed(lines: DataFrame, cidr: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Hits by window, bot and verdict; lines later than ``late`` are dropped by the watermark, which bounds the state."""
    return hits(lines, cidr).withWatermark("ts", late).groupBy(F.window("ts", window), "bot", "verdict").agg(F.count("*").alias("hits"))


def keep_buckets(lines: DataFrame, cidr: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds the hits and bytes of each micro-batch to daily buckets under path; read them with ``buckets``. No line is too late.

    A batch is summed up and written as a partition of its own, named by its number, which a batch that is run again after a
    failure overwrites: so each counts exactly once, and no state is held between batches but the numbers."""

    def add(batch: DataFrame, number: int) -> None:
        day = F.to_date("ts").alias("day")
        summed = batch.groupBy(day, "bot", "verdict").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))
        summed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits(lines, cidr).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """day, bot, verdict, hits and bytes of all batches so far."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy(*BUCKET).agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"))
