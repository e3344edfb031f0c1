"""Buckets of a stream over restarts, with late lines and a file that is there twice, against the batch query."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from beaconlake.operators import logs
from beaconlake.plans import adapters as A
from beaconlake.sources.logs import parse_combined
from beaconlake.streaming import logs as stream


def line(minute, day=1, agent="GPTBot/1.2", ip="10.0.0.7"):
    return f'{ip} - - [{day:02d}/Jan/2026:00:{minute:02d}:00 +0000] "GET /a HTTP/1.1" 200 10 "-" "{agent}"'


def test_buckets_over_restarts_are_the_batch(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "buckets"), str(tmp_path / "checkpoint")
    folder.mkdir()
    cidr = A.cidr(spark)
    runs = [[line(i, d) for i in range(5) for d in (1, 2)], [line(9, 1), line(3, 3, "ClaudeBot/1.0", "10.1.2.3"), "broken"], [line(1, 1, "Mozilla/5.0 Firefox")] + [line(30, 2)] * 4]
    for i, rows in enumerate(runs):
        (folder / f"log{i}").write_text("\n".join(rows) + "\n")
        for _ in range(2):  # again without new files: nothing is added
            stream.keep_buckets(stream.stream_lines(spark, str(folder)), cidr, path, checkpoint).awaitTermination()
    got = {(r.day, r.bot, r.verdict): (r.hits, r.bytes) for r in stream.buckets(spark, path).collect()}
    every = spark.read.text(str(folder)).withColumnRenamed("value", "line")
    batch = logs.verify(logs.classify(parse_combined(every).where("parsed")), cidr).where("bot is not null")
    want = {(r.day, r.bot, r.verdict): (r.hits, r.bytes) for r in batch.groupBy(F.to_date("ts").alias("day"), "bot", "verdict").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes")).collect()}
    assert got == want and sum(h for h, _ in got.values()) == 16
    assert Counter(d for d, *_ in got)[datetime.date(2026, 1, 3)] == 1


def test_windows_drop_what_is_too_late(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        rows = []
        found = stream.windowed(stream.stream_lines(spark, str(folder)), A.cidr(spark), "1 hour", "10 minutes")
        q = found.writeStream.outputMode("update").foreachBatch(lambda batch, _: rows.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["window"].start.day, r.bot): r.hits for r in rows}

    (folder / "a").write_text(line(1, 5) + "\n" + line(2, 5) + "\n")
    assert run() == {(5, "GPTBot"): 2}
    (folder / "b").write_text(line(1, 1) + "\n" + line(3, 5) + "\n")  # four days late; in time, and the state goes on
    assert run() == {(5, "GPTBot"): 3}
