"""Findings: what reports say, in one typed table, ranked; and whole reports as ordered lines of JSON.

A finding has report, severity, type, subject, n (how many things it is about), value (what it weighs) and examples (three
at most, best first). Builders take the results of other operators; all of them aggregate, so none grows with the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities, worst first; kinds of sources whose absence is worst; findings that a report shows at most.
SEVERITIES = ["high", "medium", "low", "info"]
WORST_SOURCES = ["editorial", "ugc", "reviews"]
MOST = 6
COLUMNS = ["report", "severity", "type", "subject", "n", "value", "examples"]


def severity_rank(severity: Column) -> Column:
    """1 for the worst; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(at > 0, at).otherwise(len(SEVERITIES) + 1).cast("int")


def _grouped(rows: DataFrame, by: list[str], example: str, weight: Column) -> DataFrame:
    """n, value and the three examples of most weight (equal ones by name) of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("weight_"), example)
    weighed = rows.withColumn("weight_", weight.cast("double"))
    best = weighed.withColumn("at_", F.row_number().over(w)).where("at_ <= 3").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", example))), lambda x: x[example]).alias("examples"))
    return weighed.groupBy(*by).agg(F.count("*").alias("n"), F.sum("weight_").alias("value")).join(best, by)


def of_sources(gap: DataFrame) -> DataFrame:
    """A finding for each kind of core source of the answers that leave the brand out. gap: surveys.source_gap."""
    core = gap.where("stability = 'core' and type <> 'own'").withColumnRenamed("type", "kind")
    found = _grouped(core, ["kind"], "domain", F.col("core_in"))
    severity = F.when(F.col("kind").isin(WORST_SOURCES), "high").otherwise("medium")
    return found.select(F.lit("visibility").alias("report"), severity.alias("severity"), F.lit("core_sources").alias("type"), F.col("kind").alias("subject"), "n", "value", "examples")


def of_pages(issues: DataFrame) -> DataFrame:
    """A finding for each issue between two snapshots. issues: pages.diff."""
    found = _grouped(issues, ["issue", "severity"], "url", F.lit(1))
    return found.select(F.lit("pages").alias("report"), "severity", F.col("issue").alias("type"), F.lit("").alias("subject"), "n", "value", "examples")


def of_access(checks: DataFrame) -> DataFrame:
    """A finding for each type of check that some host fails. checks: access.audit."""
    found = _grouped(checks.withColumnRenamed("type", "check"), ["check", "severity"], "host", F.col("count"))
    return found.select(F.lit("access").alias("report"), "severity", F.col("check").alias("type"), F.lit("").alias("subject"), "n", "value", "examples")


def of_sites(worst: DataFrame) -> DataFrame:
    """A finding for each of a portfolio's sites that fell most. worst: portfolio.findings."""
    return worst.select(F.lit("portfolio").alias("report"), "severity", F.lit("site_fell").alias("type"), F.col("site").alias("subject"), F.col("actions").cast("long").alias("n"), (-F.col("pct")).cast("double").alias("value"), F.array("site").alias("examples"))


def of_migration(groups: DataFrame) -> DataFrame:
    """A finding for each lost group of a migration, by its clicks before. groups: migration.groups."""
    return groups.where("lost").select(F.lit("migration").alias("report"), F.lit("high").alias("severity"), F.lit("group_lost").alias("type"), F.col("target").alias("subject"), F.col("sources").cast("long").alias("n"), F.col("before").cast("double").alias("value"), F.array("target").alias("examples"))


def ranked(parts: list[DataFrame], most: int = MOST) -> DataFrame:
    """The ``most`` worst findings of each report with their rank: by severity, value (largest first), type and subject."""
    every = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    w = Window.partitionBy("report").orderBy(severity_rank(F.col("severity")), F.desc("value"), "type", "subject")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def report_lines(sections: list[tuple[str, DataFrame, list]]) -> DataFrame:
    """(section, name, at, json): a report's sections, each a (name, rows, order), as a line for each row.

    section and at order the lines: at is a number that rises with the section's order. Rows are sorted in ranges, so a
    section of any size is made, and can be written, in parallel; json is the row as an object."""
    parts = []
    for i, (name, rows, order) in enumerate(sections):
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        parts.append(one.select(F.lit(i).alias("section"), F.lit(name).alias("name"), F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("json")))
    return reduce(DataFrame.unionByName, parts)
