"""A training corpus from raw documents: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. When a
stage begins, the result of the one before is stored, so the scratch tables which that one left are deleted; no tables of
others are, nor those of another run. What a stage does with nulls, empty and very long texts, ties, repeated rows and
extra columns is what its operator's docstring says: null and empty texts fail the base rule and go in the first stage; of
equal texts the smallest id stays; extra columns are carried up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from beaconlake.llm.common import new_path, owned, release, table
from beaconlake.llm.decontaminate import decontaminate
from beaconlake.llm.mixing import mixed_documents
from beaconlake.llm.ngram_join import one_of_each
from beaconlake.llm.quality import kept_documents
from beaconlake.llm.queries import TARGETS
from beaconlake.llm.sstable import token_digests
from beaconlake.llm.tokens import vocabulary

#: The shares of TARGETS, with no document dropped.
MIX = {"growth": None, "floor": 1.0}


#: Who owns the scratch tables of the stages: a run, or whoever calls the stages one by one.
_RUN: ContextVar[str] = ContextVar("run", default="stages")


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, after the scratch tables of the stage before it have been deleted."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _RUN.get())
        with owned(_RUN.get()):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of linked documents."""
    return one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of benchmark items; those mostly made of them go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again as often as the target shares need: the least rate is 1, so none is dropped, and the words grow until the domains that are over are down to their share."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"), TARGETS, **MIX)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the sorted string tables of token ids hold, by document in ascending order; the copies that mixing made are encoded once."""
    return token_digests(spark, docs, vocabulary("word_bpe_49k.json"), combine=True, kept_chunks=1 << 18)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: The tokenizer and the mixing fit can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name_of_run = table(spark, sf_dir, "documents"), uuid4().hex
    token = _RUN.set(name_of_run)
    try:
        for k, (name, f) in enumerate(STAGES):
            found = f(spark, docs, sf_dir)
            if k + 1 == len(STAGES):
                return found
            with owned(f"{name_of_run} {k}"):
                path = new_path(spark, f"stage-{name}")
            found.write.parquet(path)
            docs = spark.read.parquet(path)
            release(spark, f"{name_of_run} {k - 1}")  # what this stage read
    finally:
        _RUN.reset(token)
