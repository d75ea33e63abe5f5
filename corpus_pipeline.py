"""A training-data pipeline over documents: toxicity, exact dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontam, exact_dedup, mixing, simhash, toxicity
from larkspur.llm.common import Scratch, release, scratch, written


_MADE: dict[int, Scratch] = {}


def _stage(number: int):
    """What the stage before has made beside its output goes when a stage starts: by then that output is written and reread."""

    def decorate(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if number - 1 in _MADE:
                release(spark, _MADE.pop(number - 1))
            with scratch() as made:
                out = stage(spark, docs, sf_dir)
            _MADE[number] = made
            return out

        return run_stage

    return decorate


@_stage(1)
def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage(2)
def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@_stage(3)
def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_similar(docs)


@_stage(4)
def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage(5)
def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact_dedup),
    ("simhash near-dedup", _near_dedup),
    ("benchmark decontamination", _decontamination),
    ("mixing", _mixing),
]

#: The first stage is a learnt model, which SQL can't express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as kept:
            docs = written(stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")
        if i:
            release(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
