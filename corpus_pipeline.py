"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``documents``. ``run`` writes what each stage returns and reads it again
as the next one's ``docs``, so a stage that fails or loses executors starts from files.

Defined results: null and empty texts fail the quality rules and go with the first stage; where a stage is given them, near-dedup
keeps them, decontamination keeps them and mixing counts no words. Rows with a null id are judged as others, are linked with
nothing, and share one coin and one shard address. Of rows that repeat an id with equal texts one stays. Columns besides those of
documents pass through every stage, whatever their names. An empty table gives an empty table with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, quality, sharding
from tessella.llm.common import materialize
from tessella.llm.decontam import Decontamination
from tessella.llm.neardup import NearDuplicates
from tessella.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, 0.8 or more."""
    return NearDuplicates(k=5, percent=80).deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return Decontamination(k=5, percent=80).decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard."""
    return sharding.assign(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Isolation forests, sketches and components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
