"""Pipeline over documents: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import decontam, mixing, quality, resharding, simhash
from sieveline.llm.common import scratch_table, spread, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those of them that are labelled, keeps.

    Null, empty and blank texts go; repeated rows stay or go together; without labels of a good document all go. Long
    texts count whole, an empty table stays empty, all columns are kept."""
    return quality.quality_filter(docs, docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; null ids come last.

    Null texts are never compared and stay, empty ones are copies of each other; of repeated rows the least by a hash of
    all columns stays. Long texts count whole, an empty table stays empty, all columns are kept."""
    return simhash.dedup_filter(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, within 8 % edits.

    Null and empty texts and items match nothing; repeated rows stay or go together. Long texts are searched whole, an
    empty table or benchmark changes nothing, all columns are kept."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of 80 % of all tokens, sources weighted by tokens^0.7, none repeated.

    A null source is one of its own; sources without tokens go; rows of one id stay or go together. An empty table stays
    empty, all columns are kept."""
    return mixing.mix_filter(docs)


def reshard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with old_shard, new_shard and moved; least bytes moved.

    No row goes. A null source is an old shard of its own; null and empty texts have 0 bytes; rows of one id move
    together. Input columns of the three names give way. An empty table stays empty."""
    return resharding.reshard(docs)


STAGES = [("classify", classify), ("dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("reshard", reshard)]

#: SQL can't express the first stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return docs
