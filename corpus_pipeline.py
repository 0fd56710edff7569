"""From raw documents to shards: five stages, each by one operator of docketry.llm.

Every stage works on all rows that the one before it kept and takes (spark, docs, sf_dir).
Defined cases, in all stages: an empty table gives an empty table; texts of any length are
taken whole; further columns, whatever their names, are handed through by all stages but the
last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import classifier, decontaminate, mixing, sharding, simhash
from docketry.llm.base import materialize, table

N_SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject. A null text is judged as an
    empty one; equal texts stay or go together, under any key; without usable labels all stay."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the
    one of least key, a null key first. Null and empty texts are alike, and one of them stays;
    of rows that share key and text, too."""
    return simhash.one_of_each(docs, similarity=0.8, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts, and items, match
    nothing; repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix of sources, repeated as often as the mix takes them. A null source is one
    of its own; a row without words is taken where its source is used up whole; rows that
    share a key are chosen one by one, ties by key, then size."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix. A null key is the text "null"; repeated rows share
    a shard and have slots of their own."""
    return sharding.shard_rows(docs, [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Training, fingerprints and alignment have no counterpart in SQL; tests/llm/test_methods.py
#: holds each stage of run() against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
