"""Corpus preparation: quality rules, exact and near deduplication, source mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next stage's
`docs`. All but the last keep the columns of `documents`; the last adds the piece ids.

Defined cases are those of the operators: null and empty texts fail the quality rules, an empty table stays empty, rows that the
mixture repeats are encoded each, and null ids are never taken for near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import exact_dedup, mixing, near_dedup, pieces, quality
from runlens.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior of good quality is at least one half."""
    return quality.reject(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near_dedup.deduplicate(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates of their sources say."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece_ids and piece_count."""
    return pieces.encode(docs, decoded=False)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("source_mixture", source_mixture), ("token_ids", token_ids)]

#: The piece transducer is not expressible in SQL; tests compare the whole run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
