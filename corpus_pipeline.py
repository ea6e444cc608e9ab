"""The corpus pipeline: documents in, sharded training documents out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), and what it returns is written as Parquet and read
again as the next one's docs.

All stages take tables with nulls in any column, empty and very long texts, repeated rows, extra columns of any name, and no
rows at all; but for the last, they return the columns of documents as they are. Without rows they return none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.common import materialize, release, table
from loomframe.llm.decontamination import drop_contaminated
from loomframe.llm.langid import drop_unidentified
from loomframe.llm.mixing import mixed_documents
from loomframe.llm.sharding import shard_documents
from loomframe.llm.simhash import drop_near_duplicates


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: null texts, texts without letters and texts of no language learned go; repeated rows all stay."""
    return drop_unidentified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id. Null and empty texts are one component, as are equal texts."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than one word in twenty inside benchmark windows. Null and empty texts have no words, so they stay, as do repeated rows."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that domains meet their target weights; good documents keep their tokens.

    Null and empty texts have rates by their posteriors like all others, repeated rows each the same; without labels all rates are 1.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, which replace columns of these names. Null texts count a byte; repeated rows have slots of their own."""
    return shard_documents(docs, n_shards=16)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Fingerprints, the language model and the gradient steps are beyond SQL; the stages are tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
