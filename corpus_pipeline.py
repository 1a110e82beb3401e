"""From raw documents to shards: quality, near copies, benchmark passages, source mix, order.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes what a stage returns as a table and reads it as the next one's
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm import decontaminate, jaccard, mixing, quality, sharding
from sensorspark.llm.common import table, via_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled documents of this
    stage's input."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id, of rows that share it
    one. Documents that link to nothing all stay, those without words too."""
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears once for each time that it is taken."""
    return mixing.mixed_documents(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def order_and_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place on the curve, shard and slot."""
    ties = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns)]
    return sharding.shard(docs, sharding.document_dimensions(), F.octet_length(F.coalesce("text", F.lit(""))) + 1, ties)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", order_and_cut),
]

#: Training and edit distances are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = via_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
