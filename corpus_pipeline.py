"""From documents to packed training sequences, in five stages.

Every stage but the last returns the columns of ``documents``; each works on
all rows that the one before kept. ``run`` applies them in turn and keeps the
rows between two stages as Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftweave.llm import decontaminate, naming, near, packing, quality
from draftweave.llm.queries import VOCABULARY, quality_model, table
from draftweave.llm.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts are judged as empty ones, repeated rows alike, very long texts
    over all their blocks. An empty table stays empty.
    """
    return quality.accepted(docs, quality_model(spark, docs, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id.

    Null and empty texts are one text. Of rows that share id and text one
    stays; null ids rank last. Very long texts are compared whole. An empty
    table stays empty.
    """
    return naming.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words, null ones included, all stay, as do rows that share
    the smallest id. Very long texts are compared by their full sets. An empty
    table stays empty.
    """
    return near.deduplicate(docs, percent=85)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Texts without words, null ones included, stay; repeated rows share one
    fate; very long texts are searched whole. An empty benchmark removes
    nothing, an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences of 2048 ids.

    Null and empty texts are one piece of the end id; repeated rows are packed
    each; very long texts are cut. An empty table gives no pieces.
    """
    return packing.pack(docs, VOCABULARY, end=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL can express these stages; a test compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
