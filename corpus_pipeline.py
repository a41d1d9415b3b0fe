"""A corpus from raw documents to packed batches: five stages, each an operator of strandsift.llm.

Every stage takes the table that the one before has written and works on all
of it. All but the last return the columns of documents.

In every stage a null text is an empty one, texts of any length count whole,
further columns of any name are carried along (but by the last), and an empty
table gives an empty one. Rows without id pass the first three stages as they
are and leave at the fourth, which cannot draw for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.llm import chosen_path, mixing, packing, sentence_spans, toxicity
from strandsift.llm.common import field, materialised


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, does not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: F.lit(False))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five words, similarity 0.8)."""
    return chosen_path.keep_first(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id holds already."""
    return sentence_spans.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in shuffled order."""
    return mixing.replicate(docs).select(*[field(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each document."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near duplicates", distinct), ("substring dedup", unrepeated), ("mixing", mixed), ("packing", packed)]

#: A trained classifier and a dynamic programme are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialised(docs, f"stage{k}")
    return docs
