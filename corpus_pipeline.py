"""Documents to a training mix, in five stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontaminate, mixing, nearcopies, pii, toxicity
from docketry.llm.common import compact, load, scratch_dir


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labelled rows of docs, does not reject.

    Null and empty texts stay, equal texts go or stay together, ids only find labels; without
    labelled rows nothing is rejected, and an empty table stays empty.
    """
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.clean(compact(docs, docs.count()), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id in each group of near copies.

    Null, empty and blank texts are copies of each other. Rows with null ids stay; rows that repeat
    id and text are reduced to one; an empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Null and empty texts hold none; ids are not read; an empty table stays empty."""
    return decontaminate.clean(compact(docs, docs.count()), load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind. Null texts stay null, n_chars follows the text."""
    return pii.mask(compact(docs, docs.count()), pii.train(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the mix: doc_id, size, source, source_size, target, taken (words, repeats counted).

    A null source is a source, the last; null and empty texts have no words and are never taken;
    rows that repeat id and text are taken together.
    """
    return mixing.mix(compact(docs, docs.count())).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Hashes, trained models and masked texts have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
