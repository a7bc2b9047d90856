"""The corpus operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, pii, quality, simhash, tokens, toxicity, warc, winnow
from .common import compact, crc_mod, load

TOKENIZER = "byte_bpe_50k.json"
THRESHOLD = 0.7


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def _classified(scores: DataFrame, n: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (crc_mod("doc_id", n) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rules = quality.train(docs, load(spark, sf_dir, "labels"), crc_mod("id", 4) != 2)
    return _classified(quality.scored(docs, rules), 4, 2)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(load(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), crc_mod("id", 3) != 1)
    return _classified(toxicity.scored(docs, model), 3, 1)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return mixing.mix(compact(docs, docs.count()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_quality_rules, op3_winnowing, op4_decontamination, op5_personal_data, op6_toxicity,
        op7_warc_index, op8_chat_format, op9_source_mix, op10_token_counts, pipeline,
    )
}

ORACLE_SQL = {"op4_decontamination": decontaminate.SQL, "op8_chat_format": chat.SQL}
