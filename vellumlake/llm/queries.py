"""One query for each operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.llm import chat_format, language_id, mixing, mpeg_audio, near_dedup, pii, quality_classifier, quality_rules, sentencepiece_bpe, toxicity
from vellumlake.llm.common import stored, table

PIECES = os.environ.get("VELLUMLAKE_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")
TARGET_ENTROPY, MAX_REPETITION = 0.95, 2.0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(mixing.narrow(table(spark, sf_dir, "documents")), "narrow")
    return mixing.assignments(rows, mixing.plan(rows, TARGET_ENTROPY, MAX_REPETITION, tokens=F.col("n_tokens")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("_n_entities", "n_entities")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_features(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), width=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.learn(docs)
    return language_id.fused(language_id.evidence(docs, pages, model), model.languages)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), PIECES)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(rows))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_classifier.places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    out = quality_classifier.judged(rows, table(spark, sf_dir, "labels"), "host", "path", keep=["kind", "doc_id", "page_id", "host", "path"], html="html")
    names = {"_p": "doc_score", "_host_post": "host_posterior", "_path_post": "path_posterior", "_posterior": "posterior", "_kept": "kept"}
    return out.select("kind", "doc_id", "page_id", "host", "path", *(F.col(a).alias(b) for a, b in names.items()))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_mpeg_audio, op4_quality_rules, op5_minhash, op6_language_id, op7_sentencepiece, op8_chat_format, op9_toxicity, op10_quality_classifier)}
ORACLE_SQL = {"op8_chat_format": chat_format.SQL}
