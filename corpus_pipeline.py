"""A corpus pipeline: quality classifier, near-duplicates, surrogates for personal data, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.llm import mixing, near_dedup, pii, quality_classifier, sentencepiece_bpe
from vellumlake.llm.common import stored, table
from vellumlake.llm.queries import MAX_REPETITION, PIECES, TARGET_ENTROPY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; texts unchanged. Null and empty texts are judged as empty, rows
    without an id by their text and site; equal rows fare alike; an empty table stays empty."""
    judged = quality_classifier.judged(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("_kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; five-word shingles, similarity 0.8. The texts are shuffled
    only if more ids go than may be broadcast. Rows without an id stay, and so do texts without words; rows that share
    an id are one document, and stay or go together."""
    gone = stored(near_dedup.components(docs, width=5).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    if gone.count() <= near_dedup.FEW:  # eight bytes each
        return docs.join(F.broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    return named.select(*COLUMNS).unionAll(docs.where("doc_id is null").select(*COLUMNS))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in the texts; n_chars follows where a text had entities. Rows are as many as before, null texts stay
    null and equal texts equal."""
    out = pii.replace(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("_n_entities") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, by the weights of its source; no document is left out. A null source is a source of
    its own, and sources without tokens come once."""
    rows = stored(mixing.narrow(docs), "narrow")
    return mixing.mixed(docs.select(*COLUMNS), mixing.plan(rows, TARGET_ENTROPY, MAX_REPETITION, tokens=F.col("n_tokens")), rows=rows)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, null texts as empty ones; rows without an id keep a null id, and repeated
    rows give equal results."""
    return sentencepiece_bpe.encode_decode(docs, PIECES)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("pii_surrogates", replace_pii),
    ("source_mixing", mix_sources),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted models and keyed hashes are not SQL; tests/llm/ compares run() with a brute-force version.
ORACLE_SQL = None
