"""The engine's relations, taken from the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, reading_order, src: the lines of documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("reading_order", "src"))


def lossy(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with tgt, the answer of a backend that drops the digits of every fifth document."""
    return paragraphs.withColumn("tgt", F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("src", "[0-9]+", "")).otherwise(F.col("src")))


def tokens(text: str):
    return F.regexp_extract_all(F.col(text), F.lit(r"[0-9]+(?:[.][0-9]+)?%?"), F.lit(0))


def label() -> F.Column:
    """A layout label for a paragraph, by its shape."""
    s = F.col("src")
    return F.when(s.contains("|"), "table").when(s.contains("@"), "footer").when(s.rlike("^[0-9.()\\[\\]\\- ]+$"), "number").when(F.col("reading_order") == 0, "doc_title").otherwise("text")


LABEL_SQL = r"""CASE WHEN contains(src, '|') THEN 'table' WHEN contains(src, '@') THEN 'footer'
 WHEN regexp_matches(src, '^[0-9.()\[\]\- ]+$') THEN 'number' WHEN reading_order = 0 THEN 'doc_title' ELSE 'text' END"""

#: SQL of paragraphs().
P_SQL = """p AS (SELECT doc_id, lang, CAST(unnest(range(len(parts))) AS INTEGER) AS reading_order, unnest(parts) AS src
 FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"""
T_SQL = P_SQL + """, t AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(src, '[0-9]+', '', 'g') ELSE src END AS tgt FROM p)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, owner and a rectangle of whole numbers from each order line."""
    li = table(spark, sf_dir, "lineitem")
    left, bottom = F.col("l_partkey") % 500, F.col("l_suppkey") * 37 % 700
    return li.select(
        F.floor(F.col("l_orderkey") / 64).alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("owner"),
        left.cast("double").alias("left"),
        bottom.cast("double").alias("bottom"),
        (left + 5 + F.col("l_quantity").cast("int") % 20).cast("double").alias("right"),
        (bottom + 4 + F.col("l_linenumber") * 2).cast("double").alias("top"),
    )


B_SQL = """b AS (SELECT l_orderkey // 64 AS page, l_orderkey * 10 + l_linenumber AS owner,
 CAST(l_partkey % 500 AS DOUBLE) AS "left", CAST(l_suppkey * 37 % 700 AS DOUBLE) AS bottom,
 CAST(l_partkey % 500 + 5 + CAST(l_quantity AS INTEGER) % 20 AS DOUBLE) AS "right",
 CAST(l_suppkey * 37 % 700 + 4 + l_linenumber * 2 AS DOUBLE) AS top FROM lineitem)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as protocol events: run, ordinal and what the kind of event says."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 11
    return e.select(
        F.floor(F.col("user_id") / 10).cast("int").alias("run"),
        F.col("event_id").alias("ordinal"),
        F.when(k < 5, "diagnostic").when(k < 8, "translation_cache").when(k == 8, "translation_call").when(k == 9, "summary").otherwise("error").alias("event"),
        F.when(k == 0, "translation_retry").when(k == 1, "content_conservation_retry").when(k == 2, "page_degraded").when(k == 3, "section_number_gap_clamped").when(k == 4, "unicode_recovered").alias("id"),
        F.when(k.isin(5, 6), "hit").when(k == 7, "miss").alias("status"),
        F.when(k == 10, F.when(F.col("event_id") % 2 == 0, "internal").otherwise("io")).alias("category"),
        F.when(k == 9, F.col("event_id") % 3).alias("suspicious_echoes"),
    )


LOG_SQL = """g AS (SELECT CAST(user_id // 10 AS INTEGER) AS run, event_id AS ordinal,
 CASE WHEN event_id % 11 < 5 THEN 'diagnostic' WHEN event_id % 11 < 8 THEN 'translation_cache' WHEN event_id % 11 = 8 THEN 'translation_call'
  WHEN event_id % 11 = 9 THEN 'summary' ELSE 'error' END AS event,
 CASE event_id % 11 WHEN 0 THEN 'translation_retry' WHEN 1 THEN 'content_conservation_retry' WHEN 2 THEN 'page_degraded'
  WHEN 3 THEN 'section_number_gap_clamped' WHEN 4 THEN 'unicode_recovered' END AS id,
 CASE WHEN event_id % 11 IN (5, 6) THEN 'hit' WHEN event_id % 11 = 7 THEN 'miss' END AS status,
 CASE WHEN event_id % 11 = 10 THEN CASE WHEN event_id % 2 = 0 THEN 'internal' ELSE 'io' END END AS category,
 CASE WHEN event_id % 11 = 9 THEN event_id % 3 END AS suspicious_echoes FROM events)"""
