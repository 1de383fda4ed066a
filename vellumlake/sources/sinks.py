"""Sinks: stage snapshots, event lines, reports and key-value inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_lines(df: DataFrame) -> DataFrame:
    """One JSON line a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def pretty(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.to_json(F.struct("*"), {"pretty": "true"}), F.lit("\n")).alias("value"))


def snapshot(df: DataFrame, root: str, number: int, stage: str) -> None:
    """A stage's table under root/stage=NN-name."""
    df.write.mode("overwrite").parquet(f"{root}/stage={number:02d}-{stage}")


def inserted(store: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """store with new rows for keys it lacks; of several new ones the last by ordinal."""
    fields = [c for c in new.columns if c not in (key, ordinal)]
    last = new.groupBy(key).agg(F.max(F.struct(ordinal, *fields)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in fields))
    return store.unionByName(last.join(store.select(key), key, "left_anti"))


def report_markdown(dimensions: DataFrame) -> DataFrame:
    """A report's table as Markdown, one row a document; dimensions: document, dimension, score."""
    row = F.format_string("| %s | %.6f |", "dimension", "score")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", row.alias("r")))), lambda x: x["r"]), "\n")
    return dimensions.groupBy("document").agg(F.concat(F.lit("| dimension | score |\n| --- | --- |\n"), body, F.lit("\n")).alias("markdown"))


def adjudicated(values: DataFrame) -> DataFrame:
    """Numbers in the fixed form of adjudications: six places."""
    return values.select(*(F.format_string("%.6f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in values.dtypes))
