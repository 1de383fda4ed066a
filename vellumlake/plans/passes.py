"""Stages as a chain of DataFrame transformations, each with an optional snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vellumlake.sources.sinks import snapshot

Pass = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, passes: list[tuple[str, Pass]], snapshots: str | None = None) -> DataFrame:
    """df through the passes in order. With a folder, each stage's table is written there and read back, so a later
    stage's failure doesn't repeat the earlier ones."""
    spark = df.sparkSession
    for k, (name, step) in enumerate(passes, 1):
        df = df.transform(step)
        if snapshots:
            snapshot(df, snapshots, k, name)
            df = spark.read.parquet(f"{snapshots}/stage={k:02d}-{name}")
    return df
