"""The event protocol as a stream: bounded diagnostics and the check of terminal events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumlake.operators.ordered import BYPASS, PER_ID, TOTAL

PART = 10_000  # rows of a frame that the ranking gives out


def per_id(stream: DataFrame, most: int = PER_ID) -> DataFrame:
    """stream: run, id, ordinal. Each row with its rank in its id so far; state is one number for each run and id."""

    def rank(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        # only ordinals are held, eight bytes a row, and given out in parts
        ordinals = np.sort(np.concatenate([b["ordinal"].to_numpy("int64") for b in batches]))
        state.update((n + len(ordinals),))
        for i in range(0, len(ordinals), PART):
            part = ordinals[i : i + PART]
            ranks = np.arange(n + i + 1, n + i + 1 + len(part))
            yield pd.DataFrame({"run": key[0], "id": key[1], "ordinal": part, "rank": ranks, "within": (ranks <= most) | (key[1] in BYPASS)})

    return stream.groupBy("run", "id").applyInPandasWithState(rank, "run string, id string, ordinal bigint, rank bigint, within boolean", "n bigint", "append", GroupStateTimeout.NoTimeout)


def with_total(batch: DataFrame, used: DataFrame | None, total: int = TOTAL) -> DataFrame:
    """The cap over ids, for foreachBatch: `used` has run and how many ordinary rows earlier batches kept. The rows
    that pass the cap of their id are few, at most per_id a run and id."""
    from pyspark.sql import Window

    free = F.col("id").isin(*BYPASS)
    rows = batch.join(used, "run", "left") if used is not None else batch.withColumn("used", F.lit(0))
    w = Window.partitionBy("run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum((F.col("within") & ~free).cast("int")).over(w)
    return rows.withColumn("kept", free | (F.col("within") & (seen + F.coalesce("used", F.lit(0)) <= total))).drop("used")


def terminals(stream: DataFrame) -> DataFrame:
    """Running count of terminal events and the last ordinal of each run (update mode)."""
    t = F.col("event").isin("result", "error")
    return stream.groupBy("run").agg(F.count_if(t).alias("terminals"), F.max(F.when(t, F.col("ordinal"))).alias("terminal_at"), F.max("ordinal").alias("last"))
