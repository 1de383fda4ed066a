"""Measures of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions.numeric import optional_rate

TERMINAL = ("result", "error")


def process_metrics(events: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of each run. Rates are null where their denominator is 0, but the echo rate is 0.0."""
    e = F.col("event")
    counts = events.groupBy(*keys).agg(
        F.bool_or(e == "result").alias("terminal_result"),
        F.count_if((e == "error") & (F.col("category") == "internal")).alias("internal_errors"),
        F.count_if((e == "diagnostic") & F.col("id").contains("retry")).alias("retry_diagnostics"),
        F.count_if((e == "translation_cache") & (F.col("status") == "hit")).alias("cache_hits"),
        F.count_if((e == "translation_cache") & (F.col("status") == "miss")).alias("cache_misses"),
        F.count_if(e == "translation_call").alias("translation_calls"),
        F.coalesce(F.sum(F.when(e == "summary", F.col("suspicious_echoes"))), F.lit(0)).alias("suspicious_echoes"),
    )
    out = counts.join(eligible, keys, "left").withColumn("eligible_paragraphs", F.coalesce("eligible_paragraphs", F.lit(0)))
    return out.withColumns({
        "calls_per_paragraph": optional_rate(F.col("translation_calls"), F.col("eligible_paragraphs")),
        "retry_rate": optional_rate(F.col("retry_diagnostics"), F.col("translation_calls")),
        "echo_rate": F.coalesce(optional_rate(F.col("suspicious_echoes"), F.col("eligible_paragraphs")), F.lit(0.0)),
        "cache_hit_rate": optional_rate(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")),
    })


def stage_pairs(events: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Each stage_started with the next stage_finished of its stage; null where none follows."""
    w = Window.partitionBy(*keys, "stage").orderBy(ordinal)
    nxt = F.when(F.lead("event").over(w) == "stage_finished", F.lead(ordinal).over(w))
    return events.withColumn("finished", nxt).where("event = 'stage_started'").select(*keys, "stage", F.col(ordinal).alias("started"), "finished")


def terminal_check(events: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Whether a run has exactly one terminal event and it comes last."""
    t = F.col("event").isin(*TERMINAL)
    return events.groupBy(*keys).agg(F.count_if(t).alias("terminals"), (F.max(F.when(t, F.col(ordinal))) == F.max(ordinal)).alias("last")).withColumn("valid", (F.col("terminals") == 1) & F.col("last"))


def degradation_summary(preserved: DataFrame, keys: list[str]) -> DataFrame:
    """Pages and paragraphs kept as they were, counts by reason, and at most 16 sample paragraphs with the true total."""
    para = F.struct("page_index", "reading_order")
    reasons = preserved.groupBy(*keys, "reason").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))).alias("reasons"))
    out = preserved.groupBy(*keys).agg(F.array_sort(F.collect_set("page_index")).alias("pages"), F.count("*").alias("paragraphs"), F.slice(F.array_sort(F.collect_list(para)), 1, 16).alias("samples"))
    return out.join(reasons, keys)


def strict_gate(df: DataFrame, degraded) -> DataFrame:
    """df, failing the job at the first row that is degraded."""
    return df.where(F.when(degraded, F.raise_error(F.lit("strict mode: degraded content")).isNull()).otherwise(True))


def debug_view(budget: DataFrame, debug: DataFrame, keys: list[str]) -> DataFrame:
    """What goes to the side file of a run: keys, kind, id, ordinal, n: diagnostics that were kept, events for debugging
    only, and how many of each id were dropped."""
    row = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), "id", "ordinal", F.lit(1).cast("bigint").alias("n"))
    dropped = budget.where("not kept").groupBy(*keys, "id").agg(F.count("*").alias("n")).select(*keys, F.lit("dropped").alias("kind"), "id", F.lit(None).cast("bigint").alias("ordinal"), "n")
    return row(budget.where("kept"), "kept").unionAll(row(debug, "debug")).unionAll(dropped)


def stage_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per stage of a run: how often it started and finished, the pages it reported and the greatest total it named,
    and whether it finished with all of these pages. Partial counts go before the shuffle."""
    e = F.col("event")
    pages = F.count_distinct(F.when(e == "page_progress", F.col("page_index")))
    out = events.where(e.isin("stage_started", "stage_finished", "page_progress")).groupBy(*keys, "stage").agg(
        F.count_if(e == "stage_started").alias("started"), F.count_if(e == "stage_finished").alias("finished"), pages.alias("pages"), F.max(F.when(e == "page_progress", F.col("total_pages"))).alias("total_pages")
    )
    return out.withColumn("complete", (F.col("finished") > 0) & (F.col("pages") == F.coalesce("total_pages", F.lit(0))))


def summary_array_length(lines: DataFrame, keys: list[str], ordinal: str, name: str) -> DataFrame:
    """keys, n: the length of the array that the first event with one under `name` holds; 0 where no event has one.
    lines: keys, ordinal and value, the event as JSON."""
    array = F.get_json_object("value", f"$['{name}']")
    size = F.when(array.startswith("["), F.json_array_length(array)).cast("bigint")
    return lines.groupBy(*keys).agg(F.coalesce(F.min(F.when(size.isNotNull(), F.struct(F.col(ordinal), size.alias("n"))))["n"], F.lit(0).cast("bigint")).alias("n"))
