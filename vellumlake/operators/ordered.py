"""Computations that depend on the order of rows in a group: islands, anchored lines, budgets, inversions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_ID, TOTAL = 25, 500
BYPASS = ("scan_summary", "page_degraded", "degradation_summary")
# Diagnostics that are no warnings; of dropped ones only the first eight count as such.
NOT_WARNINGS = ("unicode_recovered", "translation_identity", "translation_failure_profile", "math_passthrough", "formula_boundary_expanded", "glyph_bbox_estimated", "single_line_bounds_expanded", "multi_line_bounds_expanded", "section_number_gap_clamped", "link_borders_stripped")


def anchored_lines(df: DataFrame, keys: list[str], order: str, value: str, tolerance: float = 0.001, name: str = "line") -> DataFrame:
    """Number of the line (from 0) of each row: a new line begins where the value is more than tolerance from the
    line's first value. The anchor depends on the fold so far, so a group, one page's characters, is folded in order,
    in one pass over an Arrow batch."""
    fields = [*keys, order, value]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, value], kind="stable")
        line, anchor, out = -1, None, []
        for v in pdf[value].tolist():
            if anchor is None or abs(v - anchor) > tolerance:
                line, anchor = line + 1, v
            out.append(line)
        return pdf[[*keys, order]].assign(**{name: np.array(out, "int32")})

    schema = T.StructType([df.schema[c] for c in (*keys, order)] + [T.StructField(name, T.IntegerType())])
    return df.select(*fields).groupBy(*keys).applyInPandas(fold, schema)


def islands(df: DataFrame, keys: list[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Number of the run of equal `same` that a row is in, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~same.eqNullSafe(F.lag(same).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def detections(df: DataFrame, keys: list[str], query: str, score: str, ordinal: str, least: float = 0.5) -> DataFrame:
    """The best detection of each query (the first of equals) if it scores enough."""
    best = df.groupBy(*keys, query).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(ordinal).alias("_o"))).alias("_b"))
    hit = best.select(*keys, query, (-F.col("_b._s")).alias(score), F.col("_b._o").alias(ordinal))
    return hit.where(F.col(score) >= least)


def budgeted(df: DataFrame, keys: list[str], ident: str, ordinal: str, per_id: int = PER_ID, total: int = TOTAL, bypass: tuple = BYPASS) -> DataFrame:
    """df with `kept`: ordinary diagnostics up to per_id of an id and total over ids, in order; bypassing ids always.
    Ranks are limits of their windows, so each task drops what can't be kept before rows are dealt by id; what is
    ranked over ids are at most per_id rows an id."""
    free = F.col(ident).isin(*bypass)
    by_id = Window.partitionBy(*keys, ident).orderBy(ordinal)
    passing = df.where(~free).select(*keys, ident, ordinal).withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= per_id)
    over = Window.partitionBy(*keys).orderBy(ordinal)
    kept = passing.withColumn("_t", F.row_number().over(over)).where(F.col("_t") <= total).select(*keys, ordinal, F.lit(True).alias("_k"))
    return df.join(kept, [*keys, ordinal], "left").withColumn("kept", free | F.coalesce("_k", F.lit(False))).drop("_k")


def warning_count(budget: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Warnings shown plus warnings dropped; the two sides differ in which ids are warnings."""
    shown = F.col("kept") & ~F.col(ident).isin(*NOT_WARNINGS)
    dropped = ~F.col("kept") & ~F.col(ident).isin(*NOT_WARNINGS[:8])
    return budget.groupBy(*keys).agg(F.count_if(shown).alias("shown"), F.count_if(dropped).alias("dropped"), F.count_if(shown | dropped).alias("warnings"))


def span_overlaps(df: DataFrame, keys: list[str], start: str = "byte_start", end: str = "byte_end") -> DataFrame:
    """Replacement spans, in order, with whether one begins before the one before it ends."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("overlaps", F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False)))


def spliced(text: Column, spans: Column) -> Column:
    """text with each (start, end, new) of a sorted array of disjoint spans replaced, by characters from 0."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"].cast("int") - acc["at"]), s["new"]).alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def word_gaps(df: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Gap to the character before on the same baseline, where an implied space stands between them."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col("left") - F.lag("right").over(w)
    return df.withColumn("gap", F.when(F.col("implicit_space_before") & (F.abs(F.col("baseline") - F.lag("baseline").over(w)) <= 0.001), gap))


def continuity_limit(gap: Column, size: Column) -> Column:
    """Aggregate: the widest gap that still reads as one line; null without sizes."""
    from vellumlake.functions.numeric import median_positive

    em = median_positive(size)
    return F.when(em.isNotNull(), F.greatest(F.coalesce(2 * median_positive(gap), F.lit(0.0)), 1.5 * em))


def order_divergence(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows whose rank differs between orders a and b, and the number of pairs that stand in opposite order. Ranks
    are merged by halves: at each bit of the rank in a, pairs that part there are counted by a window over the
    common high bits, so no pairs are emitted."""
    ranked = df.withColumns({"_x": F.row_number().over(Window.partitionBy(*keys).orderBy(a)) - 1, "_y": F.row_number().over(Window.partitionBy(*keys).orderBy(b)) - 1})
    size = ranked.agg(F.max("_x")).first()[0] or 0
    bits = max(1, int(size).bit_length())
    levels = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    levels = levels.withColumns({"_g": F.expr("shiftright(_x, _k + 1)"), "_upper": F.expr("shiftright(_x, _k) & 1")})
    w = Window.partitionBy(*keys, "_k", "_g").orderBy("_y").rowsBetween(Window.unboundedPreceding, 0)
    seen = levels.withColumn("_inv", F.when(F.col("_upper") == 0, F.sum("_upper").over(w)).otherwise(0))
    out = seen.groupBy(*keys).agg(F.sum("_inv").alias("inversions"))
    moved = ranked.groupBy(*keys).agg(F.count_if(F.col("_x") != F.col("_y")).alias("moved"), F.count("*").alias("n"))
    return moved.join(out, keys)


def retry_schedule(attempts: Column, base_ms: int = 250, most: int = 3) -> Column:
    """Delays before the retries of a request that failed so often."""
    n = F.least(attempts, F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: (base_ms * F.pow(F.lit(2), k - 1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def interleaved(df: DataFrame, page: str = "page_index") -> DataFrame:
    """Each page twice: the source at 2 i, the translation at 2 i + 1."""
    return df.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("output_page", 2 * F.col(page) + F.col("side"))


def split_evidence(lines: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """Lines with `splits`: whether a paragraph begins there: indented by more than 1.2 of its size against the group's
    left edge, after a line of at most 0.8 of the group's width."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    edge, width = F.min("left").over(whole), F.max("right").over(whole) - F.min("left").over(whole)
    short = F.lag(F.col("right") - F.col("left")).over(w) <= 0.8 * width
    return lines.withColumn("splits", F.coalesce((F.col("left") - edge > 1.2 * F.col("size")) & short, F.lit(False)))


def column_order(boxes: DataFrame, keys: list[str], middle: Column, ident: str) -> DataFrame:
    """Boxes with reading_order from 0: the left column from top to bottom, then the right one."""
    side = ((F.col("left") + F.col("right")) / 2 >= middle).cast("int")
    w = Window.partitionBy(*keys).orderBy(side, F.col("top").desc(), "left", ident)
    return boxes.withColumn("reading_order", F.row_number().over(w) - 1)


def page_labels(pages: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of a bilingual output: of each page (page from 0) the rule (start, style, prefix, first) that holds there,
    the last that begins at or before it, twice, for pages 2 i and 2 i + 1; numbers count on from the rule's first
    (1 where it has none) and styles without numbers have none. A page before the first rule fails the job."""
    r = rules.select(*keys, F.col("start").alias("page"), F.lit(0).alias("_kind"), F.struct("start", "style", "prefix", "first").alias("_r"))
    p = pages.select(*keys, "page", F.lit(1), F.lit(None).cast(r.schema["_r"].dataType))
    w = Window.partitionBy(*keys).orderBy("page", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    on = r.unionAll(p).withColumn("_on", F.last("_r", ignorenulls=True).over(w)).where("_kind = 1")
    checked = F.when(F.col("_on").isNull(), F.raise_error(F.lit("no label rule for the first page")).cast("string")).otherwise(F.col("_on.prefix"))
    number = F.when(F.col("_on.style").isNotNull(), F.coalesce("_on.first", F.lit(1)) + F.col("page") - F.col("_on.start"))
    labels = on.select(*keys, F.col("page").alias("source_page"), F.col("_on.style").alias("style"), checked.alias("prefix"), number.cast("bigint").alias("number"))
    return labels.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("output_page", 2 * F.col("source_page") + F.col("side")).drop("side")
