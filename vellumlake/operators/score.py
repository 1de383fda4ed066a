"""The six quality dimensions, their total, and roll-ups over producers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.functions import text as X
from vellumlake.functions.geometry import Rect
from vellumlake.functions.numeric import dimension_score, median0, ratio1, round6


def denominator(text: Column) -> Column:
    """Aggregate: characters that aren't white space, at least 1."""
    return F.greatest(F.lit(1), F.sum(X.non_space_count(text)))


def coverage(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: one row a source paragraph (eligible, translated, translated_reason, typeset, typeset_reason)."""
    done = F.col("translated").isNotNull() & F.col("translated_reason").isNull() & F.col("typeset").isNotNull() & F.col("typeset_reason").isNull()
    rows = pairs.where("eligible").withColumn("_done", done)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("eligible_paragraphs"),
        F.count_if("_done").alias("translated_paragraphs"),
        F.sum(X.han_count(F.coalesce("translated", F.lit("")))).alias("translated_han"),
        F.sum(F.when(F.col("_done"), X.han_count(F.col("typeset"))).otherwise(0)).alias("published_han"),
    )
    return out.withColumns({
        "paragraph_coverage": ratio1(F.col("translated_paragraphs"), F.col("eligible_paragraphs")),
        "han_weighted_coverage": ratio1(F.col("published_han"), F.col("translated_han")),
        "weighted": (F.col("eligible_paragraphs") - F.col("translated_paragraphs")) * 5.0,
    })


def preserved_reasons(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram of the reasons why eligible paragraphs stayed: the typeset one, else the translated one."""
    reason = F.coalesce("typeset_reason", "translated_reason")
    return pairs.where("eligible").where(reason.isNotNull()).groupBy(*keys, reason.alias("reason")).agg(F.count("*").alias("n"))


def overtranslation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: source, translated, translatable, superscript. Counts of what should not have changed."""
    rows = pairs.where(F.col("translated").isNotNull() & ~X.same_without_space(F.col("translated"), F.col("source")))
    out = rows.groupBy(*keys).agg(
        F.count_if(~F.col("translatable")).alias("policy"),
        F.count_if("superscript").alias("superscript"),
        F.count_if(X.numbering_only(F.col("source"))).alias("numbering"),
        F.count_if(X.stripped(F.col("source")) == "").alias("blank"),
    )
    return out.withColumn("weighted", (F.col("policy") * 10 + F.col("superscript") * 5 + F.col("numbering") * 5 + F.col("blank") * 5).cast("double"))


def risk_weight(weak, placeholders, echoes, conserved, terms, formula, orphan, rigid) -> Column:
    return (weak * 5 + placeholders * 10 + echoes * 5 + conserved * 10 + terms * 5 + formula * 10 + orphan * 10 + rigid * 10).cast("double")


def layout_drift(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: a_ and b_ rectangles with a_size, b_size. Medians of offset, IoU and font ratio; drifted pairs."""
    a, b = Rect.of("a_"), Rect.of("b_")
    offset = F.sqrt(F.pow(a.left - b.left, 2) + F.pow(a.bottom - b.bottom, 2))
    ratio = F.when((F.col("a_size") > 0) & (F.col("b_size") > 0), F.col("b_size") / F.col("a_size"))
    rows = pairs.withColumns({"_o": offset, "_i": a.iou(b), "_f": ratio})
    return rows.groupBy(*keys).agg(round6(median0(F.col("_o"))).alias("median_offset_pt"), round6(median0(F.col("_i"))).alias("median_iou"), round6(median0(F.col("_f"))).alias("median_font_scale"), (F.count_if(F.col("_o") > 1.0) + F.count_if(F.col("_i") < 0.8)).alias("drifted"))


def lint(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    t = F.col(text)
    out = texts.where(t.isNotNull()).groupBy(*keys).agg(F.count_if(X.kinsoku(t)).alias("kinsoku"), F.count_if(X.isolated_punctuation(t)).alias("isolated"), F.sum(X.placeholder_residue(t)).alias("residue"), F.count_if(X.abnormal_space(t)).alias("whitespace"))
    return out.withColumn("weighted", (F.col("kinsoku") * 3 + F.col("isolated") + F.col("residue") * 10 + F.col("whitespace")).cast("double"))


def structural_weight(failed_checks: Column, pixel_error: Column, title_author: Column) -> Column:
    return failed_checks * 100.0 + pixel_error * 10.0 + title_author * 10.0


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", dimension_score(F.col("weighted"), F.col("denominator")))


def total(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    return dimensions.groupBy(*keys).agg(round6(F.avg("score")).alias("total"), F.count("*").alias("dimensions"))


def cluster_rollup(papers: DataFrame) -> DataFrame:
    """Over all producers (null) and by producer: papers, published, internal errors, rate, median and worst count of
    preserved paragraphs, ink violations."""
    return papers.groupingSets([[], ["producer"]], "producer").agg(
        F.count("*").alias("papers"),
        F.count_if("published").alias("published"),
        F.sum("internal_errors").alias("internal_errors"),
        round6(F.count_if("published") / F.count("*")).alias("published_rate"),
        F.median("preserved").alias("median_preserved"),
        F.max("preserved").alias("worst_preserved"),
        F.sum("ink_violations").alias("ink_violations"),
    )


def distribution(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(round6(F.min(score)).alias("min"), round6(F.percentile(score, F.lit(0.1))).alias("p10"), round6(F.median(score)).alias("median"), F.count("*").alias("n"))


def lowest(df: DataFrame, score: str, ties: list[str], n: int) -> DataFrame:
    """A top-k report: no full sort."""
    return df.orderBy(score, *ties).limit(n)


def superscript(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs of two characters or more with one that is small (0.8 of the median) and off the median baseline by
    0.15 of the median size."""
    med = chars.groupBy(*keys).agg(F.median("size").alias("_s"), F.median("baseline").alias("_b"), F.count("*").alias("_n"))
    off = (F.col("size") <= 0.8 * F.col("_s")) & (F.abs(F.col("baseline") - F.col("_b")) >= 0.15 * F.col("_s"))
    return chars.join(med, keys).groupBy(*keys).agg((F.bool_or(off) & (F.max("_n") >= 2)).alias("superscript"))


def body_size(chars: DataFrame, keys: list[str]) -> DataFrame:
    """The size of most characters; of equals the greater."""
    n = chars.groupBy(*keys, "size").agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max(F.struct("_n", "size")).alias("_m")).select(*keys, F.col("_m.size").alias("size"))


def first_line_indent(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First baseline x minus the median of the others, if positive."""
    out = lines.groupBy(*keys).agg(F.min(F.struct("line", "x")).alias("_f"), F.median(F.when(F.col("line") > 0, F.col("x"))).alias("_m"))
    d = F.col("_f.x") - F.col("_m")
    return out.select(*keys, F.when(d > 0, round6(d)).alias("indent"))


