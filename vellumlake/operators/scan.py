"""Page classes and the verdict on scanned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_class(complete: Column, visible: Column, invisible: Column, image: Column) -> Column:
    """content, blank or scanned; a page not read completely counts as content."""
    return (
        F.when(~complete, "content")
        .when((visible == 0) & (invisible == 0) & ~image, "blank")
        .when((visible == 0) & image, "scanned")
        .otherwise("content")
    )


def page_evidence(shows: DataFrame, keys: list[str]) -> DataFrame:
    """Per page, from its text shows: visible ones (render mode not 3 or 7, not clipped), invisible ones, an image,
    and whether reading was complete."""
    seen = ~F.col("render_mode").isin(3, 7) & ~F.col("clipped")
    text = F.col("kind") == "text"
    return shows.groupBy(*keys).agg(F.count_if(text & seen).alias("visible"), F.count_if(text & ~seen).alias("invisible"), F.bool_or(F.col("kind") == "image").alias("image"), F.bool_and("balanced").alias("complete"))


def scan_summary(classed: DataFrame, keys: list[str], page: str = "page_index") -> DataFrame:
    """Counts by class, the scanned pages, and the verdict: rejected if at least four of five pages with content are
    scanned; a document of blank pages only is accepted."""
    c = F.col("page_class")
    out = classed.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(c == "blank").alias("blank"),
        F.count_if(c == "scanned").alias("scanned"),
        F.count_if(c == "content").alias("content"),
        F.array_sort(F.collect_list(F.when(c == "scanned", F.col(page)))).alias("scanned_pages"),
    )
    rest = F.col("total") - F.col("blank")
    return out.withColumn("rejected", (rest > 0) & (5 * F.col("scanned") >= 4 * rest))


def eligible_pages(classed: DataFrame, degraded: Column) -> DataFrame:
    return classed.where((F.col("page_class") == "content") & ~degraded)


def ownership(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Per paragraph key: form_only (every translated character belongs to a form), mixed or page."""
    inside = F.count_if("in_form")
    return paragraphs.groupBy(*keys).agg(F.when(inside == F.count("*"), "form_only").when(inside > 0, "mixed").otherwise("page").alias("ownership"))
