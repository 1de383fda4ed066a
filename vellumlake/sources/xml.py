"""XML reports of renderers: text and ink of a trace with its clips, words and blocks of text extractors."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACE = "document string, page_index int, ord int, kind string, unicode string, x double, y double, left double, bottom double, right double, top double, clips array<string>"


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", text or "")]


def trace_rows(xml: str) -> list[tuple]:
    """(page, ord, kind, unicode, x, y, l, b, r, t, clips) of what a trace paints, under the clips then in force."""
    out, page, ord_ = [], -1, 0
    stack: list[str] = []
    for event, e in ET.iterparse(_Feed(xml), ("start", "end")):
        tag = e.tag.rsplit("}", 1)[-1]
        if event == "start":
            if tag == "page":
                page += 1
                stack.clear()
            continue
        box = (_numbers(e.get("bbox")) + [None] * 4)[:4]
        if tag.startswith("clip_"):
            stack.append(e.get("bbox") or tag)
        elif tag == "pop_clip" and stack:
            stack.pop()
        elif tag in ("g", "glyph") and e.get("unicode"):
            out.append((page, ord_, "text", e.get("unicode"), *(float(e.get(k) or 0) for k in "xy"), *box, list(stack)))
            ord_ += 1
        elif tag in ("fill_path", "stroke_path", "fill_image", "fill_shade"):
            out.append((page, ord_, "image" if "image" in tag else "vector", None, None, None, *box, list(stack)))
            ord_ += 1
    return out


def block_rows(xml: str) -> list[tuple]:
    """(page, ord, text, l, t, r, b) of blocks in either extractor's form, as given (y grows downward)."""
    out, page = [], -1
    for event, e in ET.iterparse(_Feed(xml), ("start", "end")):
        tag = e.tag.rsplit("}", 1)[-1]
        if event == "start" and tag == "page":
            page += 1
        elif event == "end" and tag == "block":
            words = [w.text or "" for w in e.iter() if w.tag.rsplit("}", 1)[-1] == "word"]
            chars = ["".join(c.get("c", "") for c in line.iter() if c.tag.rsplit("}", 1)[-1] == "char") for line in e.iter() if line.tag.rsplit("}", 1)[-1] == "line"]
            box = _numbers(e.get("bbox")) or [float(e.get(k) or 0) for k in ("xMin", "yMin", "xMax", "yMax")]
            out.append((page, len(out), " ".join(words) or "\n".join(chars), *box[:4]))
            e.clear()
    return out


class _Feed:
    def __init__(self, text: str):
        self.data, self.at = text.encode(), 0

    def read(self, n: int = -1) -> bytes:
        part = self.data[self.at :] if n < 0 else self.data[self.at : self.at + n]
        self.at += len(part)
        return part


def traces(reports: DataFrame, column: str = "value") -> DataFrame:
    """reports: document and the XML of a trace."""

    def run(batches):
        for pdf in batches:
            rows = [(d, *r) for d, x in zip(pdf.document, pdf[column]) for r in trace_rows(x)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACE.split(", ")])

    return reports.select("document", column).mapInPandas(run, TRACE)


def blocks(reports: DataFrame, column: str = "value") -> DataFrame:
    schema = "document string, page int, ord int, text string, left double, top double, right double, bottom double"

    def run(batches):
        for pdf in batches:
            rows = [(d, *r) for d, x in zip(pdf.document, pdf[column]) for r in block_rows(x)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return reports.select("document", column).mapInPandas(run, schema)


def agreement(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Blocks of two extractors paired by compare key, page and ordinal, with whether their boxes agree."""
    from pyspark.sql import Window

    from vellumlake.functions.text import compare_key

    def keyed(df, p):
        w = Window.partitionBy("document", "page", "key").orderBy("ord")
        k = df.withColumn("key", compare_key(F.col("text")))
        return k.withColumn("n", F.row_number().over(w)).select("document", "page", "key", "n", *(F.col(c).alias(p + c) for c in ("left", "top", "right", "bottom")))

    both = keyed(a, "a_").join(keyed(b, "b_"), ["document", "page", "key", "n"], "full_outer")
    close = None
    for c in ("left", "top", "right", "bottom"):
        one = F.abs(F.col("a_" + c) - F.col("b_" + c)) <= tolerance
        close = one if close is None else close & one
    return both.select("document", "page", "key", "n", F.coalesce(close, F.lit(False)).alias("agrees"))
