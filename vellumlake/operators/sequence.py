"""Correspondence of two extractions of a page by sequence, and the classes of what corresponds to nothing."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKAHEAD = 16  # engine characters that a walked one may skip


def _runs(free: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, f in enumerate([*free, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def corresponding(walk: list[tuple], engine: list[tuple], anchors: list[tuple[int, int]], same=lambda a, b: a == b) -> tuple[list[int], list[int]]:
    """Places of the walked and of the engine's characters that correspond by sequence only.

    walk: (text or None, visible, free); engine: (text or None, free); anchors: matched pairs of places. Each run of
    free walked characters looks, between the engine places of its nearest anchors, for its characters in order,
    skipping at most LOOKAHEAD - 1; it counts with two finds or more that are three quarters of its visible text.
    Then free characters of equal places that read the same."""
    blank = lambda t: t is None or t.isspace()
    anchors = sorted(anchors)
    at = [w for w, _ in anchors]
    left, right = set(), set()
    for start, end in _runs([w[2] for w in walk]):
        before, after = bisect_left(at, start), bisect_left(at, end)
        low = anchors[before - 1][1] + 1 if before else 0
        high = anchors[after][1] if after < len(anchors) else len(engine)
        shown = [i for i in range(start, end) if walk[i][1] and not blank(walk[i][0])]
        open_ = [j for j in range(low, high) if engine[j][1] and not blank(engine[j][0])]
        found, cursor = [], 0
        for i in shown:
            hit = next((k for k in range(cursor, min(cursor + LOOKAHEAD, len(open_))) if same(walk[i][0], engine[open_[k]][0])), None)
            if hit is not None:
                found.append((i, open_[hit]))
                cursor = hit + 1
        if low <= high and len(found) >= 2 and 4 * len(found) >= 3 * len(shown):
            for i, j in found:
                if i not in left and j not in right:
                    left.add(i)
                    right.add(j)
    for i, (t, _, free) in enumerate(walk[: len(engine)]):
        if free and i not in left and engine[i][1] and i not in right and same(t, engine[i][0]):
            left.add(i)
            right.add(i)
    return sorted(left), sorted(right)


def sequence_only(chars: DataFrame, key: str) -> DataFrame:
    """key, side, pos of the characters that correspond by sequence only. chars: key, side (walk or engine), pos (from
    0 on each side), text, visible, free, mate (the engine's place of a matched walked character, or null). The rule
    goes from run to run, so a page is one group, handled in an Arrow batch."""
    kind = chars.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "pos"])
        text = pdf["text"].where(pdf["text"].notna(), None)
        w, e = (pdf["side"] == s for s in ("walk", "engine"))
        walk = list(zip(text[w], pdf["visible"][w], pdf["free"][w]))
        engine = list(zip(text[e], pdf["free"][e]))
        pairs = [(int(a), int(b)) for a, b in zip(pdf["pos"][w], pdf["mate"][w]) if not pd.isna(b)]
        left, right = corresponding(walk, engine, pairs)
        rows = [(pdf[key].iloc[0], "walk", i) for i in left] + [(pdf[key].iloc[0], "engine", j) for j in right]
        return pd.DataFrame(rows, columns=[key, "side", "pos"])

    return chars.select(key, "side", "pos", "text", "visible", "free", "mate").groupBy(key).applyInPandas(run, f"{key} {kind}, side string, pos bigint")


# Provenances whose text is strong evidence.
STRONG = ("to_unicode", "embedded_font_cmap")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(False))


def pair_class(walk: str = "walk_text", engine: str = "engine_text", visible: str = "visible", provenance: str = "provenance") -> Column:
    """Of a matched pair: null if it reads the same; A: blank or invisible; else C with what kind of difference."""
    same = F.col(walk).eqNullSafe(F.col(engine))
    kind = F.when(F.col(provenance).isin(*STRONG), "C_strong").when(F.col(provenance) == "simple_encoding", "C_weak").otherwise("C_unresolved")
    hyphen = F.col(walk).isin("-", "­", "‐", "‑") & (F.col(engine) == "\u0002")
    return F.when(same, F.lit(None)).when(_blank(walk) | _blank(engine) | ~F.col(visible), "A").when(F.coalesce(hyphen, F.lit(False)), "C_hyphen").otherwise(kind)


def walk_class(text: str = "text", visible: str = "visible", placed: str = "placed", candidates: str = "candidates") -> Column:
    """Of a walked character without a partner: A: blank or invisible; F: unplaced, unread or with several candidates;
    D: the engine lacks it."""
    return F.when(_blank(text) | ~F.col(visible), "A").when(~F.col(placed) | F.col(text).isNull() | (F.col(candidates) > 0), "F").otherwise("D")


def intersects_page(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> Column:
    return (right > 0) & (left < width) & (top > 0) & (bottom < height)


def engine_class(on_page: Column, text: str = "text", placed: str = "placed", candidates: str = "candidates") -> Column:
    """Of an engine's character without a partner: A: off the page or blank; F as in walk_class; E: the walk lacks it."""
    return F.when(~on_page | _blank(text), "A").when(~F.col(placed) | F.col(text).isNull() | (F.col(candidates) > 0), "F").otherwise("E")


def class_counts(classed: DataFrame, keys: list[str], cls: str = "class") -> DataFrame:
    """Per key (a tolerance and a page, or a tolerance): how many of each class, absent ones as 0."""
    c = F.col(cls)
    kinds = ("A", "C_hyphen", "C_strong", "C_weak", "C_unresolved", "D", "E", "F")
    return classed.groupBy(*keys).agg(F.count_if(c.isNull()).alias("same"), *(F.count_if(c == k).alias(k.lower()) for k in kinds))
