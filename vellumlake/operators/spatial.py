"""Band joins, collisions and matchings on the plane. Candidates meet through grid cells, never through a cross
join; what is left of order dependence runs per page in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions.geometry import SLACK, Rect


def band_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Pairs with |lx - rx| <= tolerance and |ly - ry| <= tolerance; columns lx, ly and rx, ry. Each right row goes to
    the nine cells around it, each left row to its own."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("_d")
    r = right.select("*", near).select("*", (cell("rx") + F.col("_d.a")).alias("_cx"), (cell("ry") + F.col("_d.b")).alias("_cy")).drop("_d")
    l = left.select("*", cell("lx").alias("_cx"), cell("ly").alias("_cy"))
    close = (F.abs(F.col("lx") - F.col("rx")) <= tolerance) & (F.abs(F.col("ly") - F.col("ry")) <= tolerance)
    return l.join(r, [*keys, "_cx", "_cy"]).where(close).drop("_cx", "_cy")


def _cells(df: DataFrame, size: float, left: str, right: str, bottom: str, top: str) -> DataFrame:
    """df once for each grid cell that its rectangle touches."""
    xs = F.sequence(F.floor(F.col(left) / size), F.floor(F.col(right) / size))
    ys = F.sequence(F.floor(F.col(bottom) / size), F.floor(F.col(top) / size))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def rect_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float, predicate) -> DataFrame:
    """Pairs of rectangles (a_left... and b_left...) that overlap and meet the predicate. A pair is found once: in
    the cell of the lower left corner of its intersection."""
    x = _cells(a, cell, "a_left", "a_right", "a_bottom", "a_top")
    y = _cells(b, cell, "b_left", "b_right", "b_bottom", "b_top")
    ra, rb = Rect.of("a_"), Rect.of("b_")
    home = (F.floor(F.greatest("a_left", "b_left") / cell) == F.col("_cx")) & (F.floor(F.greatest("a_bottom", "b_bottom") / cell) == F.col("_cy"))
    return x.join(y, [*keys, "_cx", "_cy"]).where(home & ra.overlaps(rb) & predicate(ra, rb)).drop("_cx", "_cy")


def renamed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


def collisions(boxes: DataFrame, keys: list[str], owner: str, cell: float = 16.0) -> DataFrame:
    """Pairs of owners (a < b) on a page any two of whose boxes overlap, once each. cell: about the size of a box."""
    a, b = renamed(boxes, "a_", keys), renamed(boxes, "b_", keys)
    pairs = rect_pairs(a, b, keys, cell, lambda x, y: F.col(f"a_{owner}") < F.col(f"b_{owner}"))
    return pairs.select(*keys, F.col(f"a_{owner}").alias("left_owner"), F.col(f"b_{owner}").alias("right_owner")).distinct()


def line_neighbours(fragments: DataFrame, keys: list[str], ident: str, cell: float = 16.0) -> DataFrame:
    """a stands directly left of b on one line: gap within [-0.01, 1.5 max height + 0.01]. The gap that counts is that of
    the higher one, so this one goes to every cell that its gap reaches and the other to the cell of its edge; they meet
    in the lowest cell of the height that they share, so a pair is found once. cell: about the height of a line."""
    rows = fragments.withColumns({"_h": F.col("top") - F.col("bottom"), "_cy": F.explode(F.sequence(F.floor(F.col("bottom") / cell), F.floor(F.col("top") / cell)))})
    one = lambda x: F.array(F.floor(x / cell))
    reach = 1.5 * F.greatest(F.col("_h"), F.lit(0.0)) + 2 * SLACK
    many = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    right, left = F.col("right"), F.col("left")
    a, b, found = Rect.of("a_"), Rect.of("b_"), []
    for cells_a, cells_b, higher in ((one(right), many(left - reach, left + 2 * SLACK), F.col("b__h") >= F.col("a__h")), (many(right - 2 * SLACK, right + reach), one(left), F.col("a__h") > F.col("b__h"))):
        x = renamed(rows.withColumn("_cx", F.explode(cells_a)), "a_", [*keys, "_cx", "_cy"])
        y = renamed(rows.withColumn("_cx", F.explode(cells_b)), "b_", [*keys, "_cx", "_cy"])
        home = F.floor(F.greatest("a_bottom", "b_bottom") / cell) == F.col("_cy")
        pairs = x.join(y, [*keys, "_cx", "_cy"]).where(home & higher & (F.col(f"a_{ident}") != F.col(f"b_{ident}")) & a.follows(b))
        found.append(pairs.select(*keys, F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b")))
    # fragments may share an ident; pairs are few against fragments
    return found[0].unionAll(found[1]).distinct()


def nearest_lower(titles: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """For each title the anchor whose top is highest among those below its bottom; of equals the last by ordinal. Both
    are sorted by height once, and each title takes the anchor before it, so no pairs are made."""
    none = F.lit(None)
    t = titles.select(*keys, F.col("bottom").alias("_at"), F.lit(0).alias("_kind"), F.col("title"), none.cast("double").alias("anchor_top"), none.cast("bigint").alias("anchor_ord"))
    a = anchors.select(*keys, F.col("top"), F.lit(1), none.cast(titles.schema["title"].dataType), F.col("top"), F.col("ord").cast("bigint"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", "anchor_ord").rowsBetween(Window.unboundedPreceding, 0)
    m = F.last(F.when(F.col("_kind") == 1, F.struct("anchor_top", "anchor_ord")), ignorenulls=True).over(w)
    below = t.unionAll(a).withColumn("_m", m).where("_kind = 0 and _m is not null")
    return below.groupBy(*keys, "title").agg(F.max("_m").alias("_m")).select(*keys, "title", "_m.anchor_top", "_m.anchor_ord")


def nearest_same(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """For each left row the nearest right row of the same keys within tolerance; ties by the right ordinal."""
    pairs = band_join(left, right, keys, tolerance).withColumn("dist", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")))
    w = Window.partitionBy(*keys, "lid").orderBy("dist", "rid")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def greedy_matching(candidates: DataFrame, key: str, order: list[str], left: str = "lid", right: str = "rid") -> DataFrame:
    """One-to-one matching: candidates of a key in the given order, each taken if both sides are free. Order
    dependent, so a page's candidates are matched in one pass; a key is one page."""
    schema = f"{key} {candidates.schema[key].dataType.simpleString()}, {left} bigint, {right} bigint"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        used_l, used_r, out = set(), set(), []
        for k, a, b in zip(pdf[key], pdf[left], pdf[right]):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                out.append((k, a, b))
        return pd.DataFrame(out, columns=[key, left, right])

    return candidates.groupBy(key).applyInPandas(match, schema)


def rigid_deltas(source: DataFrame, target: DataFrame, unit: str, digits: int = 3, keys: list[str] = ()) -> DataFrame:
    """Units all of whose glyphs are found in the target (of the same keys, a page) at one common offset: keys, unit, dx,
    dy, the shortest such offset. The offsets are those of the unit's rarest character; the other glyphs look for
    themselves at these, so common characters don't meet each other."""
    at, scale = [*keys, unit], 10.0**digits
    counts = target.groupBy(*keys, "char").agg(F.count("*").alias("_n"))
    rare = source.join(counts, [*keys, "char"]).groupBy(*at).agg(F.min(F.struct("_n", "glyph", "char", "x", "y")).alias("_g")).select(*at, "_g.char", "_g.x", "_g.y")
    offset = lambda t, s: F.round(t - s, digits)
    tries = rare.join(target, [*keys, "char"]).select(*at, offset(F.col("tx"), F.col("x")).alias("dx"), offset(F.col("ty"), F.col("y")).alias("dy")).distinct()
    cell = lambda c: F.floor(c * scale)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("_d")
    wanted = tries.join(source, at).select("*", around).select("*", (cell(F.col("x") + F.col("dx")) + F.col("_d.a")).alias("_cx"), (cell(F.col("y") + F.col("dy")) + F.col("_d.b")).alias("_cy"))
    there = target.select(*keys, "char", "tx", "ty", cell(F.col("tx")).alias("_cx"), cell(F.col("ty")).alias("_cy"))
    hits = wanted.join(there, [*keys, "char", "_cx", "_cy"]).where((offset(F.col("tx"), F.col("x")) == F.col("dx")) & (offset(F.col("ty"), F.col("y")) == F.col("dy")))
    hits = hits.groupBy(*at, "dx", "dy").agg(F.count_distinct("glyph").alias("_c"))
    n = source.groupBy(*at).agg(F.count_distinct("glyph").alias("_n"))
    full = hits.join(n, at).where("_c = _n")
    return full.groupBy(*at).agg(F.min(F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d"), "dx", "dy")).alias("_m")).select(*at, F.col("_m.dx").alias("dx"), F.col("_m.dy").alias("dy"))


def arbitrated(chars: DataFrame, regions: DataFrame, keys: list[str], cell: float = 64.0) -> DataFrame:
    """The region of each character: of those that its box overlaps, the smallest, then the first in order."""
    pairs = rect_pairs(renamed(chars, "a_", keys), renamed(regions, "b_", keys), keys, cell, lambda a, b: F.lit(True))
    area = Rect.of("b_").area
    best = pairs.groupBy(*keys, "a_char").agg(F.min(F.struct(area.alias("area"), F.col("b_ord").alias("ord"), F.col("b_label").alias("label"))).alias("_m"))
    return best.select(*keys, F.col("a_char").alias("char"), F.col("_m.ord").alias("region"), F.col("_m.label").alias("label"))
