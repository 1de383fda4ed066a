"""Rectangles, lines and matrices as column expressions; y grows upward, units are points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumlake.functions.numeric import finite, ratio1

SLACK = 0.01


@dataclass(frozen=True)
class Rect:
    left: Column
    bottom: Column
    right: Column
    top: Column

    @classmethod
    def of(cls, prefix: str) -> Rect:
        return cls(*(F.col(f"{prefix}{k}") for k in ("left", "bottom", "right", "top")))

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.top - self.bottom

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    def overlap(self, o: Rect) -> Column:
        """Area of the intersection."""
        w = F.greatest(F.lit(0.0), F.least(self.right, o.right) - F.greatest(self.left, o.left))
        h = F.greatest(F.lit(0.0), F.least(self.top, o.top) - F.greatest(self.bottom, o.bottom))
        return w * h

    def overlaps(self, o: Rect) -> Column:
        return (F.least(self.right, o.right) > F.greatest(self.left, o.left)) & (F.least(self.top, o.top) > F.greatest(self.bottom, o.bottom))

    def contains(self, o: Rect, slack: float = 0.0) -> Column:
        return (o.left >= self.left - slack) & (o.right <= self.right + slack) & (o.bottom >= self.bottom - slack) & (o.top <= self.top + slack)

    def close(self, o: Rect, by: float) -> Column:
        return (F.abs(self.left - o.left) <= by) & (F.abs(self.bottom - o.bottom) <= by) & (F.abs(self.right - o.right) <= by) & (F.abs(self.top - o.top) <= by)

    def valid(self) -> Column:
        return finite(self.left) & finite(self.bottom) & finite(self.right) & finite(self.top) & (self.right > self.left) & (self.top > self.bottom)

    def iou(self, o: Rect) -> Column:
        """Intersection over union; 1.0 for two empty rectangles."""
        common = self.overlap(o)
        return ratio1(common, self.area + o.area - common)

    def same_line(self, o: Rect) -> Column:
        """Whether the vertical extents overlap by more than the slack."""
        return (self.top > o.bottom + SLACK) & (o.top > self.bottom + SLACK)

    def follows(self, o: Rect, limit: Column | None = None) -> Column:
        """Whether o stands directly right of self on its line, within the limit (by default 1.5 of the height)."""
        gap = o.left - self.right
        limit = 1.5 * F.greatest(self.height, o.height) if limit is None else limit
        return self.same_line(o) & (gap >= -SLACK) & (gap <= limit + SLACK)


def union_bounds(prefix: str = "") -> list[Column]:
    """Aggregates: the bounds of all rectangles of a group."""
    return [F.min(f"{prefix}left").alias("left"), F.min(f"{prefix}bottom").alias("bottom"), F.max(f"{prefix}right").alias("right"), F.max(f"{prefix}top").alias("top")]


def compose(m: Column, n: Column) -> Column:
    """m then n, of matrices [a, b, c, d, e, f]."""
    return F.array(
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def applied(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def transformed(m: Column, r: Rect) -> Rect:
    """Bounds of the four mapped corners."""
    corners = [applied(m, x, y) for x in (r.left, r.right) for y in (r.bottom, r.top)]
    return Rect(F.least(*(c["x"] for c in corners)), F.least(*(c["y"] for c in corners)), F.greatest(*(c["x"] for c in corners)), F.greatest(*(c["y"] for c in corners)))


def singular(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.abs(a * d - b * c) <= 1e-12


def largest_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The greatest singular value."""
    s = a * a + b * b + c * c + d * d
    det = a * d - b * c
    return F.sqrt((s + F.sqrt(F.greatest(F.lit(0.0), s * s - 4 * det * det))) / 2)


def transform_kind(a: Column, b: Column, c: Column, d: Column) -> Column:
    """mirrored, rotated (by more than 0.1 degrees), skewed (by more than 20) or upright."""
    rotation = F.degrees(F.atan2(b, a))
    skew = F.abs(F.degrees(F.atan2(c, d)))
    return F.when(a * d - b * c < 0, "mirrored").when(F.abs(rotation) > 0.1, "rotated").when(skew > 20, "skewed").otherwise("upright")


def page_size(width: Column, height: Column, rotate: Column) -> Column:
    """Width and height as seen; a quarter turn swaps them."""
    turned = F.pmod(rotate, F.lit(180)) == 90
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def author_band(title_bottom: Column, anchor_top: Column, median_size: Column) -> Column:
    """The band between a title and the anchor below it, widened by half the median size; null where there is none."""
    tol = 0.5 * median_size
    ok = finite(title_bottom) & finite(anchor_top) & (anchor_top < title_bottom) & finite(median_size) & (median_size > 0)
    return F.when(ok, F.struct((anchor_top - tol).alias("lower"), (title_bottom + tol).alias("upper")))


def in_band(band: Column, bottom: Column, top: Column) -> Column:
    return F.coalesce(finite(bottom) & finite(top) & (bottom <= top) & (bottom >= band["lower"] - SLACK) & (top <= band["upper"] + SLACK), F.lit(False))


def segments_cross(p: tuple, q: tuple, r: tuple, s: tuple) -> Column:
    """Whether segments p-q and r-s touch; points are pairs of columns."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    d1, d2, d3, d4 = side(r, s, p), side(r, s, q), side(p, q, r), side(p, q, s)
    on = lambda a, b, c: (c[0] >= F.least(a[0], b[0])) & (c[0] <= F.greatest(a[0], b[0])) & (c[1] >= F.least(a[1], b[1])) & (c[1] <= F.greatest(a[1], b[1]))
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | ((d1 == 0) & on(r, s, p)) | ((d2 == 0) & on(r, s, q)) | ((d3 == 0) & on(p, q, r)) | ((d4 == 0) & on(p, q, s))


def inside(polygon: Column, x: Column, y: Column, even_odd: bool = True) -> Column:
    """Whether a point lies in a polygon (array of x, y), by the even-odd or the nonzero rule."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("a"), F.get(polygon, F.pmod(i + 1, n)).alias("b")))

    def turn(e):
        a, b = e["a"], e["b"]
        left = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        return F.when((a["y"] <= y) & (b["y"] > y) & (left > 0), 1).when((a["y"] > y) & (b["y"] <= y) & (left < 0), -1).otherwise(0)

    total = F.aggregate(F.transform(edges, turn), F.lit(0), lambda s, v: s + (F.abs(v) if even_odd else v))
    return (n >= 3) & ((F.pmod(total, F.lit(2)) == 1) if even_odd else (total != 0))


def view_to_page(width: Column, height: Column, rotate: Column, x: Column, y: Column) -> Column:
    """Page coordinates of a point of the rotated view; width and height are the page's own."""
    r = F.pmod(rotate, F.lit(360))
    px = F.when(r == 90, width - y).when(r == 180, width - x).when(r == 270, y).otherwise(x)
    py = F.when(r == 90, x).when(r == 180, height - y).when(r == 270, height - x).otherwise(y)
    return F.struct(px.alias("x"), py.alias("y"))


def curve_bounds(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """low, high of one coordinate of a cubic curve: its ends and what it reaches where it turns."""
    a, b, c = 3 * (-p0 + 3 * p1 - 3 * p2 + p3), 6 * (p0 - 2 * p1 + p2), 3 * (p1 - p0)
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    two = F.when(b * b - 4 * a * c >= 0, F.array((-b + root) / (2 * a), (-b - root) / (2 * a)))
    one = F.when(F.abs(b) > 1e-12, F.array(-c / b))
    turns = F.filter(F.coalesce(F.when(F.abs(a) > 1e-12, two).otherwise(one), F.array().cast("array<double>")), lambda t: (t > 0) & (t < 1))
    at = lambda t: F.pow(1 - t, 3) * p0 + 3 * F.pow(1 - t, 2) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3
    values = F.transform(F.concat(F.array(F.lit(0.0), F.lit(1.0)), turns), at)
    return F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))
