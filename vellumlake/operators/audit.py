"""Audits: published ink against expectation, alignment of two extractions, formulas on lines, corpus checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions import text as X
from vellumlake.functions.geometry import Rect
from vellumlake.operators import spatial
from vellumlake.sources.scratch import cut

# --- ink -----------------------------------------------------------------------


def glyph_matches(expected: DataFrame, observed: DataFrame, key: str, tolerance: float = 0.25) -> DataFrame:
    """key, lid, rid: each expected glyph (lx, ly, char, lid in order) takes the first observed one in trace order (rx,
    ry, char, rid) of its character within the distance that no earlier one took."""
    pairs = spatial.band_join(expected, observed, [key, "char"], tolerance)
    near = pairs.where(F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")) <= tolerance)
    return spatial.greedy_matching(near.select(key, "lid", "rid"), key, ["lid", "rid"])


def retained_conflicts(glyphs: DataFrame, ink: DataFrame, keys: list[str], cell: float = 64.0) -> DataFrame:
    """For each retained ink the first glyph (by ord) of another owner that it overlaps; ink that covers the glyph's
    whole container doesn't count."""
    a, b = spatial.renamed(glyphs, "a_", keys), spatial.renamed(ink, "b_", keys)
    container = Rect.of("a_c")
    foreign = lambda x, y: ~F.col("a_owner").eqNullSafe(F.col("b_owner")) & ~y.contains(container)
    hits = spatial.rect_pairs(a, b, keys, cell, foreign)
    return hits.groupBy(*keys, F.col("b_id").alias("ink")).agg(F.min("a_ord").alias("first_glyph"))


def orphan_ink(before: DataFrame, after: DataFrame, moved: DataFrame, keys: list[str], by: float = 0.05) -> DataFrame:
    """Ink (kind, id and a rectangle) that stands in both places although glyphs of its unit moved away."""
    a, b = spatial.renamed(before, "a_", keys), spatial.renamed(after, "b_", keys)
    cell = 16.0
    xs = lambda p: F.floor(F.col(p + "left") / cell)
    y = b.withColumn("_x", F.explode(F.array(*(xs("b_") + d for d in (-1, 0, 1)))))
    same = a.withColumn("_x", xs("a_")).join(y, [*keys, "_x"]).where((F.col("a_kind") == F.col("b_kind")) & Rect.of("a_").close(Rect.of("b_"), by))
    kept = same.select(*keys, F.col("a_id").alias("id"), F.col("a_unit").alias("unit")).distinct()
    return kept.join(moved.select(*keys, "unit").distinct(), [*keys, "unit"], "left_semi")


def formula_groups(replays: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each group of a publication has exactly one source replay, not empty."""
    return replays.groupBy(*keys).agg(F.count("*").alias("replays"), F.count_if(F.col("glyphs") > 0).alias("filled")).withColumn("valid", (F.col("replays") == 1) & (F.col("filled") == 1))


def violations(df: DataFrame, order: list[str]) -> DataFrame:
    """Violations in report order; absent components first."""
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in order))


def violations_by_kind(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def required_publications(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs that have to be published: not preserved, and with a translation that differs from the source."""
    changed = F.col("preserved").isNull() & F.col("translated").isNotNull() & (F.col("translated") != F.col("source"))
    return paragraphs.where(changed).select(*keys).distinct()


TOLERANCES = {"vector": 0.5, "image": 0.25}


def component_ink(components: DataFrame, ink: DataFrame, key: str, cell: float = 16.0) -> DataFrame:
    """key, lid, rid: each component (lid in order, kind, a box) takes the first ink (rid in trace order) of its kind
    that lies within the kind's tolerance and that no earlier one took."""
    a, b = spatial.renamed(components, "a_", [key, "kind"]), spatial.renamed(ink, "b_", [key, "kind"])
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))).alias("_d")
    far = b.select("*", around).select("*", (at("b_left") + F.col("_d.x")).alias("_x"), (at("b_bottom") + F.col("_d.y")).alias("_y")).drop("_d")
    near = a.withColumns({"_x": at("a_left"), "_y": at("a_bottom")}).join(far, [key, "kind", "_x", "_y"])
    by = F.when(F.col("kind") == "image", TOLERANCES["image"]).otherwise(TOLERANCES["vector"])
    hits = near.where(Rect.of("a_").close(Rect.of("b_"), by)).select(key, F.col("a_lid").alias("lid"), F.col("b_rid").alias("rid"))
    return spatial.greedy_matching(hits, key, ["lid", "rid"])


def obstacles(pairs: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """The obstacles (b_ident) that overlap a box most, with their rank; of equal ones the first."""
    w = Window.partitionBy(*keys).orderBy(F.col("overlap").desc(), "b_ident")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def detail(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key, with the true number of its rows as `total`."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)}).where(F.col("_r") <= most).drop("_r")


def differences(a: Column, b: Column, by: float) -> Column:
    """[index, left, right] of the numbers in which two lists differ by more than `by`; a missing one differs."""
    n = F.greatest(F.size(a), F.size(b))
    at = lambda x, i: F.try_element_at(x, (i + 1).cast("int"))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), at(a, i).alias("left"), at(b, i).alias("right")))
    return F.when(n > 0, F.filter(each, lambda x: F.coalesce(F.abs(x["left"] - x["right"]) > by, F.lit(True)))).otherwise(F.array().cast("array<struct<index:int,left:double,right:double>>"))


# --- alignment -------------------------------------------------------------------


def alignment_counts(walked: DataFrame, engine: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: matched, of which the same code; walked and engine characters left over."""
    m = matches.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if("same").alias("same_code"))
    w, e = walked.groupBy(*keys).agg(F.count("*").alias("walked")), engine.groupBy(*keys).agg(F.count("*").alias("engine"))
    out = w.join(e, keys, "full_outer").join(m, keys, "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select(*keys, *(z(c) for c in ("walked", "engine", "matched", "same_code")))
    return out.withColumns({"walk_only": F.col("walked") - F.col("matched"), "engine_only": F.col("engine") - F.col("matched")})


def supported_pairs(candidates: DataFrame, anchors: DataFrame, reach: int = 1) -> DataFrame:
    """Pairs (l, r) unique on both sides whose neighbour in sequence is an accepted pair; accepted ones become anchors
    until nothing is added. Returns the accepted pairs without the given anchors."""
    accepted, n = anchors.select("l", "r").distinct(), -1
    rest = candidates.select("l", "r").distinct()
    while True:
        free = rest.join(accepted.select("l"), "l", "left_anti").join(accepted.select("r"), "r", "left_anti")
        one = free.withColumns({"_a": F.count("*").over(Window.partitionBy("l")), "_b": F.count("*").over(Window.partitionBy("r"))}).where("_a = 1 and _b = 1")
        steps = [d for d in range(-reach, reach + 1) if d]
        near = accepted.select(F.explode(F.array(*(F.struct((F.col("l") + d).alias("l"), (F.col("r") + d).alias("r")) for d in steps))).alias("x")).select("x.l", "x.r").distinct()
        new = one.join(near, ["l", "r"], "left_semi").select("l", "r")
        accepted = cut(accepted.unionByName(new).distinct(), "accepted")
        now = accepted.count()
        if now == n:
            break
        n = now
    return accepted.join(anchors.select("l", "r"), ["l", "r"], "left_anti")


def unmatched_runs(walked: DataFrame, keys: list[str], order: str, least: int = 1) -> DataFrame:
    """Maximal runs of unmatched characters: first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = walked.withColumn("_g", F.sum(F.col("matched").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not matched")
    return rows.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")


# --- formulas on lines -------------------------------------------------------------


def line_concatenations(lines: DataFrame, keys: list[str], order: str, text: str, most: int = 3) -> DataFrame:
    """Each run of up to `most` consecutive lines as compact text: start, lines, key."""
    w = Window.partitionBy(*keys).orderBy(order)
    parts = [X.compact(F.col(text))] + [F.lead(X.compact(F.col(text)), k).over(w) for k in range(1, most)]
    rows = lines.withColumn("_p", F.array(*parts))
    runs = rows.select(*keys, F.col(order).alias("start"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lines"), "_p")
    full = F.forall(F.slice("_p", F.lit(1), F.col("lines")), lambda x: x.isNotNull())
    return runs.where(full).select(*keys, "start", "lines", F.array_join(F.slice("_p", F.lit(1), F.col("lines")), "").alias("key"))


def found_on_lines(formulas: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each formula (unit, key) at the first run of lines that spells it, the shortest run first."""
    hits = formulas.join(lines, [*keys, "key"])
    return hits.groupBy(*keys, "unit").agg(F.min(F.struct("start", "lines")).alias("_m")).select(*keys, "unit", F.col("_m.start").alias("start"), F.col("_m.lines").alias("lines"))


def neighbour_gaps(units: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Per unit the least gap to the left and to the right among the fragments of its keys (a page, or a line of it);
    fragments that overlap it horizontally are passed over. Both are sorted by their edges, and each unit takes the
    fragment before it, so no pairs are made. Units without any fragment have no row."""
    def nearest(unit_edge: str, fragment_edge: str, down: bool) -> DataFrame:
        u = units.select(*keys, F.col(unit_edge).alias("_at"), F.lit(1).alias("_kind"), "unit")
        f = fragments.select(*keys, F.col(fragment_edge), F.lit(0), F.lit(None).cast(units.schema["unit"].dataType))
        w = Window.partitionBy(*keys).orderBy(F.col("_at").desc() if down else F.col("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        seen = u.unionAll(f).withColumns({"_e": F.last(F.when(F.col("_kind") == 0, F.col("_at")), ignorenulls=True).over(w), "_any": F.min("_kind").over(whole)})
        return seen.where("_kind = 1 and _any = 0").select(*keys, "unit", F.abs(F.col("_at") - F.col("_e")).alias("_gap"))

    none = F.lit(None).cast("double")
    sides = nearest("left", "right", False).select(*keys, "unit", F.col("_gap").alias("gap_left"), none.alias("gap_right")).unionAll(nearest("right", "left", True).select(*keys, "unit", none, "_gap"))
    return sides.groupBy(*keys, "unit").agg(F.min("gap_left").alias("gap_left"), F.min("gap_right").alias("gap_right"))


def holes(gaps: DataFrame, limit: Column, height: Column) -> DataFrame:
    """Count of gaps beyond the limit and their area."""
    each = F.explode(F.array("gap_left", "gap_right")).alias("gap")
    rows = gaps.withColumns({"_limit": limit, "_height": height}).select("_limit", "_height", each).where(F.col("gap") > F.col("_limit"))
    return rows.agg(F.count("*").alias("holes"), F.coalesce(F.round(F.sum(F.col("gap") * F.col("_height")), 6), F.lit(0.0)).alias("area"))


def kinsoku_lines(fragments: DataFrame, keys: list[str], ident: str = "owner", text: str = "text") -> DataFrame:
    """Fragments that begin with a mark that may not begin a line and have no left neighbour, or end with one that may
    not end a line and have no right neighbour."""
    near = spatial.line_neighbours(fragments, keys, ident)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    starts = fragments.where(first.isin(*X.LINE_START)).join(near.select(*keys, F.col("b").alias(ident)), [*keys, ident], "left_anti")
    ends = fragments.where(last.isin(*X.LINE_END)).join(near.select(*keys, F.col("a").alias(ident)), [*keys, ident], "left_anti")
    return starts.select(*keys, ident).union(ends.select(*keys, ident)).distinct()


# --- corpus ------------------------------------------------------------------------


def same_histogram(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two multisets (key, token, n) agree, per key."""
    j = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), [*keys, "token"], "full_outer")
    return j.groupBy(*keys).agg(F.bool_and(F.coalesce("_a", F.lit(0)) == F.coalesce("_b", F.lit(0))).alias("equal"))


def determinism(builds: DataFrame, keys: list[str], digest: str) -> DataFrame:
    return builds.groupBy(*keys).agg((F.count_distinct(digest) == 1).alias("deterministic"), F.count("*").alias("builds"))


def peers(items: DataFrame, links: DataFrame, key: str, value: str, want_equal: bool) -> DataFrame:
    """Named peers (key, peer) and whether their values relate as they should; an unknown peer fails."""
    other = items.select(F.col(key).alias("peer"), F.col(value).alias("_v"))
    j = links.join(items.select(key, value), key).join(other, "peer", "left")
    same = F.col(value).eqNullSafe(F.col("_v"))
    return j.select(key, "peer", (F.col("_v").isNotNull() & (same if want_equal else ~same)).alias("ok"))


def lineage(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Whether each child is its parent with exactly the recorded range replaced: child, parent, at, removed, inserted,
    text."""
    p = parents.select(F.col("id").alias("parent"), F.col("text").alias("_p"))
    made = F.concat(F.substr("_p", F.lit(1), F.col("at")), F.col("inserted"), F.substr(F.col("_p"), F.col("at") + F.col("removed") + 1))
    return children.join(p, "parent", "left").select("child", "parent", F.coalesce(made == F.col("text"), F.lit(False)).alias("ok"))


def rolled_up(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def preferred(*sources: Column) -> Column:
    """The first source that is set; one that is blank once trimmed is an error, not absent."""
    blank = [F.when(s.isNotNull() & (F.trim(s) == ""), F.lit(True)) for s in sources]
    return F.when(F.coalesce(*blank, F.lit(False)), F.raise_error(F.lit("empty setting"))).otherwise(F.coalesce(*sources))


def font_slots(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    return glyphs.groupBy(*keys, "font_slot").agg(F.count("*").alias("n"))
