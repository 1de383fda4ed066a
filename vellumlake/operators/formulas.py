"""Inline formulas: units, what stands beside them, radicals, and the text that may be translated around them.

Characters are rows of a paragraph (keys): pos, unicode, formula, policy, baseline, size and a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions import text as X
from vellumlake.functions.geometry import Rect

REACH = 8  # characters that a fragment beside a formula has at most
SUSPICIOUS = r"[0-9)\]}）】]"


def _has_space(value: Column) -> Column:
    return F.length(X.compact(value)) < F.length(value)


def _side(near: Column, forward: bool) -> Column:
    """The fragment that an array of characters, the nearest first, begins with: up to a formula, a character that
    isn't translated, another baseline, a gap or white space."""
    before = lambda i: F.when(i == 0, F.struct(F.col("left"), F.col("right"))).otherwise(F.struct(near[i - 1]["left"].alias("left"), near[i - 1]["right"].alias("right")))

    def stays(x, i):
        gap = x["left"] - before(i)["right"] if forward else before(i)["left"] - x["right"]
        off = F.abs(x["baseline"] - F.col("baseline")) > F.col("size") * 0.25
        return F.coalesce(~x["formula"] & (x["policy"] == "translate") & ~off & (gap <= F.col("size") * 0.5) & ~_has_space(F.coalesce(x["unicode"], F.lit(""))), F.lit(False))

    end = F.array_position(F.transform(near, stays), F.lit(False))
    taken = F.transform(F.slice(near, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(near)).cast("int")), lambda x: F.coalesce(x["unicode"], F.lit("")))
    return F.array_join(taken if forward else F.reverse(taken), "")


def adjacent_fragments(chars: DataFrame, keys: list[str], most: int = REACH) -> DataFrame:
    """keys, fragment: what stands directly beside formula characters and looks like a part of them, once each."""
    w = Window.partitionBy(*keys).orderBy("pos")
    c = F.struct("unicode", "formula", "policy", "baseline", "left", "right")
    rows = chars.withColumns({"_next": F.collect_list(c).over(w.rowsBetween(1, most)), "_last": F.reverse(F.collect_list(c).over(w.rowsBetween(-most, -1)))}).where("formula")
    each = rows.select(*keys, F.explode(F.array(_side(F.col("_next"), True), _side(F.col("_last"), False))).alias("fragment"))
    odd = F.col("fragment").rlike(SUSPICIOUS) | (F.col("fragment") == "model") | F.col("fragment").startswith("_")
    return each.where((F.length("fragment") <= most) & odd).distinct()


def completeness(chars: DataFrame, translated: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per `by`, some of the keys: paragraphs with formulas, those whose translation (keys, translated) has unbalanced
    delimiters, fragments beside formulas, and violations, the sum of both."""
    marked = chars.groupBy(*keys).agg(F.bool_or("formula").alias("_f")).where("_f").drop("_f")
    found = adjacent_fragments(chars, keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = marked.join(translated, keys, "left").join(found, keys, "left")
    open_ = F.coalesce(~X.delimiters_balanced(F.col("translated")), F.lit(False))
    out = rows.groupBy(*by).agg(F.count("*").alias("checked"), F.count_if(open_).alias("unbalanced"), F.coalesce(F.sum("_n"), F.lit(0)).alias("fragments"))
    return out.withColumn("violations", F.col("unbalanced") + F.col("fragments"))


def expanded(chars: DataFrame, keys: list[str]) -> DataFrame:
    """chars with `anchor`, the place of the model's formula character that a translated character beside it belongs to,
    and `evidence`, why; nulls for all others. Evidence is a digit as a script of the formula's character before it
    (smaller, off its baseline), or a digit that goes on a run of digits without a gap. A chain holds as far as each
    character has evidence; formulas only grow, and none is made. chars have implicit_space_before."""
    w = Window.partitionBy(*keys).orderBy("pos")
    old = lambda c: F.lag(c).over(w)
    digit = lambda c: c.rlike("^[0-9]$")
    off, em = F.abs(F.col("baseline") - old("baseline")), old("size")
    own = ~F.col("formula") & (F.col("policy") == "translate") & digit(F.col("unicode")) & (F.abs(F.col("left") - old("right")) <= em * 0.25)
    script = old("formula") & F.col("size").between(em * 0.4, em * 0.85) & off.between(em * 0.05, em * 0.75)
    run = digit(old("unicode")) & (off <= em * 0.05) & ~F.coalesce("implicit_space_before", F.lit(False))
    rows = chars.withColumn("_why", F.when(own & script, "script_baseline").when(own & run, "contiguous_digit_run"))
    start = F.last(F.when(F.col("_why").isNull(), F.struct("pos", "formula")), ignorenulls=True).over(w)
    rows = rows.withColumn("_start", start)
    part = F.col("_why").isNotNull() & F.col("_start.formula")
    return rows.select(*(F.col(f"`{c}`") for c in chars.columns), F.when(part, F.col("_start.pos")).alias("anchor"), F.when(part, F.col("_why")).alias("evidence"))


def units(chars: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """keys, start, end, text, size, left, right, expects_left, expects_right of each formula: contiguous formula
    characters, and two such runs as one where what stands between them was extracted out of place. limit: the widest
    gap that reads as one line. Characters have region, the model's region, or null."""
    w = Window.partitionBy(*keys).orderBy("pos")
    beside = lambda shift: F.struct(F.lag("policy", shift).over(w).alias("policy"), F.lag("baseline", shift).over(w).alias("baseline"))
    rows = chars.withColumns({"_c": F.coalesce(F.col("formula") != F.lag("formula").over(w), F.lit(True)).cast("int"), "_b": beside(1), "_a": beside(-1), "_limit": limit})
    rows = rows.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    u = F.coalesce("unicode", F.lit(""))
    plain = X.compact(u)
    inked = F.min(F.when(plain != "", F.struct("pos", plain.alias("u"))))
    runs = rows.groupBy(*keys, "_run").agg(
        F.first("formula").alias("formula"),
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
        F.array_sort(F.collect_list(F.struct("pos", u.alias("u")))).alias("_t"),
        F.min(F.struct("pos", "baseline")).alias("_base"),
        F.max("size").alias("size"),
        F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"),
        F.max("bottom").alias("_high"), F.min("top").alias("_low"),
        F.bool_and(F.col("unicode").isNotNull() & plain.rlike(r"^\p{P}*$")).alias("_marks"),
        inked.alias("_ink"),
        F.collect_set("region").alias("_regions"),
        F.bool_or(F.col("policy") == "translate").alias("_translates"),
        F.min(F.struct("pos", "_b")).alias("_before"),
        F.max(F.struct("pos", "_a")).alias("_after"),
        F.first("_limit").alias("_limit"),
    )
    o = Window.partitionBy(*keys).orderBy("_run")
    box = ("left", "bottom", "right", "top")
    ahead = lambda n: F.lead(F.struct(*box, "_high", "_low", "_marks", "_ink", "_regions", "_translates"), n).over(o)
    f = runs.withColumns({"_m": ahead(1), "_f": ahead(2), "_z": ahead(3)}).where("formula")
    rect = lambda c: Rect(*(F.col(f"{c}.{k}") if c else F.col(k) for k in box))
    inverted = rect("_f").follows(rect("_m"), F.col("_limit"))
    short = F.col("_m._marks") & F.col("_z").isNull()
    whole = F.col("_m._ink.u").rlike(r"^\p{P}") & F.arrays_overlap("_regions", "_f._regions") & rect("").follows(rect("_f"), F.col("_limit")) & (F.col("_m._low") > F.col("_f.bottom") + 0.01) & (F.col("_f.top") > F.col("_m._high") + 0.01)
    joins = F.coalesce(F.col("_m._ink").isNotNull() & (F.col("_limit") > 0) & inverted & (short | whole), F.lit(False))
    f = f.withColumn("_j", joins).withColumn("_s", F.coalesce(F.sum((~F.col("_j")).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # of consecutive runs that join, each second one goes to the one before it
    f = f.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_run")) - 1) / 2))
    got = f.groupBy(*keys, "_s", "_k").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.flatten(F.collect_list("_t"))).alias("_t"), F.max("size").alias("size"),
        F.min("left").alias("left"), F.max("right").alias("right"), F.min(F.struct("start", "_base")).alias("_base"),
        F.min(F.struct("start", "_before")).alias("_before"), F.max(F.struct("start", "_after")).alias("_after"),
        F.bool_or(F.when(F.col("_j"), F.col("_m._translates"))).alias("_over"), F.count("*").alias("_n"),
    )
    near = lambda c: F.coalesce((F.col(f"{c}.policy") == "translate") & (F.abs(F.col(f"{c}.baseline") - F.col("_base._base.baseline")) <= F.col("size") * 0.3), F.lit(False))
    right = near("_after._after._a") | F.coalesce(F.when(F.col("_n") > 1, F.col("_over")), F.lit(False))
    text = F.array_join(F.transform("_t", lambda x: x["u"]), "")
    return got.select(*keys, "start", "end", text.alias("text"), "size", "left", "right", near("_before._before._b").alias("expects_left"), right.alias("expects_right"))


def attached_radicals(radicals: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, radical, formula: a radical sign (radical, size, box) directly left of exactly one formula (formula, box)
    that has no other such radical."""
    r = radicals.select(*keys, "radical", F.struct("left", "bottom", "right", "top", "size").alias("_r"))
    f = formulas.select(*keys, "formula", F.struct("left", "bottom", "right", "top").alias("_f"))
    em, gap = F.greatest(F.col("_r.size"), F.lit(0.01)), F.col("_f.left") - F.col("_r.right")
    level = (F.col("_r.top") > F.col("_f.bottom") + 0.01) & (F.col("_f.top") > F.col("_r.bottom") + 0.01)
    hits = r.join(f, keys).where(level & (gap >= -0.05 * em) & (gap <= 0.25 * em)).select(*keys, "radical", "formula")
    one = hits.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "radical"))).where("_n = 1")
    return one.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "formula"))).where("_n = 1").drop("_n")


def eligible_text(chars: DataFrame, keys: list[str], direct: DataFrame | None = None, known: DataFrame | None = None, page: list[str] | None = None) -> DataFrame:
    """keys, text: what may be translated of a paragraph, in order, with implied spaces: visible, upright characters
    under the policy "translate". direct (page keys, object): the content objects that a page shows itself; on the
    pages of `known` only their characters count. Paragraphs without such characters have no row."""
    rows = chars.where(F.col("visible") & (F.col("transform").isNull() | (F.col("transform") == "upright")) & (F.col("policy") == "translate"))
    if direct is not None:
        own = direct.select(*page, F.col("object").alias("content_object"), F.lit(True).alias("_own")).distinct()
        rows = rows.join(known.select(*page, F.lit(True).alias("_known")).distinct(), page, "left").join(own, [*page, "content_object"], "left").where("_known is null or _own")
    rows = rows.where(F.col("unicode").isNotNull())
    w = Window.partitionBy(*keys).orderBy("pos")
    last, space = F.lag("unicode").over(w), X.WHITE
    implied = F.col("implicit_space_before") & ~F.coalesce(last.rlike(space + "$"), F.lit(False)) & ~F.col("unicode").rlike("^" + space)
    piece = F.concat(F.when(implied, " ").otherwise(""), F.col("unicode"))
    parts = rows.withColumn("_p", piece).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "_p"))).alias("_t"))
    return parts.select(*keys, F.array_join(F.transform("_t", lambda x: x["_p"]), "").alias("text"))


def reliability(chars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason: why a paragraph stays as it is: a translatable character without a known text, with an advance
    that isn't positive, or of an unsupported font; null if it is reliable."""
    t = F.col("policy") == "translate"
    out = chars.groupBy(*keys).agg(F.bool_or(t & F.col("unicode").isNull()).alias("_u"), F.bool_or(t & ~(F.col("advance") > 0)).alias("_a"), F.bool_or(t & ~F.col("font_supported")).alias("_f"))
    return out.select(*keys, F.when(F.col("_u"), "unreliable_unicode").when(F.col("_a"), "non_positive_advance").when(F.col("_f"), "unsupported_font").alias("reason"))
