"""Queries over formulas, eligible text and the residuals of an alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumlake.operators import formulas as M
from vellumlake.operators import sequence as S
from vellumlake.plans import relations as rel
from vellumlake.plans.structure_queries import _CHARS_SQL, _chars

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- formulas ------------------------------------------------------------------


def _glyphs(spark, sf_dir):
    para, pos = F.col("para"), F.col("pos")
    return _chars(spark, sf_dir).select(
        "para", "pos", F.substr(F.lit("a1)b_m x"), ((para * 3 + pos) % 8 + 1).cast("int"), F.lit(1)).alias("unicode"), ((para + pos * pos) % 3 == 0).alias("formula"),
        F.when((para * 7 + pos) % 5 == 0, "passthrough").otherwise("translate").alias("policy"), "baseline", "size", "left", "right",
        (F.col("baseline") - 2).alias("bottom"), (F.col("baseline") + F.col("size")).alias("top"), F.when(para % 2 == 0, 1).alias("region"),
    )


_GLYPH_SQL = _CHARS_SQL + """, gl AS (SELECT para, pos, substr('a1)b_m x', CAST((para * 3 + pos) % 8 + 1 AS INTEGER), 1) AS unicode, (para + pos * pos) % 3 = 0 AS formula,
 CASE WHEN (para * 7 + pos) % 5 = 0 THEN 'passthrough' ELSE 'translate' END AS policy, baseline, size, "left", "right", baseline - 2 AS bottom, baseline + size AS top,
 CASE WHEN para % 2 = 0 THEN 1 END AS region FROM c)"""

_FRAGMENT_SQL = _GLYPH_SQL + r""", x AS (SELECT *, row_number() OVER w AS i, lag("right") OVER w AS pr, lead("left") OVER w AS nl FROM gl WINDOW w AS (PARTITION BY para ORDER BY pos)),
 s AS (SELECT a.para, a.i AS ai, b.i > a.i AS d, b.i AS bi, b.unicode, abs(b.i - a.i) AS k,
  NOT b.formula AND b.policy = 'translate' AND abs(b.baseline - a.baseline) <= a.size * 0.25 AND (CASE WHEN b.i > a.i THEN b."left" - b.pr ELSE b.nl - b."right" END) <= a.size * 0.5 AND b.unicode <> ' ' AS ok
  FROM x a JOIN x b ON a.para = b.para AND abs(b.i - a.i) BETWEEN 1 AND 8 WHERE a.formula),
 p AS (SELECT *, bool_and(ok) OVER (PARTITION BY para, ai, d ORDER BY k) AS run FROM s),
 f AS (SELECT para, ai, d, string_agg(unicode, '' ORDER BY bi) AS fragment FROM p WHERE run GROUP BY ALL),
 fr AS (SELECT DISTINCT para, fragment FROM f WHERE regexp_matches(fragment, '[0-9)\]}]') OR fragment = 'model' OR starts_with(fragment, '_'))"""


@query("WITH " + _FRAGMENT_SQL + " SELECT para, fragment FROM fr")
def formula_fragments(spark, sf_dir):
    return M.adjacent_fragments(_glyphs(spark, sf_dir), ["para"])


@query("WITH " + _FRAGMENT_SQL + """, t AS (SELECT para, para % 7 AS paper, bool_or(formula) AS f, contains(string_agg(unicode, '' ORDER BY pos), ')') AS open_ FROM gl GROUP BY para),
 n AS (SELECT para, count(*) AS n FROM fr GROUP BY para)
 SELECT paper, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (open_) AS BIGINT) AS unbalanced, CAST(coalesce(sum(n), 0) AS BIGINT) AS fragments, CAST(count(*) FILTER (open_) + coalesce(sum(n), 0) AS BIGINT) AS violations
 FROM t LEFT JOIN n USING (para) WHERE f GROUP BY paper""")
def formula_completeness(spark, sf_dir):
    g = _glyphs(spark, sf_dir).withColumn("paper", F.col("para") % 7)
    said = g.groupBy("paper", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unicode"))), lambda x: x["unicode"]), "").alias("translated"))
    return M.completeness(g, said, ["paper", "para"], ["paper"])


@query("WITH " + _GLYPH_SQL + r""", a AS (SELECT *, CASE WHEN formula = lag(formula) OVER w THEN 0 ELSE 1 END AS ch, lag(policy) OVER w AS bp, lag(baseline) OVER w AS bb, lead(policy) OVER w AS ap, lead(baseline) OVER w AS ab FROM gl WINDOW w AS (PARTITION BY para ORDER BY pos)),
 b AS (SELECT *, sum(ch) OVER (PARTITION BY para ORDER BY pos) AS run FROM a),
 r AS (SELECT para, run, bool_or(formula) AS formula, min(pos) AS s, max(pos) AS e, string_agg(unicode, '' ORDER BY pos) AS t, max(size) AS size, arg_min(baseline, pos) AS base, min("left") AS l, max("right") AS r, min(bottom) AS bo, max(top) AS tp,
  max(bottom) AS high, min(top) AS low, bool_and(unicode IN (')', '_', ' ')) AS marks, ltrim(string_agg(unicode, '' ORDER BY pos)) AS ink, max(region) AS region, bool_or(policy = 'translate') AS tr,
  min({'pos': pos, 'p': bp, 'b': bb}) AS bx, max({'pos': pos, 'p': ap, 'b': ab}) AS ax FROM b GROUP BY para, run),
 q AS (SELECT *, lead(ink) OVER w AS m_ink, lead(l) OVER w AS m_l, lead(bo) OVER w AS m_bo, lead(tp) OVER w AS m_tp, lead(high) OVER w AS m_high, lead(low) OVER w AS m_low, lead(marks) OVER w AS m_marks, lead(tr) OVER w AS m_tr,
  lead(l, 2) OVER w AS f_l, lead(r, 2) OVER w AS f_r, lead(bo, 2) OVER w AS f_bo, lead(tp, 2) OVER w AS f_tp, lead(region, 2) OVER w AS f_region, lead(run, 3) OVER w AS z FROM r WINDOW w AS (PARTITION BY para ORDER BY run)),
 j AS (SELECT *, coalesce(m_ink <> '' AND f_tp > m_bo + 0.01 AND m_tp > f_bo + 0.01 AND m_l - f_r >= -0.01 AND m_l - f_r <= 30 + 0.01 AND ((m_marks AND z IS NULL) OR
  (left(m_ink, 1) IN (')', '_') AND region = f_region AND tp > f_bo + 0.01 AND f_tp > bo + 0.01 AND f_l - r >= -0.01 AND f_l - r <= 30 + 0.01 AND m_low > f_bo + 0.01 AND f_tp > m_high + 0.01)), false) AS j FROM q WHERE formula),
 k AS (SELECT *, coalesce(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY para ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM j),
 u AS (SELECT *, (row_number() OVER (PARTITION BY para, st ORDER BY run) - 1) // 2 AS un FROM k),
 g AS (SELECT para, min(s) AS "start", max(e) AS "end", string_agg(t, '' ORDER BY s) AS text, max(size) AS size, min(l) AS "left", max(r) AS "right", arg_min(base, s) AS base, arg_min(bx, s) AS bx, arg_max(ax, s) AS ax,
  bool_or(CASE WHEN j THEN m_tr END) AS ov, count(*) AS n FROM u GROUP BY para, st, un)
 SELECT para, "start", "end", text, size, "left", "right", coalesce(bx.p = 'translate' AND abs(bx.b - base) <= size * 0.3, false) AS expects_left,
 coalesce(ax.p = 'translate' AND abs(ax.b - base) <= size * 0.3, false) OR coalesce(n > 1 AND ov, false) AS expects_right FROM g""")
def formula_units(spark, sf_dir):
    return M.units(_glyphs(spark, sf_dir), ["para"], F.lit(30.0))


@query("WITH " + _GLYPH_SQL + """, h AS (SELECT r.para, r.pos AS radical, f.pos AS formula FROM gl r JOIN gl f ON r.para = f.para AND NOT r.formula AND r.unicode = ')' AND f.formula AND r.top > f.bottom + 0.01 AND f.top > r.bottom + 0.01
  AND f."left" - r."right" >= -0.05 * greatest(r.size, 0.01) AND f."left" - r."right" <= 0.25 * greatest(r.size, 0.01)),
 o AS (SELECT *, count(*) OVER (PARTITION BY para, radical) AS n FROM h), p AS (SELECT *, count(*) OVER (PARTITION BY para, formula) AS m FROM o WHERE n = 1) SELECT para, radical, formula FROM p WHERE m = 1""")
def attached_radicals(spark, sf_dir):
    g = _glyphs(spark, sf_dir)
    return M.attached_radicals(g.where("not formula and unicode = ')'").withColumnRenamed("pos", "radical"), g.where("formula").drop("formula").withColumnRenamed("pos", "formula"), ["para"])


_SCRIPT_SQL = _GLYPH_SQL + """, sc AS (SELECT para, pos, CASE WHEN (para + pos) % 4 = 3 THEN unicode ELSE CAST((para + pos) % 10 AS VARCHAR) END AS unicode, formula, policy, (para * 5 + pos) % 9 = 0 AS implicit_space_before,
 CASE WHEN (para + pos) % 5 = 1 THEN 0.6 ELSE 1 END * size AS size, 100.0 + CASE WHEN (para + pos) % 5 = 1 THEN 3 ELSE 0 END AS baseline, pos * 10.0 + para % 3 AS "left", pos * 10.0 + 9 + para % 3 AS "right" FROM gl)"""


def _scripts(spark, sf_dir):
    """The glyphs as a line without wide gaps, with many digits, some of them small and raised."""
    k, g = F.col("para") + F.col("pos"), _glyphs(spark, sf_dir)
    small = k % 5 == 1
    return g.select(
        "para", "pos", F.when(k % 4 == 3, F.col("unicode")).otherwise((k % 10).cast("string")).alias("unicode"), "formula", "policy", ((F.col("para") * 5 + F.col("pos")) % 9 == 0).alias("implicit_space_before"),
        (F.when(small, 0.6).otherwise(1.0) * F.col("size")).alias("size"), F.when(small, 103.0).otherwise(100.0).alias("baseline"),
        (F.col("pos") * 10.0 + F.col("para") % 3).alias("left"), (F.col("pos") * 10.0 + 9 + F.col("para") % 3).alias("right"),
    )


@query("WITH " + _SCRIPT_SQL + """, o AS (SELECT *, lag(unicode) OVER w AS u, lag(formula) OVER w AS f, lag(size) OVER w AS em, lag(baseline) OVER w AS b, lag("right") OVER w AS r FROM sc WINDOW w AS (PARTITION BY para ORDER BY pos)),
 e AS (SELECT *, CASE WHEN formula OR policy <> 'translate' OR NOT unicode BETWEEN '0' AND '9' OR r IS NULL OR abs("left" - r) > em * 0.25 THEN NULL
  WHEN f AND size >= em * 0.4 AND size <= em * 0.85 AND abs(baseline - b) >= em * 0.05 AND abs(baseline - b) <= em * 0.75 THEN 'script_baseline'
  WHEN u BETWEEN '0' AND '9' AND abs(baseline - b) <= em * 0.05 AND NOT implicit_space_before THEN 'contiguous_digit_run' END AS why FROM o),
 s AS (SELECT *, max(CASE WHEN why IS NULL THEN pos END) OVER (PARTITION BY para ORDER BY pos) AS anchor FROM e)
 SELECT s.para, s.anchor, s.why AS evidence, CAST(count(*) AS BIGINT) AS n FROM s JOIN sc a ON a.para = s.para AND a.pos = s.anchor WHERE a.formula AND s.why IS NOT NULL GROUP BY ALL""")
def boundary_expansion(spark, sf_dir):
    c = M.expanded(_scripts(spark, sf_dir), ["para"])
    return c.where("anchor is not null").groupBy("para", "anchor", "evidence").agg(F.count("*").alias("n"))


# --- eligible text ---------------------------------------------------------------

_TYPED_SQL = """ch AS (SELECT item_id, CAST(i AS INTEGER) AS pos, text[i] AS unicode, (item_id + i) % 11 <> 3 AS visible, CASE (item_id + i) % 13 WHEN 5 THEN 'rotated' WHEN 6 THEN 'upright' END AS transform,
 CASE WHEN (item_id * 3 + i) % 7 = 2 THEN 'passthrough' ELSE 'translate' END AS policy, (item_id + i // 20) % 5 AS content_object, i % 9 = 0 AS implicit_space_before, i % 17 AS advance
 FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark))"""


def _typed(spark, sf_dir):
    from vellumlake.functions import text as X

    b = rel.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.characters(F.col("text"))).alias("p", "unicode")).withColumn("pos", F.col("p") + 1)
    i, n = F.col("pos"), F.col("item_id")
    return b.select(
        "item_id", "pos", "unicode", ((n + i) % 11 != 3).alias("visible"), F.when((n + i) % 13 == 5, "rotated").when((n + i) % 13 == 6, "upright").alias("transform"),
        F.when((n * 3 + i) % 7 == 2, "passthrough").otherwise("translate").alias("policy"), ((n + F.floor(i / 20)) % 5).alias("content_object"), (i % 9 == 0).alias("implicit_space_before"), (i % 17).alias("advance"),
    )


@query("WITH " + _TYPED_SQL + r""", e AS (SELECT * FROM ch WHERE visible AND (transform IS NULL OR transform = 'upright') AND policy = 'translate' AND (item_id % 4 = 0 OR content_object < 3)),
 l AS (SELECT *, lag(unicode) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM e)
 SELECT item_id, string_agg(CASE WHEN implicit_space_before AND NOT coalesce(regexp_matches(b, '\s'), false) AND NOT regexp_matches(unicode, '\s') THEN ' ' ELSE '' END || unicode, '' ORDER BY pos) AS text FROM l GROUP BY item_id""")
def eligible_text(spark, sf_dir):
    c = _typed(spark, sf_dir)
    known = c.where("item_id % 4 <> 0").select("item_id").distinct()
    direct = known.select("item_id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("object"))
    return M.eligible_text(c, ["item_id"], direct, known, ["item_id"])


@query("WITH " + _TYPED_SQL + """ SELECT item_id, CASE WHEN bool_or(policy = 'translate' AND pos % 101 = 100) THEN 'unreliable_unicode' WHEN bool_or(policy = 'translate' AND advance <= 0 AND pos > 90) THEN 'non_positive_advance'
 WHEN bool_or(policy = 'translate' AND content_object = 4 AND item_id % 3 = 0) THEN 'unsupported_font' END AS reason FROM ch GROUP BY item_id""")
def paragraph_reliability(spark, sf_dir):
    c = _typed(spark, sf_dir)
    c = c.withColumns({"unicode": F.when(F.col("pos") % 101 != 100, F.col("unicode")), "advance": F.when(F.col("pos") > 90, F.col("advance")).otherwise(1), "font_supported": ~((F.col("content_object") == 4) & (F.col("item_id") % 3 == 0))})
    return M.reliability(c, ["item_id"])


# --- residuals -------------------------------------------------------------------

_RES_SQL = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
 w AS (SELECT l_orderkey // 100 AS page, t.tolerance, l_orderkey * 10 + l_linenumber AS id, substr('ab -', CAST(p % 4 + 1 AS INTEGER), 1) AS text, p % 9 <> 0 AS visible, s % 8 <> 0 AS placed, s % 3 AS candidates,
  CASE p % 3 WHEN 0 THEN 'to_unicode' WHEN 1 THEN 'simple_encoding' ELSE 'unresolved' END AS provenance, substr('ab a', CAST(s % 4 + 1 AS INTEGER), 1) AS engine, (p + s) % 10 < t.tolerance * 10 AS matched, (p + s) % 7 AS k
  FROM li, (VALUES (0.25), (0.5), (1.0)) t(tolerance)),
 z AS (SELECT page, tolerance, CASE WHEN matched THEN CASE WHEN text = engine THEN NULL WHEN text = ' ' OR engine = ' ' OR NOT visible THEN 'A' WHEN provenance = 'to_unicode' THEN 'C_strong' WHEN provenance = 'simple_encoding' THEN 'C_weak' ELSE 'C_unresolved' END
  WHEN k < 4 THEN CASE WHEN text = ' ' OR NOT visible THEN 'A' WHEN NOT placed OR candidates > 0 THEN 'F' ELSE 'D' END
  ELSE CASE WHEN NOT (candidates * 10 - 5 > 0) OR text = ' ' THEN 'A' WHEN NOT placed OR candidates > 1 THEN 'F' ELSE 'E' END END AS class FROM w)"""
_COUNTS_SQL = ", ".join(["CAST(count(*) FILTER (class IS NULL) AS BIGINT) AS same", *(f"CAST(count(*) FILTER (class = '{k}') AS BIGINT) AS {k.lower()}" for k in ("A", "C_hyphen", "C_strong", "C_weak", "C_unresolved", "D", "E", "F"))])


def _residuals(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, s = F.col("p"), F.col("s")
    one = li.select(
        F.floor(F.col("l_orderkey") / 100).alias("page"), F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("tolerance"), F.substr(F.lit("ab -"), (p % 4 + 1).cast("int"), F.lit(1)).alias("text"), (p % 9 != 0).alias("visible"), (s % 8 != 0).alias("placed"),
        (s % 3).alias("candidates"), F.when(p % 3 == 0, "to_unicode").when(p % 3 == 1, "simple_encoding").otherwise("unresolved").alias("provenance"), F.substr(F.lit("ab a"), (s % 4 + 1).cast("int"), F.lit(1)).alias("engine"), ((p + s) % 10).alias("far"), ((p + s) % 7).alias("k"),
    )
    edge = F.col("candidates") * 10.0 - 5
    on_page = S.intersects_page(edge - 5, F.lit(1.0), edge, F.lit(9.0), F.lit(100.0), F.lit(100.0))
    alone = F.when(F.col("k") < 4, S.walk_class()).otherwise(S.engine_class(on_page, candidates="others"))
    one = one.withColumn("others", F.col("candidates") - 1)
    return one.withColumn("class", F.when(F.col("far") < F.col("tolerance") * 10, S.pair_class("text", "engine")).otherwise(alone))


@query("WITH " + _RES_SQL + f" SELECT page, tolerance, {_COUNTS_SQL} FROM z GROUP BY page, tolerance")
def residual_classes(spark, sf_dir):
    return S.class_counts(_residuals(spark, sf_dir), ["page", "tolerance"])


@query("WITH " + _RES_SQL + f" SELECT tolerance, {_COUNTS_SQL} FROM z GROUP BY tolerance")
def tolerance_sweep(spark, sf_dir):
    return S.class_counts(_residuals(spark, sf_dir), ["tolerance"])


@query()
def sequence_only(spark, sf_dir):
    """Characters of two extractions of a text that correspond by their order only; tests compare it with a plain version."""
    c = _typed(spark, sf_dir).withColumn("i", F.col("pos") - 1)
    free = F.col("i") % 50 >= 10
    walk = c.select("item_id", F.lit("walk").alias("side"), F.col("i").cast("bigint").alias("pos"), F.col("unicode").alias("text"), "visible", free.alias("free"), F.when(~free, F.col("i").cast("bigint")).alias("mate"))
    engine = c.select("item_id", F.lit("engine").alias("side"), F.col("i").cast("bigint").alias("pos"), F.when((F.col("item_id") + F.col("i")) % 6 == 0, "#").otherwise(F.col("unicode")).alias("text"), F.lit(True).alias("visible"), free.alias("free"), F.lit(None).cast("bigint").alias("mate"))
    return S.sequence_only(walk.unionAll(engine), "item_id")
