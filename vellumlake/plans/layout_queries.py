"""Queries over lines, columns, labels, name trees, reports and the details of audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumlake.functions import geometry as G
from vellumlake.functions import text as X
from vellumlake.functions.numeric import round6
from vellumlake.operators import audit as A
from vellumlake.operators import events as E
from vellumlake.operators import ordered as O
from vellumlake.operators import spatial, tree
from vellumlake.plans import relations as rel
from vellumlake.plans.relations import B_SQL, LOG_SQL, P_SQL, T_SQL
from vellumlake.plans.structure_queries import _tree
from vellumlake.sources import pdf_content, readers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- lines and columns -----------------------------------------------------------

_LINES_SQL = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
 l AS (SELECT l_orderkey AS para, l_linenumber AS line, CAST(10 + p % 4 * 6 AS DOUBLE) AS "left", CAST(110 + p % 4 * 6 + s % 5 * 40 AS DOUBLE) AS "right", CAST(8 + p % 5 AS DOUBLE) AS size FROM li)"""


@query("WITH " + _LINES_SQL + """, w AS (SELECT *, min("left") OVER (PARTITION BY para) AS e, max("right") OVER (PARTITION BY para) AS r, lag("right" - "left") OVER (PARTITION BY para ORDER BY line) AS pw FROM l)
 SELECT para, line, coalesce("left" - e > 1.2 * size AND pw <= 0.8 * (r - e), false) AS splits FROM w""")
def split_evidence(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    left = 10 + F.col("p") % 4 * 6
    lines = li.select(F.col("l_orderkey").alias("para"), F.col("l_linenumber").alias("line"), left.cast("double").alias("left"), (left + 100 + F.col("s") % 5 * 40).cast("double").alias("right"), (8 + F.col("p") % 5).cast("double").alias("size"))
    return O.split_evidence(lines, ["para"]).select("para", "line", "splits")


@query("WITH " + B_SQL + """, d AS (SELECT page, owner, min("left") AS l, min("right") AS r, min(top) AS t FROM b GROUP BY 1, 2)
 SELECT page, owner, CAST(row_number() OVER (PARTITION BY page ORDER BY (l + r) / 2 >= 260, t DESC, l, owner) - 1 AS INTEGER) AS reading_order FROM d""")
def column_reading_order(spark, sf_dir):
    b = rel.boxes(spark, sf_dir).groupBy("page", "owner").agg(*(F.min(c).alias(c) for c in ("left", "right", "top")))
    return O.column_order(b, ["page"], F.lit(260.0), "owner").select("page", "owner", "reading_order")


_LABEL_RULES = ((0, "r", "", None), (4, "D", "", 3), (7, None, "A-", None))


@query("""WITH p AS (SELECT page_id // 10 AS doc, page_id % 10 AS page FROM pages), r(start, style, prefix, first) AS (VALUES (0, 'r', '', NULL), (4, 'D', '', 3), (7, NULL, 'A-', NULL)),
 a AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY doc, page ORDER BY start DESC) AS n FROM p JOIN r ON start <= page)
 SELECT doc, page AS source_page, style, prefix, CAST(CASE WHEN style IS NOT NULL THEN coalesce(first, 1) + page - start END AS BIGINT) AS number, 2 * page + side AS output_page FROM a, (VALUES (0), (1)) t(side) WHERE n = 1""")
def page_label_ranges(spark, sf_dir):
    p = rel.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("doc"), (F.col("page_id") % 10).alias("page"))
    rule = lambda r: F.struct(F.lit(r[0]).cast("bigint").alias("start"), F.lit(r[1]).cast("string").alias("style"), F.lit(r[2]).alias("prefix"), F.lit(r[3]).cast("bigint").alias("first"))
    rules = p.select("doc").distinct().select("doc", F.explode(F.array(*map(rule, _LABEL_RULES))).alias("r")).select("doc", "r.*")
    return O.page_labels(p, rules, ["doc"])


# --- name trees ------------------------------------------------------------------

_LEAVES_SQL = """RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS parent FROM customer),
 w(node) AS (SELECT node FROM n WHERE node IN (1, 2) UNION ALL SELECT n.node FROM w JOIN n ON n.parent = w.node), lv AS (SELECT node FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.parent = w.node))"""


def _leaves(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return tree.leaves(t.where("parent is not null").select("parent", F.col("node").alias("child")), t.where("node in (1, 2)").select("node"))


@query("WITH " + _LEAVES_SQL + " SELECT node FROM lv")
def reachable_leaves(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query("WITH " + _LEAVES_SQL + """, m AS (SELECT 'name' || node % 400 AS name, min({'node': node, 'page': node * 7 % 500}) AS x FROM lv GROUP BY 1)
 SELECT x.page AS page, name, CASE WHEN x.page % 3 <> 0 THEN 2 * x.page + 1 END AS new FROM m""")
def name_tree_remap(spark, sf_dir):
    leaf = _leaves(spark, sf_dir)
    names = leaf.select("node", F.concat(F.lit("name"), (F.col("node") % 400).cast("string")).alias("name"), (F.col("node") * 7 % 500).alias("page"))
    pages = spark.range(500).where("id % 3 <> 0").select(F.col("id").alias("old"), (2 * F.col("id") + 1).alias("new"))
    return tree.remapped_names(names, leaf, pages)


# --- audits ----------------------------------------------------------------------


@query("""SELECT l_orderkey // 100 AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'missing_output_ink' WHEN 1 THEN 'component_collision' ELSE 'invalid_formula_ownership' END AS kind, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL""")
def violations_by_kind(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    v = rel.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("doc"), F.when(k == 0, "missing_output_ink").when(k == 1, "component_collision").otherwise("invalid_formula_ownership").alias("kind"))
    return A.violations_by_kind(v, ["doc"])


@query("WITH " + T_SQL + " SELECT DISTINCT doc_id, reading_order FROM t WHERE doc_id % 9 <> 0 AND src <> tgt")
def required_publications(spark, sf_dir):
    t = rel.lossy(rel.paragraphs(spark, sf_dir))
    p = t.select("doc_id", "reading_order", F.col("src").alias("source"), F.col("tgt").alias("translated"), F.when(F.col("doc_id") % 9 == 0, "translation_failure").alias("preserved"))
    return A.required_publications(p, ["doc_id", "reading_order"])


@query("WITH " + B_SQL + """, d AS (SELECT DISTINCT page, owner FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY owner) AS n, count(*) OVER (PARTITION BY page) AS total FROM d)
 SELECT page, owner, CAST(total AS BIGINT) AS total FROM r WHERE n <= 5""")
def residual_detail(spark, sf_dir):
    return A.detail(rel.boxes(spark, sf_dir).select("page", "owner").distinct(), ["page"], ["owner"], 5)


@query("WITH " + B_SQL + """, o AS (SELECT x.page, x.owner AS a_owner, y.owner AS b_ident, (least(x."right", y."right") - greatest(x."left", y."left")) * (least(x.top, y.top) - greatest(x.bottom, y.bottom)) AS overlap FROM b x JOIN b y
  ON x.page = y.page AND x.owner % 10 = 1 AND y.owner % 10 > 1 AND least(x."right", y."right") > greatest(x."left", y."left") AND least(x.top, y.top) > greatest(x.bottom, y.bottom)),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, a_owner ORDER BY overlap DESC, b_ident) AS n FROM o) SELECT page, a_owner, b_ident, overlap, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 2""")
def nearest_obstacles(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    one, other = spatial.renamed(b.where("owner % 10 = 1"), "a_", ["page"]), spatial.renamed(b.where("owner % 10 > 1").withColumnRenamed("owner", "ident"), "b_", ["page"])
    pairs = spatial.rect_pairs(one, other, ["page"], 16.0, lambda x, y: F.lit(True))
    pairs = pairs.select("page", "a_owner", "b_ident", G.Rect.of("a_").overlap(G.Rect.of("b_")).alias("overlap"))
    return A.obstacles(pairs, ["page", "a_owner"], 2)


@query("""WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 10 AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM li),
 d AS (SELECT l_orderkey, i FROM r WHERE (l_linenumber % 3) * 0.2 > 0.25 OR (l_orderkey % 5 = 0 AND i = 2)) SELECT o.l_orderkey, CAST(count(i) AS INTEGER) AS differing, CAST(min(i) AS INTEGER) AS first FROM (SELECT DISTINCT l_orderkey FROM li) o LEFT JOIN d ON d.l_orderkey = o.l_orderkey GROUP BY 1""")
def geometry_differences(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 10).cast("double").alias("x"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))).alias("r"))
    a = F.transform("r", lambda s: s["x"])
    b = F.transform("r", lambda s, i: F.when(~((F.col("l_orderkey") % 5 == 0) & (i == 2)), s["x"] + s["l_linenumber"] % 3 * 0.2))
    d = A.differences(a, b, 0.25)
    return rows.select("l_orderkey", d.alias("d")).select("l_orderkey", F.size("d").alias("differing"), F.array_min(F.transform("d", lambda x: x["index"])).alias("first"))


@query("WITH " + P_SQL + r""", q AS (SELECT doc_id, reading_order, CASE reading_order % 4 WHEN 0 THEN 'x = y' WHEN 1 THEN left(src, 12) || ' = 3' WHEN 2 THEN src ELSE '∑ a' END AS s FROM p)
 SELECT doc_id, reading_order, regexp_matches(s, '[=<>≤≥≈≠±×÷∑∏∫√∂]') AND len(regexp_extract_all(s, '[\p{L}\p{N}]+')) <= 2 AS math FROM q""")
def math_shaped(spark, sf_dir):
    s = F.expr("CASE reading_order % 4 WHEN 0 THEN 'x = y' WHEN 1 THEN concat(left(src, 12), ' = 3') WHEN 2 THEN src ELSE '∑ a' END")
    return rel.paragraphs(spark, sf_dir).select("doc_id", "reading_order", X.math_shaped(s).alias("math"))


@query("WITH " + LOG_SQL + """, d AS (SELECT run, ordinal, id FROM g WHERE event = 'diagnostic'), r AS (SELECT *, id = 'page_degraded' AS free, row_number() OVER (PARTITION BY run, id ORDER BY ordinal) AS n FROM d),
 q AS (SELECT *, sum(CASE WHEN NOT free AND n <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ordinal) AS m FROM r), k AS (SELECT run, ordinal, id, free OR (n <= 5 AND m <= 12) AS kept FROM q)
 SELECT run, 'kept' AS kind, id, ordinal, CAST(1 AS BIGINT) AS n FROM k WHERE kept UNION ALL SELECT run, 'dropped', id, CAST(NULL AS BIGINT), CAST(count(*) AS BIGINT) FROM k WHERE NOT kept GROUP BY run, id
 UNION ALL SELECT run, 'debug', status, ordinal, CAST(1 AS BIGINT) FROM g WHERE event = 'translation_cache'""")
def debug_view(spark, sf_dir):
    g = rel.log(spark, sf_dir)
    kept = O.budgeted(g.where("event = 'diagnostic'").select("run", "ordinal", "id"), ["run"], "id", "ordinal", per_id=5, total=12)
    return E.debug_view(kept, g.where("event = 'translation_cache'").select("run", "ordinal", F.col("status").alias("id")), ["run"])


# --- reports ---------------------------------------------------------------------


@query("""SELECT n_nationkey, n_name AS source, 'x' || n_name AS target FROM nation""")
def extracted_terms(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation")
    answer = F.concat(F.lit('{"terms":[{"source":"'), "n_name", F.lit('","target":"x'), "n_name", F.lit('"},{"source":" ","target":"y"},{"source":"z"}]}'))
    return readers.extracted_terms(n.select("n_nationkey", F.when(F.col("n_nationkey") >= 0, answer).alias("value")))


@query("""SELECT p_partkey, 0 AS page, 1 AS block, l AS line, p_name || l AS text, CAST(p_size AS DOUBLE) AS x, CAST(l * 12 AS DOUBLE) AS y, CAST(50 AS DOUBLE) AS w, CAST(10.5 AS DOUBLE) AS h FROM part, (VALUES (0), (1)) t(l)""")
def structured_text_boxes(spark, sf_dir):
    p = rel.table(spark, sf_dir, "part")
    line = lambda l: F.concat(F.lit('{"text":"'), "p_name", F.lit(f'{l}","bbox":{{"x":'), F.col("p_size").cast("string"), F.lit(f',"y":{12 * l},"w":50,"h":10.5}}}}'))
    report = F.concat(F.lit('{"pages":[{"blocks":[{"type":"image","lines":[]},{"type":"text","bbox":{"x":0,"y":0,"w":1,"h":1},"lines":['), line(0), F.lit(","), line(1), F.lit("]}]}]}"))
    return readers.text_boxes(p.select("p_partkey", report.alias("value")))


_CURVE_SQL = """k AS (SELECT p_partkey, CAST(p_partkey % 7 AS DOUBLE) AS p0, CAST(p_partkey % 11 * 3 AS DOUBLE) AS p1, CAST(-(p_partkey % 5) * 4 AS DOUBLE) AS p2, CAST(p_partkey % 13 AS DOUBLE) AS p3 FROM part),
 c AS (SELECT *, 3 * (-p0 + 3 * p1 - 3 * p2 + p3) AS a, 6 * (p0 - 2 * p1 + p2) AS b, 3 * (p1 - p0) AS c FROM k),
 t AS (SELECT *, CASE WHEN abs(a) > 1e-12 AND b * b - 4 * a * c >= 0 THEN [(-b + sqrt(b * b - 4 * a * c)) / (2 * a), (-b - sqrt(b * b - 4 * a * c)) / (2 * a)] WHEN abs(a) <= 1e-12 AND abs(b) > 1e-12 THEN [-c / b] ELSE [] END AS ts FROM c),
 u AS (SELECT p_partkey, p0, p1, p2, p3, unnest(list_concat([0.0, 1.0], list_filter(ts, lambda x: x > 0 AND x < 1))) AS t FROM t),
 v AS (SELECT p_partkey, pow(1 - t, 3) * p0 + 3 * pow(1 - t, 2) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3 AS y FROM u)"""


@query("WITH " + _CURVE_SQL + " SELECT p_partkey, round(min(y), 6) AS low, round(max(y), 6) AS high FROM v GROUP BY 1")
def curve_bounds(spark, sf_dir):
    k = F.col("p_partkey")
    p = rel.table(spark, sf_dir, "part").select(k, (k % 7).cast("double").alias("p0"), (k % 11 * 3).cast("double").alias("p1"), (-(k % 5) * 4).cast("double").alias("p2"), (k % 13).cast("double").alias("p3"))
    b = G.curve_bounds(*(F.col(f"p{i}") for i in range(4)))
    return p.select("p_partkey", b.alias("b")).select("p_partkey", round6(F.col("b.low")).alias("low"), round6(F.col("b.high")).alias("high"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS visible, CASE p_partkey % 6 WHEN 1 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS invisible, p_partkey % 6 = 2 AS image, p_partkey % 6 NOT IN (3, 4) AS complete FROM part""")
def page_evidence(spark, sf_dir):
    """Pages of text, of a form that calls a form, of an image, of a form that draws itself, of an unknown name, and of
    hidden text in a form that has the caller's names and render mode."""
    k = F.col("p_partkey") % 6
    data = F.when(k == 0, F.concat(F.lit("BT ("), "p_name", F.lit(") Tj ET"))).when(k == 1, "BT (a) Tj ET /Fm0 Do").when(k == 2, "q /Im0 Do Q").when(k == 3, "/Fm2 Do").when(k == 4, "BT (a) Tj ET /None Do").otherwise("BT 3 Tr ET /Fm3 Do")
    x = lambda owner, name, object_, subtype, stream, own: F.struct(*(F.lit(v).alias(n) for n, v in zip(("owner", "name", "object", "subtype"), (owner, name, object_, subtype))), F.lit(stream).cast("binary").alias("data"), F.array().cast("array<string>").alias("filters"), F.lit(own).alias("own"))
    known = (x("", "/Im0", "1", "Image", "", False), x("", "/Fm0", "2", "Form", "/In Do BT 3 Tr (h) Tj ET", True), x("2", "/In", "3", "Form", "BT (v) Tj ET", True), x("", "/Fm2", "4", "Form", "/Fm2 Do", False), x("", "/Fm3", "5", "Form", "BT (h) Tj ET", False))
    p = rel.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document"), F.lit(0).alias("page_index"), data.cast("binary").alias("data"), F.array().cast("array<string>").alias("filters"), F.array(*known).alias("xobjects"))
    return pdf_content.evidence(p).select(F.col("document").cast("bigint").alias("p_partkey"), "visible", "invisible", "image", "complete")
