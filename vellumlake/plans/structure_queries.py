"""Queries over pages, boxes, events and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumlake.functions import geometry as G
from vellumlake.functions import text as X
from vellumlake.functions.numeric import median_positive, round6
from vellumlake.operators import events as E
from vellumlake.operators import ordered as O
from vellumlake.operators import relational as R
from vellumlake.operators import scan, score, spatial, tree
from vellumlake.plans import relations as rel
from vellumlake.plans.relations import B_SQL, LOG_SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- pairing ---------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice, l.l_linenumber AS ord, l.l_partkey AS part FROM orders JOIN
 (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) l ON l_orderkey = o_orderkey AND r = 1""")
def snapshot_pair_last_wins(spark, sf_dir):
    before = rel.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    after = rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"))
    return R.paired(before, after, ["o_orderkey"], "ord", ["ord", "part"])


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def point_lookup_first_wins(spark, sf_dir):
    c = rel.table(spark, sf_dir, "customer").select("c_custkey")
    o = rel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.looked_up(c, o.withColumn("ord", F.col("o_orderkey")), ["c_custkey"], "ord", ["o_orderkey"])


@query("""WITH r AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
 e AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 5 <> 0 GROUP BY 1)
 SELECT coalesce(r.k, e.k) AS k, CASE WHEN r.k IS NULL THEN 'unexpected' WHEN e.k IS NULL THEN 'missing' WHEN e.n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM r FULL JOIN e ON r.k = e.k""")
def group_evidence_status(spark, sf_dir):
    required = rel.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    evidence = rel.table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k"))
    return R.evidence_status(required, evidence, ["k"])


@query("""SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1""")
def unique_owner(spark, sf_dir):
    return R.unique_owners(rel.table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
 SELECT k, 'left_only' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_symmetric_diff(spark, sf_dir):
    a = rel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = rel.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return R.symmetric_difference(a, b)


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x, list(l_partkey ORDER BY l_partkey, l_linenumber) AS y FROM lineitem GROUP BY 1)
 SELECT l_orderkey, x[1:2] = y[1:2] AND len(x) >= 1 AS prefix, CAST((SELECT min(i) FROM unnest(range(len(x))) AS t(i) WHERE x[i + 1] <> y[i + 1]) AS INTEGER) AS mismatch FROM a""")
def array_prefix_check(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem")
    pick = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda s: s["l_partkey"])
    a = li.groupBy("l_orderkey").agg(pick("l_linenumber", "l_partkey").alias("x"), pick("l_partkey", "l_linenumber").alias("y"))
    return a.select("l_orderkey", (R.is_prefix(F.slice("x", 1, 2), F.col("y"))).alias("prefix"), R.first_mismatch(F.col("x"), F.col("y")).cast("int").alias("mismatch"))


@query("""WITH c AS (SELECT DISTINCT CAST(l_suppkey % 3 AS INTEGER) AS font, l_partkey AS code, CASE WHEN l_partkey < 256 THEN 1 ELSE 2 END AS bytes FROM lineitem),
 r AS (SELECT CAST(s_suppkey % 3 AS INTEGER) AS font, s_suppkey AS ord, s_suppkey * 7 % 900 AS low, s_suppkey * 7 % 900 + 150 AS high, 5000 + s_suppkey * 11 AS first, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS bytes FROM supplier),
 h AS (SELECT c.font, c.code, c.bytes, r.first + c.code - r.low AS cid, row_number() OVER (PARTITION BY c.font, c.code, c.bytes ORDER BY r.ord) AS n FROM c JOIN r ON c.font = r.font AND c.bytes = r.bytes AND c.code BETWEEN r.low AND r.high),
 x AS (SELECT CAST(p_partkey % 3 AS INTEGER) AS font, p_partkey AS code, 90000 + p_partkey AS cid FROM part WHERE p_partkey % 10 = 0)
 SELECT c.font, c.code, c.bytes, coalesce(x.cid, h.cid) AS cid FROM c LEFT JOIN x ON x.font = c.font AND x.code = c.code LEFT JOIN h ON h.font = c.font AND h.code = c.code AND h.bytes = c.bytes AND h.n = 1""")
def code_to_cid(spark, sf_dir):
    li, s, p = (rel.table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    codes = li.select((F.col("l_suppkey") % 3).cast("int").alias("font"), F.col("l_partkey").alias("code"), F.when(F.col("l_partkey") < 256, 1).otherwise(2).alias("bytes")).distinct()
    low = F.col("s_suppkey") * 7 % 900
    ranges = s.select((F.col("s_suppkey") % 3).cast("int").alias("font"), F.col("s_suppkey").alias("ord"), low.alias("low"), (low + 150).alias("high"), (5000 + F.col("s_suppkey") * 11).alias("first"), F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(2).alias("bytes"))
    exact = p.where("p_partkey % 10 = 0").select((F.col("p_partkey") % 3).cast("int").alias("font"), F.col("p_partkey").alias("code"), (90000 + F.col("p_partkey")).alias("cid"))
    return R.code_ranges(codes, exact, ranges)


# --- order -------------------------------------------------------------------


@query("""WITH d AS (SELECT user_id, event_id % 7 AS query, event_type, round(value, 1) AS score, event_id FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY score DESC, event_id) AS n FROM d)
 SELECT user_id, query, score, event_id FROM r WHERE n = 1 AND score >= 0.5""")
def detection_dedupe(spark, sf_dir):
    d = rel.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("query"), F.round("value", 1).alias("score"), "event_id")
    return O.detections(d, ["user_id"], "query", "score", "event_id")


_BUDGET_SQL = "WITH " + LOG_SQL + """, d AS (SELECT run AS doc, ordinal, id FROM g WHERE event = 'diagnostic'),
 r AS (SELECT *, id = 'page_degraded' AS free, row_number() OVER (PARTITION BY doc, id ORDER BY ordinal) AS n FROM d),
 q AS (SELECT *, sum(CASE WHEN NOT free AND n <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ordinal) AS m FROM r),
 k AS (SELECT doc, ordinal, id, free OR (n <= 25 AND m <= 60) AS kept FROM q)
"""


def _budget(spark, sf_dir):
    d = rel.log(spark, sf_dir).where("event = 'diagnostic'").select(F.col("run").alias("doc"), "ordinal", "id")
    return O.budgeted(d, ["doc"], "id", "ordinal", total=60)


@query(_BUDGET_SQL + "SELECT doc, ordinal, id, kept FROM k")
def diagnostics_budget(spark, sf_dir):
    return _budget(spark, sf_dir)


@query(_BUDGET_SQL + "SELECT id, CAST(count(*) AS BIGINT) AS dropped FROM k WHERE NOT kept GROUP BY id")
def dropped_counts_by_id(spark, sf_dir):
    return _budget(spark, sf_dir).where("not kept").groupBy("id").agg(F.count("*").alias("dropped"))


@query(_BUDGET_SQL + """SELECT doc, CAST(count(*) FILTER (kept AND id NOT IN ('unicode_recovered', 'section_number_gap_clamped')) AS BIGINT) AS shown,
 CAST(count(*) FILTER (NOT kept AND id <> 'unicode_recovered') AS BIGINT) AS dropped,
 CAST(count(*) FILTER ((kept AND id NOT IN ('unicode_recovered', 'section_number_gap_clamped')) OR (NOT kept AND id <> 'unicode_recovered')) AS BIGINT) AS warnings FROM k GROUP BY doc""")
def warning_count(spark, sf_dir):
    return O.warning_count(_budget(spark, sf_dir), ["doc"], "id")


_CHARS_SQL = """c AS (SELECT l_orderkey AS para, l_linenumber AS pos, CAST(l_linenumber * 10 + l_partkey % 4 AS DOUBLE) AS "left", CAST(l_linenumber * 10 + 6 + l_suppkey % 3 AS DOUBLE) AS "right",
 CAST(100 + l_orderkey % 2 * (l_linenumber % 3) AS DOUBLE) AS baseline, CAST(8 + l_partkey % 5 AS DOUBLE) AS size, l_suppkey % 2 = 0 AS implicit_space_before
 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))"""


def _chars(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return li.select(
        F.col("l_orderkey").alias("para"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 4).cast("double").alias("left"), (F.col("l_linenumber") * 10 + 6 + F.col("l_suppkey") % 3).cast("double").alias("right"),
        (100 + F.col("l_orderkey") % 2 * (F.col("l_linenumber") % 3)).cast("double").alias("baseline"), (8 + F.col("l_partkey") % 5).cast("double").alias("size"), (F.col("l_suppkey") % 2 == 0).alias("implicit_space_before"),
    )


@query("WITH " + _CHARS_SQL + """, w AS (SELECT para, size, CASE WHEN implicit_space_before AND abs(baseline - lag(baseline) OVER (PARTITION BY para ORDER BY pos)) <= 0.001
 THEN "left" - lag("right") OVER (PARTITION BY para ORDER BY pos) END AS gap FROM c)
 SELECT para, median(CASE WHEN gap > 0 THEN gap END) AS median_gap, greatest(coalesce(2 * median(CASE WHEN gap > 0 THEN gap END), 0.0), 1.5 * median(size)) AS "limit" FROM w GROUP BY para""")
def continuity_bound(spark, sf_dir):
    w = O.word_gaps(_chars(spark, sf_dir), ["para"])
    return w.groupBy("para").agg(median_positive(F.col("gap")).alias("median_gap"), O.continuity_limit(F.col("gap"), F.col("size")).alias("limit"))


@query("WITH " + _CHARS_SQL + """, m AS (SELECT para, median(size) AS s, median(baseline) AS b, count(*) AS n FROM c GROUP BY para)
 SELECT para, bool_or(size <= 0.8 * s AND abs(baseline - b) >= 0.15 * s) AND max(n) >= 2 AS superscript FROM c JOIN m USING (para) GROUP BY para""")
def superscript_candidates(spark, sf_dir):
    return score.superscript(_chars(spark, sf_dir), ["para"])


@query("WITH " + _CHARS_SQL + """, n AS (SELECT para, size, count(*) AS k FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY para ORDER BY k DESC, size DESC) AS i FROM n)
 SELECT para, size FROM r WHERE i = 1""")
def body_size(spark, sf_dir):
    return score.body_size(_chars(spark, sf_dir), ["para"])


@query("WITH " + _CHARS_SQL + """, f AS (SELECT para, arg_min(CASE WHEN pos = 1 THEN "left" ELSE "left" - pos * 10 END, pos) - median(CASE WHEN pos > 1 THEN "left" - pos * 10 END) AS d FROM c GROUP BY para)
 SELECT para, CASE WHEN d > 0 THEN round(d, 6) END AS indent FROM f""")
def first_line_indent(spark, sf_dir):
    c = _chars(spark, sf_dir).select("para", (F.col("pos") - 1).alias("line"), F.when(F.col("pos") == 1, F.col("left")).otherwise(F.col("left") - F.col("pos") * 10).alias("x"))
    return score.first_line_indent(c, ["para"])


@query("""WITH RECURSIVE v AS (SELECT user_id AS page, event_id AS ord, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 w(page, n, ord, anchor, line) AS (SELECT page, n, ord, y, 0 FROM v WHERE n = 1
 UNION ALL SELECT v.page, v.n, v.ord, CASE WHEN abs(v.y - w.anchor) > 20.0 THEN v.y ELSE w.anchor END, w.line + CASE WHEN abs(v.y - w.anchor) > 20.0 THEN 1 ELSE 0 END FROM w JOIN v ON v.page = w.page AND v.n = w.n + 1)
 SELECT page, ord, line FROM w""")
def line_grouping_anchor(spark, sf_dir):
    v = rel.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), F.col("value").alias("y"))
    return O.anchored_lines(v, ["page"], "ord", "y", 20.0)


@query("""WITH s AS (SELECT user_id AS stream, event_id * 10 AS byte_start, event_id * 10 + event_id * 13 % 4000 AS byte_end FROM events)
 SELECT stream, byte_start, byte_end, coalesce(byte_start < lag(byte_end) OVER (PARTITION BY stream ORDER BY byte_start, byte_end), false) AS overlaps FROM s""")
def span_overlap_check(spark, sf_dir):
    s = rel.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.col("event_id") * 10).alias("byte_start"), (F.col("event_id") * 10 + F.col("event_id") * 13 % 4000).alias("byte_end"))
    return O.span_overlaps(s, ["stream"])


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
 SELECT user_id, event_type, min(event_id) AS first, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY user_id, event_type, g""")
def isolation_islands(spark, sf_dir):
    e = O.islands(rel.table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type"))
    return e.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("island")


@query("""SELECT n_nationkey AS page_index, side, 2 * n_nationkey + side AS output_page FROM nation, (VALUES (0), (1)) t(side)""")
def bilingual_interleave(spark, sf_dir):
    return O.interleaved(rel.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_index")))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS y FROM events),
 i AS (SELECT a.user_id, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.x < b.x AND a.y > b.y GROUP BY 1)
 SELECT r.user_id, CAST(count(*) FILTER (x <> y) AS BIGINT) AS moved, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(max(i.n), 0) AS BIGINT) AS inversions FROM r LEFT JOIN i ON i.user_id = r.user_id GROUP BY r.user_id""")
def inversion_count(spark, sf_dir):
    e = rel.table(spark, sf_dir, "events").select("user_id", F.struct("event_id").alias("a"), F.struct("value", "event_id").alias("b"))
    return O.order_divergence(e, ["user_id"], "a", "b")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN [] WHEN 1 THEN [250] WHEN 2 THEN [250, 500] ELSE [250, 500, 1000] END AS delays FROM orders""")
def retry_schedule(spark, sf_dir):
    o = rel.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", O.retry_schedule((F.col("o_orderkey") % 5).cast("int")).alias("delays"))


# --- pages -------------------------------------------------------------------

_PAGE_SQL = """pg AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE (length(html) - length(replace(html, '<p>', ''))) // 3 END AS visible,
 CASE WHEN page_id % 15 = 0 THEN 0 ELSE (length(html) - length(replace(html, '<script>', ''))) // 8 END AS invisible,
 page_id % 10 = 0 AND page_id % 15 <> 0 AS image, page_id % 7 <> 0 AS complete FROM pages),
 k AS (SELECT page_id // 10 AS doc, page_id % 10 AS page_index, visible, invisible, CASE WHEN NOT complete THEN 'content' WHEN visible = 0 AND invisible = 0 AND NOT image THEN 'blank'
 WHEN visible = 0 AND image THEN 'scanned' ELSE 'content' END AS page_class FROM pg)"""


def _pages(spark, sf_dir):
    p = rel.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    p = p.select(
        k,
        F.when(k % 5 == 0, 0).otherwise(X.occurrences(F.col("html"), F.lit("<p>"))).alias("visible"),
        F.when(k % 15 == 0, 0).otherwise(X.occurrences(F.col("html"), F.lit("<script>"))).alias("invisible"),
        ((k % 10 == 0) & (k % 15 != 0)).alias("image"),
        (k % 7 != 0).alias("complete"),
    )
    return p.select(F.floor(k / 10).alias("doc"), (k % 10).alias("page_index"), "visible", "invisible", scan.page_class(F.col("complete"), F.col("visible"), F.col("invisible"), F.col("image")).alias("page_class"))


@query("WITH " + _PAGE_SQL + " SELECT doc, page_index, CAST(visible AS BIGINT) AS visible, CAST(invisible AS BIGINT) AS invisible, page_class FROM k")
def page_class(spark, sf_dir):
    return _pages(spark, sf_dir)


@query("WITH " + _PAGE_SQL + """ SELECT doc % 4 AS part, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (page_class = 'blank') AS BIGINT) AS blank, CAST(count(*) FILTER (page_class = 'scanned') AS BIGINT) AS scanned,
 CAST(count(*) FILTER (page_class = 'content') AS BIGINT) AS content, coalesce(list(page_index ORDER BY page_index) FILTER (page_class = 'scanned'), []) AS scanned_pages,
 count(*) - count(*) FILTER (page_class = 'blank') > 0 AND 5 * count(*) FILTER (page_class = 'scanned') >= 4 * (count(*) - count(*) FILTER (page_class = 'blank')) AS rejected FROM k GROUP BY 1""")
def scan_summary(spark, sf_dir):
    return scan.scan_summary(_pages(spark, sf_dir).withColumn("part", F.col("doc") % 4), ["part"])


@query("WITH " + _PAGE_SQL + """ SELECT page_index, 5 * count(*) FILTER (page_class = 'scanned') >= 4 * (count(*) - count(*) FILTER (page_class = 'blank')) AND count(*) > count(*) FILTER (page_class = 'blank') AS rejected FROM k GROUP BY 1""")
def scan_verdict(spark, sf_dir):
    k = _pages(spark, sf_dir).withColumnRenamed("page_index", "p").withColumn("page_index", F.col("doc"))
    return scan.scan_summary(k, ["p"]).select(F.col("p").alias("page_index"), "rejected")


# --- geometry ----------------------------------------------------------------

_PAIR_SQL = "WITH " + B_SQL + """, q AS (SELECT page, owner, "left" AS al, bottom AS ab, "right" AS ar, top AS a_t, "left" + owner % 7 AS bl, bottom + owner % 5 AS bb, "right" + owner % 11 AS br, top + owner % 3 AS bt FROM b),
 o AS (SELECT *, greatest(0.0, least(ar, br) - greatest(al, bl)) * greatest(0.0, least(a_t, bt) - greatest(ab, bb)) AS common, (ar - al) * (a_t - ab) AS aa, (br - bl) * greatest(bt - bb, 0) AS ba FROM q)
"""


def _shifted(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    k = F.col("owner")
    return b.select("page", "owner", *(F.col(c).alias("a_" + c) for c in ("left", "bottom", "right", "top")), (F.col("left") + k % 7).alias("b_left"), (F.col("bottom") + k % 5).alias("b_bottom"), (F.col("right") + k % 11).alias("b_right"), (F.col("top") + k % 3).alias("b_top"))


@query(_PAIR_SQL + "SELECT page, owner, CASE WHEN aa + ba - common = 0 THEN 1.0 ELSE round(common / (aa + ba - common), 6) END AS iou, al <= bl AND ar >= br AND ab <= bb AND a_t >= bt AS contained FROM o")
def rect_iou(spark, sf_dir):
    a, b = G.Rect.of("a_"), G.Rect.of("b_")
    return _shifted(spark, sf_dir).select("page", "owner", a.iou(b).alias("iou"), a.contains(b).alias("contained"))


@query(_PAIR_SQL + """, d AS (SELECT page, sqrt(pow(al - bl, 2) + pow(ab - bb, 2)) AS off, CASE WHEN aa + ba - common = 0 THEN 1.0 ELSE round(common / (aa + ba - common), 6) END AS iou, CASE WHEN owner % 4 > 0 THEN (owner % 9) / (owner % 4) END AS f0, owner FROM o)
 SELECT page, round(median(off), 6) AS median_offset_pt, round(median(iou), 6) AS median_iou, coalesce(round(median(CASE WHEN owner % 4 > 0 AND owner % 9 > 0 THEN CAST(owner % 9 AS DOUBLE) / (owner % 4) END), 6), 0.0) AS median_font_scale,
 CAST(count(*) FILTER (off > 1.0) + count(*) FILTER (iou < 0.8) AS BIGINT) AS drifted FROM d GROUP BY page""")
def layout_drift(spark, sf_dir):
    p = _shifted(spark, sf_dir).withColumns({"a_size": (F.col("owner") % 4).cast("double"), "b_size": (F.col("owner") % 9).cast("double")})
    return score.layout_drift(p, ["page"])


@query("WITH " + B_SQL + """ SELECT DISTINCT x.page, x.owner AS a, y.owner AS b FROM b x JOIN b y ON x.page = y.page AND x.owner <> y.owner AND x.top > y.bottom + 0.01 AND y.top > x.bottom + 0.01
 AND y."left" - x."right" >= -0.01 AND y."left" - x."right" <= 1.5 * greatest(x.top - x.bottom, y.top - y.bottom) + 0.01""")
def line_adjacency(spark, sf_dir):
    return spatial.line_neighbours(rel.boxes(spark, sf_dir), ["page"], "owner")


@query("WITH " + B_SQL + """ SELECT DISTINCT x.page, x.owner AS left_owner, y.owner AS right_owner FROM b x JOIN b y ON x.page = y.page AND x.owner < y.owner
 AND least(x."right", y."right") > greatest(x."left", y."left") AND least(x.top, y.top) > greatest(x.bottom, y.bottom)""")
def component_collisions(spark, sf_dir):
    return spatial.collisions(rel.boxes(spark, sf_dir), ["page"], "owner")


_POINT_SQL = """v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


def _points(spark, sf_dir, side):
    e = rel.table(spark, sf_dir, "embeddings")
    want = F.col("vec_id") % 2 == (0 if side == "l" else 1)
    return e.where(want).select(F.col("vec_id").alias(side + "id"), F.col("label").alias(side + "label"), F.col("embedding")[0].cast("double").alias(side + "x"), F.col("embedding")[1].cast("double").alias(side + "y"))


@query("WITH " + _POINT_SQL + """ SELECT l.vec_id AS lid, r.vec_id AS rid, l.label = r.label AS same FROM v l JOIN v r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND abs(l.x - r.x) <= 0.01 AND abs(l.y - r.y) <= 0.01""")
def band_join_matches(spark, sf_dir):
    m = spatial.band_join(_points(spark, sf_dir, "l"), _points(spark, sf_dir, "r"), [], 0.01)
    return m.select("lid", "rid", (F.col("llabel") == F.col("rlabel")).alias("same"))


@query("WITH " + _POINT_SQL + """, m AS (SELECT l.vec_id AS lid, r.vec_id AS rid, row_number() OVER (PARTITION BY l.vec_id ORDER BY sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)), r.vec_id) AS n
 FROM v l JOIN v r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND l.label = r.label AND abs(l.x - r.x) <= 0.05 AND abs(l.y - r.y) <= 0.05) SELECT lid, rid FROM m WHERE n = 1""")
def nearest_same_glyph(spark, sf_dir):
    l, r = _points(spark, sf_dir, "l").withColumnRenamed("llabel", "char"), _points(spark, sf_dir, "r").withColumnRenamed("rlabel", "char")
    return spatial.nearest_same(l, r, ["char"], 0.05).select("lid", "rid")


@query()
def greedy_match(spark, sf_dir):
    """Order-dependent one-to-one matching; tests compare it with a plain loop."""
    page = lambda side: _points(spark, sf_dir, side).withColumn("page", F.floor(F.col(side + "id") / 500))
    m = spatial.band_join(page("l"), page("r"), ["page"], 0.02)
    d = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    m = m.select("page", "lid", "rid", (F.col("llabel") != F.col("rlabel")).cast("int").alias("other"), d.alias("dist"))
    return spatial.greedy_matching(m, "page", ["other", "dist", "lid", "rid"])


@query("WITH " + _POINT_SQL + """, p AS (SELECT l.vec_id AS lid, r.vec_id AS rid FROM v l JOIN v r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND abs(l.x - r.x) <= 0.01 AND abs(l.y - r.y) <= 0.01)
 SELECT lid, rid FROM (SELECT *, count(*) OVER (PARTITION BY lid) AS a, count(*) OVER (PARTITION BY rid) AS b FROM p) WHERE a = 1 AND b = 1""")
def mutually_unique_candidates(spark, sf_dir):
    return R.mutually_unique(spatial.band_join(_points(spark, sf_dir, "l"), _points(spark, sf_dir, "r"), [], 0.01), "lid", "rid")


@query("WITH " + B_SQL + """, m AS (SELECT t.page, t.owner AS title, a.top AS anchor_top, a.owner AS anchor_ord, row_number() OVER (PARTITION BY t.page, t.owner ORDER BY a.top DESC, a.owner DESC) AS n
 FROM b t JOIN b a ON t.page = a.page AND t.owner % 10 = 1 AND a.owner % 10 = 2 AND a.top < t.bottom) SELECT page, title, anchor_top, anchor_ord FROM m WHERE n = 1""")
def nearest_lower_anchor(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    titles = b.where("owner % 10 = 1").select("page", F.col("owner").alias("title"), "bottom")
    return spatial.nearest_lower(titles, b.where("owner % 10 = 2").withColumnRenamed("owner", "ord"), ["page"])


@query("WITH " + B_SQL + """, r AS (SELECT page, owner, "left", bottom, "right", top, ("right" - "left") * (top - bottom) AS area FROM b WHERE owner % 10 = 1),
 m AS (SELECT c.page, c.owner AS char, r.owner AS region, row_number() OVER (PARTITION BY c.page, c.owner ORDER BY r.area, r.owner) AS n FROM b c JOIN r ON c.page = r.page AND c.owner % 10 <> 1
 AND least(c."right", r."right") > greatest(c."left", r."left") AND least(c.top, r.top) > greatest(c.bottom, r.bottom)) SELECT page, char, region FROM m WHERE n = 1""")
def layout_assignment(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    chars = b.where("owner % 10 <> 1").withColumnRenamed("owner", "char")
    regions = b.where("owner % 10 = 1").withColumnRenamed("owner", "ord").withColumn("label", F.lit("text"))
    return spatial.arbitrated(chars, regions, ["page"]).select("page", "char", "region")


@query("WITH " + B_SQL + """ SELECT page, min("left") AS "left", min(bottom) AS bottom, max("right") AS "right", max(top) AS top FROM b GROUP BY page""")
def union_bounds(spark, sf_dir):
    return rel.boxes(spark, sf_dir).groupBy("page").agg(*G.union_bounds())


@query("""WITH m AS (SELECT p_partkey, CAST(p_size % 5 - 1 AS DOUBLE) AS a, CAST(p_size % 3 - 1 AS DOUBLE) AS b, CAST(p_partkey % 4 - 1 AS DOUBLE) AS c, CAST(p_partkey % 7 + 1 AS DOUBLE) AS d FROM part)
 SELECT p_partkey, abs(a * d - b * c) <= 1e-12 AS singular, round(sqrt((a*a + b*b + c*c + d*d + sqrt(greatest(0.0, pow(a*a + b*b + c*c + d*d, 2) - 4 * pow(a*d - b*c, 2)))) / 2), 6) AS scale,
 CASE WHEN a * d - b * c < 0 THEN 'mirrored' WHEN abs(degrees(atan2(b, a))) > 0.1 THEN 'rotated' WHEN abs(degrees(atan2(c, d))) > 20 THEN 'skewed' ELSE 'upright' END AS kind FROM m""")
def text_transform(spark, sf_dir):
    p = rel.table(spark, sf_dir, "part")
    m = p.select("p_partkey", (F.col("p_size") % 5 - 1).cast("double").alias("a"), (F.col("p_size") % 3 - 1).cast("double").alias("b"), (F.col("p_partkey") % 4 - 1).cast("double").alias("c"), (F.col("p_partkey") % 7 + 1).cast("double").alias("d"))
    v = [F.col(x) for x in "abcd"]
    return m.select("p_partkey", G.singular(*v).alias("singular"), round6(G.largest_scale(*v)).alias("scale"), G.transform_kind(*v).alias("kind"))


# --- events ------------------------------------------------------------------


@query("WITH " + LOG_SQL + """, c AS (SELECT run, bool_or(event = 'result') AS terminal_result, count(*) FILTER (event = 'error' AND category = 'internal') AS internal_errors,
 count(*) FILTER (event = 'diagnostic' AND contains(id, 'retry')) AS retry_diagnostics, count(*) FILTER (status = 'hit') AS cache_hits, count(*) FILTER (status = 'miss') AS cache_misses,
 count(*) FILTER (event = 'translation_call') AS translation_calls, coalesce(sum(suspicious_echoes), 0) AS suspicious_echoes FROM g GROUP BY run)
 SELECT run, terminal_result, CAST(internal_errors AS BIGINT) AS internal_errors, CAST(retry_diagnostics AS BIGINT) AS retry_diagnostics, CAST(cache_hits AS BIGINT) AS cache_hits, CAST(cache_misses AS BIGINT) AS cache_misses,
 CAST(translation_calls AS BIGINT) AS translation_calls, CAST(suspicious_echoes AS BIGINT) AS suspicious_echoes, CAST(run % 3 * 4 AS BIGINT) AS eligible_paragraphs,
 CASE WHEN run % 3 > 0 THEN round(CAST(translation_calls AS DOUBLE) / (run % 3 * 4), 6) END AS calls_per_paragraph,
 CASE WHEN translation_calls > 0 THEN round(CAST(retry_diagnostics AS DOUBLE) / translation_calls, 6) END AS retry_rate,
 CASE WHEN run % 3 > 0 THEN round(CAST(suspicious_echoes AS DOUBLE) / (run % 3 * 4), 6) ELSE 0.0 END AS echo_rate,
 CASE WHEN cache_hits + cache_misses > 0 THEN round(CAST(cache_hits AS DOUBLE) / (cache_hits + cache_misses), 6) END AS cache_hit_rate FROM c""")
def process_metrics(spark, sf_dir):
    g = rel.log(spark, sf_dir)
    eligible = g.select("run").distinct().select("run", (F.col("run") % 3 * 4).cast("bigint").alias("eligible_paragraphs"))
    return E.process_metrics(g, eligible, ["run"])


@query("""WITH s AS (SELECT user_id AS run, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'stage_started' ELSE 'stage_finished' END AS event, CAST(event_id % 3 AS VARCHAR) AS stage FROM events),
 w AS (SELECT *, lead(event) OVER (PARTITION BY run, stage ORDER BY event_id) AS e, lead(event_id) OVER (PARTITION BY run, stage ORDER BY event_id) AS f FROM s)
 SELECT run, stage, event_id AS started, CASE WHEN e = 'stage_finished' THEN f END AS finished FROM w WHERE event = 'stage_started'""")
def event_stage_pairs(spark, sf_dir):
    e = rel.table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("run"), "event_id", F.when(F.col("event_type").isin("click", "view"), "stage_started").otherwise("stage_finished").alias("event"), (F.col("event_id") % 3).cast("string").alias("stage"))
    return E.stage_pairs(s, ["run"], "event_id")


@query("WITH " + LOG_SQL + """, t AS (SELECT run, count(*) FILTER (event = 'error') AS n, max(CASE WHEN event = 'error' THEN ordinal END) = max(ordinal) AS last FROM g GROUP BY run)
 SELECT run, CAST(n AS BIGINT) AS terminals, last, n = 1 AND last AS valid FROM t""")
def terminal_check(spark, sf_dir):
    return E.terminal_check(rel.log(spark, sf_dir), ["run"], "ordinal")


@query("WITH " + LOG_SQL + """, r AS (SELECT run AS doc, id, count(*) AS n, list(ordinal ORDER BY ordinal)[1:16] AS samples FROM g WHERE event = 'diagnostic' GROUP BY run, id)
 SELECT doc, id, CAST(n AS BIGINT) AS total, samples FROM r""")
def bounded_samples(spark, sf_dir):
    d = O.budgeted(rel.log(spark, sf_dir).where("event = 'diagnostic'").select(F.col("run").alias("doc"), "ordinal", "id"), ["doc"], "id", "ordinal", per_id=16, total=1 << 30, bypass=())
    return d.groupBy("doc", "id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("ordinal")))).alias("samples"))


# --- scores ------------------------------------------------------------------

_SCORE_SQL = """s AS (SELECT o_orderkey AS paper, CAST(o_orderkey % 6 AS INTEGER) AS dimension, CAST(o_orderkey * 7 % 50 AS DOUBLE) AS weighted, CAST(greatest(1, o_custkey * 13 % 4000) AS BIGINT) AS denominator FROM orders),
 d AS (SELECT *, round(least(100.0, greatest(0.0, 100.0 - weighted * 1000 / denominator)), 6) AS score FROM s)"""


def _scores(spark, sf_dir):
    o = rel.table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("paper"), (F.col("o_orderkey") % 6).cast("int").alias("dimension"), (F.col("o_orderkey") * 7 % 50).cast("double").alias("weighted"), F.greatest(F.lit(1), F.col("o_custkey") * 13 % 4000).cast("bigint").alias("denominator"))
    return score.scored(s)


@query("WITH " + _SCORE_SQL + " SELECT dimension, round(avg(score), 6) AS total, CAST(count(*) AS BIGINT) AS dimensions FROM d GROUP BY dimension")
def score_total(spark, sf_dir):
    return score.total(_scores(spark, sf_dir), ["dimension"])


@query("WITH " + _SCORE_SQL + " SELECT dimension, round(min(score), 6) AS min, round(quantile_cont(score, 0.1), 6) AS p10, round(median(score), 6) AS median, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY dimension")
def score_percentiles(spark, sf_dir):
    return score.distribution(_scores(spark, sf_dir), ["dimension"], "score")


@query("WITH " + _SCORE_SQL + " SELECT paper, score FROM d ORDER BY score, paper LIMIT 20")
def lowest_n(spark, sf_dir):
    return score.lowest(_scores(spark, sf_dir).select("paper", "score"), "score", ["paper"], 20)


@query("""WITH p AS (SELECT c_mktsegment AS producer, c_acctbal > 0 AS published, c_custkey % 2 AS ie, CAST(c_custkey * 7 % 90 AS BIGINT) AS preserved, c_nationkey % 3 AS iv FROM customer)
 SELECT producer, CAST(count(*) AS BIGINT) AS papers, CAST(count(*) FILTER (published) AS BIGINT) AS published, CAST(sum(ie) AS BIGINT) AS internal_errors, round(CAST(count(*) FILTER (published) AS DOUBLE) / count(*), 6) AS published_rate,
 median(preserved) AS median_preserved, max(preserved) AS worst_preserved, CAST(sum(iv) AS BIGINT) AS ink_violations FROM p GROUP BY GROUPING SETS ((), (producer))""")
def cluster_rollup(spark, sf_dir):
    c = rel.table(spark, sf_dir, "customer")
    return score.cluster_rollup(c.select(F.col("c_mktsegment").alias("producer"), (F.col("c_acctbal") > 0).alias("published"), (F.col("c_custkey") % 2).alias("internal_errors"), (F.col("c_custkey") * 7 % 90).alias("preserved"), (F.col("c_nationkey") % 3).alias("ink_violations")))


@query("""SELECT l_orderkey, CAST(sum((l_linenumber % 2) * 5 + (l_linenumber % 3) * 10 + (l_partkey % 2) * 5 + (l_suppkey % 4) * 10) AS DOUBLE) AS weighted FROM lineitem GROUP BY l_orderkey""")
def risk_weight(spark, sf_dir):
    g = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_linenumber") % 2).alias("w"), F.sum(F.col("l_linenumber") % 3).alias("p"), F.sum(F.col("l_partkey") % 2).alias("e"), F.sum(F.col("l_suppkey") % 4).alias("c"))
    zero = F.lit(0)
    return g.select("l_orderkey", score.risk_weight(F.col("w"), F.col("p"), F.col("e"), F.col("c"), zero, zero, zero, zero).alias("weighted"))


@query("""SELECT o_orderkey, round(CAST(o_orderkey % 2 AS DOUBLE) * 100 + (o_custkey % 10) / 100.0 * 10 + o_custkey % 3 * 10, 6) AS weighted FROM orders""")
def structural_dimension(spark, sf_dir):
    o = rel.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", round6(score.structural_weight(F.col("o_orderkey") % 2, (F.col("o_custkey") % 10) / 100.0, F.col("o_custkey") % 3)).alias("weighted"))


# --- trees -------------------------------------------------------------------


def _tree(spark, sf_dir):
    """A forest over customers: the parent of k is k // 3, roots are the customers below 3."""
    c = rel.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("node"), F.when(k >= 3, F.floor(k / 3)).alias("parent"), F.when((k % 5 == 0) | (k < 3), k * 10).alias("rotate"), k.alias("ord"))


_TREE_SQL = """n AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS parent, CASE WHEN c_custkey % 5 = 0 OR c_custkey < 3 THEN c_custkey * 10 END AS rotate FROM customer)"""


@query("WITH RECURSIVE " + _TREE_SQL + """, w(node, up, rotate, depth) AS (SELECT node, parent, rotate, 0 FROM n UNION ALL SELECT w.node, n.parent, n.rotate, w.depth + 1 FROM w JOIN n ON n.node = w.up WHERE w.rotate IS NULL)
 SELECT n.node, v.rotate, CAST(v.depth AS BIGINT) AS depth FROM n LEFT JOIN (SELECT node, rotate, depth FROM w WHERE rotate IS NOT NULL) v ON v.node = n.node""")
def inherit_first_defined(spark, sf_dir):
    return tree.inherited(_tree(spark, sf_dir), "rotate").select("node", "rotate", F.col("depth").cast("bigint").alias("depth"))


@query("WITH RECURSIVE " + _TREE_SQL + """, w(node, depth, path) AS (SELECT node, 0, [node] FROM n WHERE parent IS NULL UNION ALL SELECT n.node, w.depth + 1, list_append(w.path, n.node) FROM w JOIN n ON n.parent = w.node)
 SELECT node, depth, path FROM w""")
def outline_walk(spark, sf_dir):
    return tree.outline(_tree(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS caller, n_nationkey * 3 % 25 AS callee FROM nation UNION SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey % 4 = 0),
 w(node, depth, path, cycle) AS (SELECT n_nationkey, 0, [n_nationkey], CAST(NULL AS VARCHAR) FROM nation WHERE n_nationkey % 6 = 1
 UNION ALL SELECT e.callee, w.depth + 1, list_append(w.path, e.callee), CASE WHEN e.callee = w.node THEN 'self' WHEN list_contains(w.path, e.callee) THEN 'mutual' END FROM w JOIN e ON e.caller = w.node WHERE w.cycle IS NULL)
 SELECT node, depth, cycle FROM w""")
def form_call_graph(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    edges = n.select(F.col("k").alias("caller"), (F.col("k") * 3 % 25).alias("callee")).union(n.where("k % 4 = 0").select("k", F.floor(F.col("k") / 2).cast("int"))).distinct()
    return tree.call_graph(edges, n.where("k % 6 = 1").select(F.col("k").alias("node")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS page, p_partkey + 1000 AS new FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 3 <> 0""")
def reference_remap(spark, sf_dir):
    refs = rel.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("page"))
    return tree.remapped(refs, rel.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000).alias("new"))).select("l_orderkey", "l_linenumber", "page", "new")


@query("WITH " + B_SQL + """, t AS (SELECT page, min(bottom) AS tb FROM b WHERE owner % 10 = 1 GROUP BY 1), a AS (SELECT page, min(top) AS at_, median(top - bottom) AS size FROM b WHERE owner % 10 = 2 GROUP BY 1),
 z AS (SELECT page, CASE WHEN at_ < tb + 300 AND size > 0 THEN at_ - 0.5 * size END AS lower, CASE WHEN at_ < tb + 300 AND size > 0 THEN tb + 300 + 0.5 * size END AS upper FROM t JOIN a USING (page))
 SELECT b.page, b.owner, b."left", coalesce(b.bottom >= z.lower - 0.01 AND b.top <= z.upper + 0.01, false) AS author FROM b JOIN z USING (page) WHERE b.owner % 10 > 2""")
def author_band(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    t = b.where("owner % 10 = 1").groupBy("page").agg((F.min("bottom") + 300).alias("tb"))
    a = b.where("owner % 10 = 2").groupBy("page").agg(F.min("top").alias("at"), F.median(F.col("top") - F.col("bottom")).alias("size"))
    z = t.join(a, "page").select("page", G.author_band(F.col("tb"), F.col("at"), F.col("size")).alias("band"))
    return b.where("owner % 10 > 2").join(z, "page").select("page", "owner", "left", G.in_band(F.col("band"), F.col("bottom"), F.col("top")).alias("author"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 600 - y WHEN p_partkey % 4 = 2 THEN 600 - x WHEN p_partkey % 4 = 3 THEN y ELSE x END AS px,
 CASE WHEN p_partkey % 4 = 1 THEN x WHEN p_partkey % 4 = 2 THEN 800 - y WHEN p_partkey % 4 = 3 THEN 800 - x ELSE y END AS py, x > 10 AND x < 40 AND y > 10 AND y < 40 AND x + y < 70 AS inside
 FROM (SELECT p_partkey, p_partkey * 7 % 51 + 0.5 AS x, p_partkey * 11 % 51 + 0.25 AS y FROM part)""")
def page_coordinates(spark, sf_dir):
    k = F.col("p_partkey")
    p = rel.table(spark, sf_dir, "part").select(k, (k * 7 % 51 + 0.5).cast("double").alias("x"), (k * 11 % 51 + 0.25).cast("double").alias("y"))
    q = G.view_to_page(F.lit(600.0), F.lit(800.0), (k % 4 * 90).cast("int"), F.col("x"), F.col("y"))
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    shape = F.array(corner(10, 10), corner(40, 10), corner(40, 30), corner(30, 40), corner(10, 40))
    return p.select("p_partkey", q["x"].alias("px"), q["y"].alias("py"), G.inside(shape, F.col("x"), F.col("y")).alias("inside"))
