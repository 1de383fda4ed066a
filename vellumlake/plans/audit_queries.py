"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumlake.functions import text as X
from vellumlake.operators import audit as A
from vellumlake.operators import relational as R
from vellumlake.operators import spatial
from vellumlake.plans import relations as rel
from vellumlake.plans.relations import B_SQL, P_SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def glyph_matching(spark, sf_dir):
    """First unmatched in trace order; tests compare it with a plain loop."""
    li = rel.table(spark, sf_dir, "lineitem")
    base = li.select(F.floor(F.col("l_orderkey") / 64).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % 26).cast("int").alias("char"), (F.col("l_partkey") % 40 / 4).alias("x"), (F.col("l_suppkey") % 40 / 4).alias("y"))
    left = base.where("k % 2 = 0").select("page", "char", F.col("k").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = base.where("k % 2 = 1").select("page", "char", F.col("k").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return A.glyph_matches(left, right, "page")


@query("WITH " + B_SQL + """, o AS (SELECT * FROM b WHERE owner % 10 <> 3), i AS (SELECT * FROM b WHERE owner % 10 = 3)
 SELECT i.page, i.owner AS ink, min(o.owner) AS first_glyph FROM o JOIN i ON o.page = i.page AND o.owner // 10 <> i.owner // 10
 AND least(o."right", i."right") > greatest(o."left", i."left") AND least(o.top, i.top) > greatest(o.bottom, i.bottom)
 AND NOT (o."left" >= i."left" AND o."right" <= i."right" AND o.bottom >= i.bottom AND o.top <= i.top) GROUP BY i.page, i.owner""")
def retained_ink_conflicts(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    box = ["left", "bottom", "right", "top"]
    g = b.where("owner % 10 <> 3").select("page", F.col("owner").alias("ord"), F.floor(F.col("owner") / 10).alias("owner"), *box, *(F.col(c).alias("c" + c) for c in box))
    i = b.where("owner % 10 = 3").select("page", F.col("owner").alias("id"), F.floor(F.col("owner") / 10).alias("owner"), *box)
    return A.retained_conflicts(g, i, ["page"])


@query("WITH " + B_SQL + """, a AS (SELECT page, owner AS id, owner // 10 AS unit, owner % 3 AS kind, "left", bottom, "right", top FROM b),
 z AS (SELECT page, kind, "left" + (id % 4) * 0.02 AS "left", bottom, "right" + (id % 4) * 0.02 AS "right", top FROM a WHERE id % 2 = 0), m AS (SELECT DISTINCT page, unit FROM a WHERE unit % 3 = 0)
 SELECT DISTINCT a.page, a.unit, a.id FROM a JOIN z ON a.page = z.page AND a.kind = z.kind AND abs(a."left" - z."left") <= 0.05 AND abs(a.bottom - z.bottom) <= 0.05 AND abs(a."right" - z."right") <= 0.05 AND abs(a.top - z.top) <= 0.05
 SEMI JOIN m ON m.page = a.page AND m.unit = a.unit""")
def orphan_source_ink(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    a = b.select("page", F.col("owner").alias("id"), F.floor(F.col("owner") / 10).alias("unit"), (F.col("owner") % 3).alias("kind"), "left", "bottom", "right", "top")
    z = a.where("id % 2 = 0").withColumns({"left": F.col("left") + (F.col("id") % 4) * 0.02, "right": F.col("right") + (F.col("id") % 4) * 0.02}).drop("unit")
    return A.orphan_ink(a, z, a.where("unit % 3 = 0"), ["page"]).select("page", "unit", "id")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS replays, CAST(count(*) FILTER (l_quantity > 25) AS BIGINT) AS filled, count(*) = 1 AND count(*) FILTER (l_quantity > 25) = 1 AS valid FROM lineitem GROUP BY 1""")
def formula_group_validation(spark, sf_dir):
    return A.formula_groups(rel.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - 25).alias("glyphs")), ["l_orderkey"])


@query("""WITH w AS (SELECT vec_id % 10 AS page, vec_id FROM embeddings WHERE vec_id % 3 <> 0), e AS (SELECT vec_id % 10 AS page, vec_id, label FROM embeddings WHERE vec_id % 4 <> 0),
 m AS (SELECT w.page, count(*) AS matched, count(*) FILTER (label % 2 = 0) AS same_code FROM w JOIN e USING (page, vec_id) GROUP BY 1), x AS (SELECT page, count(*) AS n FROM w GROUP BY 1), y AS (SELECT page, count(*) AS n FROM e GROUP BY 1)
 SELECT page, CAST(x.n AS BIGINT) AS walked, CAST(y.n AS BIGINT) AS engine, CAST(matched AS BIGINT) AS matched, CAST(same_code AS BIGINT) AS same_code, CAST(x.n - matched AS BIGINT) AS walk_only, CAST(y.n - matched AS BIGINT) AS engine_only
 FROM x JOIN y USING (page) JOIN m USING (page)""")
def alignment_counters(spark, sf_dir):
    e = rel.table(spark, sf_dir, "embeddings").withColumn("page", F.col("vec_id") % 10)
    w, g = e.where("vec_id % 3 <> 0"), e.where("vec_id % 4 <> 0")
    m = w.select("page", "vec_id").join(g.select("page", "vec_id", (F.col("label") % 2 == 0).alias("same")), ["page", "vec_id"])
    return A.alignment_counts(w, g, m, ["page"])


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey AS l, l_orderkey + l_linenumber % 2 AS r FROM lineitem),
 u AS (SELECT l, r FROM (SELECT *, count(*) OVER (PARTITION BY l) AS a, count(*) OVER (PARTITION BY r) AS b FROM c) WHERE a = 1 AND b = 1) SELECT l, r FROM u""")
def unique_candidates(spark, sf_dir):
    c = rel.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("l"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("r"))
    return R.mutually_unique(c, "l", "r")


@query()
def supported_alignment(spark, sf_dir):
    """Repeated to a fixpoint; tests compare it with a plain loop."""
    e = rel.table(spark, sf_dir, "events")
    c = e.select(F.col("event_id").alias("l"), (F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).alias("r"))
    return A.supported_pairs(c, c.where("l % 100 = 1"), 1)


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS matched FROM events), g AS (SELECT *, sum(CAST(matched AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
 SELECT user_id, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n FROM g WHERE NOT matched GROUP BY user_id, g HAVING count(*) >= 2""")
def unmatched_runs(spark, sf_dir):
    e = rel.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("matched"))
    return A.unmatched_runs(e, ["user_id"], "event_id", 2)


@query("WITH " + P_SQL + r""", l AS (SELECT doc_id, reading_order, regexp_replace(src, '\s+', '', 'g') AS a, lead(regexp_replace(src, '\s+', '', 'g')) OVER (PARTITION BY doc_id ORDER BY reading_order) AS b FROM p),
 r AS (SELECT doc_id, reading_order AS start, 1 AS lines, a AS key FROM l UNION ALL SELECT doc_id, reading_order, 2, a || b FROM l WHERE b IS NOT NULL),
 f AS (SELECT doc_id, reading_order AS unit, a || coalesce(b, '') AS key FROM l WHERE reading_order % 3 = 1)
 SELECT doc_id, unit, x.start, x.lines FROM (SELECT f.doc_id, f.unit, min({'start': r.start, 'lines': r.lines}) AS x FROM f JOIN r ON f.doc_id = r.doc_id AND f.key = r.key GROUP BY 1, 2)""")
def formula_on_lines(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir)
    runs = A.line_concatenations(p, ["doc_id"], "reading_order", "src", 2)
    one = runs.where("lines = 1").withColumnRenamed("start", "unit").select("doc_id", "unit", F.col("key").alias("k1"))
    two = runs.where("lines = 2").select("doc_id", F.col("start").alias("unit"), F.col("key").alias("k2"))
    f = one.join(two, ["doc_id", "unit"], "left").where("unit % 3 = 1").select("doc_id", "unit", F.coalesce("k2", "k1").alias("key"))
    return A.found_on_lines(f, runs, ["doc_id"])


@query("WITH " + B_SQL + """, u AS (SELECT page, owner AS unit, "left", "right" FROM b WHERE owner % 10 = 1), f AS (SELECT page, "left" AS fl, "right" AS fr FROM b WHERE owner % 10 = 2)
 SELECT page, unit, min(CASE WHEN fr <= "left" THEN "left" - fr END) AS gap_left, min(CASE WHEN fl >= "right" THEN fl - "right" END) AS gap_right FROM u JOIN f USING (page) GROUP BY page, unit""")
def formula_neighbour_gaps(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    return A.neighbour_gaps(b.where("owner % 10 = 1").select("page", F.col("owner").alias("unit"), "left", "right"), b.where("owner % 10 = 2").select("page", "left", "right"), ["page"])


@query("WITH " + B_SQL + """, t AS (SELECT DISTINCT page, owner, "left", bottom, "right", top, CASE owner % 5 WHEN 0 THEN '。x' WHEN 1 THEN 'x（' ELSE 'xx' END AS text FROM b),
 n AS (SELECT x.page, x.owner AS a, y.owner AS c FROM t x JOIN t y ON x.page = y.page AND x.owner <> y.owner AND x.top > y.bottom + 0.01 AND y.top > x.bottom + 0.01
 AND y."left" - x."right" >= -0.01 AND y."left" - x."right" <= 1.5 * greatest(x.top - x.bottom, y.top - y.bottom) + 0.01)
 SELECT DISTINCT page, owner FROM t WHERE (text = '。x' AND NOT EXISTS (SELECT 1 FROM n WHERE n.page = t.page AND n.c = t.owner)) OR (text = 'x（' AND NOT EXISTS (SELECT 1 FROM n WHERE n.page = t.page AND n.a = t.owner))""")
def kinsoku_lines(spark, sf_dir):
    t = rel.boxes(spark, sf_dir).distinct().withColumn("text", F.expr("CASE owner % 5 WHEN 0 THEN '。x' WHEN 1 THEN 'x（' ELSE 'xx' END"))
    return A.kinsoku_lines(t, ["page"])


@query("""WITH a AS (SELECT conv_id, unnest(string_split(text, '')) AS token FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, unnest(string_split(text, '')) AS token FROM conversations WHERE role = 'user' AND conv_id % 3 > 0),
 x AS (SELECT conv_id, token, count(*) AS n FROM a WHERE token <> '' GROUP BY ALL), y AS (SELECT conv_id, token, count(*) AS n FROM b WHERE token <> '' GROUP BY ALL)
 SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, bool_and(coalesce(x.n, 0) = coalesce(y.n, 0)) AS equal FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.token = y.token GROUP BY 1""")
def glyph_histogram_equality(spark, sf_dir):
    c = rel.table(spark, sf_dir, "conversations").where("role = 'user'")
    h = lambda d: R.multiset(d, ["conv_id"], X.characters(F.col("text")))
    return A.same_histogram(h(c), h(c.where("conv_id % 3 > 0")), ["conv_id"])


@query("""SELECT lang, sha256(text) AS build, count(DISTINCT source) = 1 AS deterministic, CAST(count(*) AS BIGINT) AS builds FROM documents GROUP BY 1, 2""")
def determinism_verdict(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents").select("lang", X.sha256_text(F.col("text")).alias("build"), "source")
    return A.determinism(d, ["lang", "build"], "source")


@query("""SELECT n.n_nationkey AS k, n.n_nationkey + 1 AS peer, m.n_regionkey IS NOT NULL AND n.n_regionkey = m.n_regionkey AS ok FROM nation n LEFT JOIN nation m ON m.n_nationkey = n.n_nationkey + 1""")
def group_peers(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    return A.peers(n, n.select("k", (F.col("k") + 1).alias("peer")), "k", "n_regionkey", True)


@query("""WITH c AS (SELECT p_partkey AS child, p_partkey - 1 AS parent, CAST(p_partkey % 5 AS INTEGER) AS at_, p_name FROM part)
 SELECT child, parent, coalesce((SELECT left(q.p_name, c.at_) || 'Z' || substr(q.p_name, c.at_ + 3) FROM part q WHERE q.p_partkey = c.parent) = left(d, 99), false) AS ok
 FROM (SELECT c.*, CASE WHEN child % 2 = 0 THEN left(q.p_name, at_) || 'Z' || substr(q.p_name, at_ + 3) ELSE c.p_name END AS d FROM c LEFT JOIN part q ON q.p_partkey = c.parent) c""")
def fixture_lineage(spark, sf_dir):
    p = rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    c = p.select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"), (F.col("id") % 5).cast("int").alias("at"), F.lit(2).alias("removed"), F.lit("Z").alias("inserted"), F.col("text").alias("own"))
    made = c.join(p.select(F.col("id").alias("parent"), F.col("text").alias("_q")), "parent", "left")
    text = F.when(F.col("child") % 2 == 0, F.concat(F.substr("_q", F.lit(1), F.col("at")), F.lit("Z"), F.substr(F.col("_q"), F.col("at") + 3))).otherwise(F.col("own"))
    return A.lineage(made.select("child", "parent", "at", "removed", "inserted", text.alias("text")), p)


@query("""SELECT c_nationkey, bool_and(c_acctbal > -500) AS passed, CAST(count(*) FILTER (NOT c_acctbal > -500) AS BIGINT) AS failed FROM customer GROUP BY 1""")
def audit_rollup(spark, sf_dir):
    return A.rolled_up(rel.table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") > -500).alias("ok")), ["c_nationkey"])


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'flag' END, CASE WHEN o_orderkey % 3 = 1 THEN 'env' END, 'default') AS setting FROM orders""")
def setting_precedence(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", A.preferred(F.when(k == 0, "flag"), F.when(k == 1, "env"), F.lit("default")).alias("setting"))


@query("""SELECT c_mktsegment, CAST(c_nationkey % 5 AS INTEGER) AS font_slot, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY ALL""")
def font_slot_attribution(spark, sf_dir):
    return A.font_slots(rel.table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_nationkey") % 5).cast("int").alias("font_slot")), ["c_mktsegment"])


@query("""WITH g AS (SELECT l_orderkey AS unit, l_linenumber AS glyph, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), src AS (SELECT unit, glyph, CAST(p % 100 AS DOUBLE) AS x, CAST(s % 100 AS DOUBLE) AS y FROM g),
 h AS (SELECT unit, glyph, x + 2 + CASE WHEN unit % 3 = 0 THEN glyph ELSE 0 END - x AS dx, y + 1 - y AS dy FROM src), c AS (SELECT unit, dx, dy, count(DISTINCT glyph) AS c FROM h GROUP BY ALL), n AS (SELECT unit, count(DISTINCT glyph) AS n FROM src GROUP BY 1)
 SELECT unit, dx, dy FROM c JOIN n USING (unit) WHERE c = n""")
def rigid_bodies(spark, sf_dir):
    """Units whose glyphs all moved by one offset; tests compare it with a plain search, too."""
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    src = li.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("glyph"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("char"), (F.col("p") % 100).cast("double").alias("x"), (F.col("s") % 100).cast("double").alias("y"))
    dst = src.select("char", (F.col("x") + 2 + F.when(F.col("unit") % 3 == 0, F.col("glyph")).otherwise(0)).alias("tx"), (F.col("y") + 1).alias("ty"))
    return spatial.rigid_deltas(src, dst, "unit")
