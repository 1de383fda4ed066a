"""Queries of single measures and readers over small relations that the tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumlake.functions import geometry as G
from vellumlake.functions import text as X
from vellumlake.functions.numeric import glyph_width, round6
from vellumlake.operators import audit as A
from vellumlake.operators import events as E
from vellumlake.operators import scan, score
from vellumlake.plans import relations as rel
from vellumlake.plans.formula_queries import _TYPED_SQL, _typed
from vellumlake.plans.relations import B_SQL, P_SQL
from vellumlake.plans.structure_queries import _SCORE_SQL, _scores
from vellumlake.sources import pdf_content, readers, sinks
from vellumlake.sources import schemas as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- texts -----------------------------------------------------------------------


@query("WITH " + _TYPED_SQL + r""", e AS (SELECT item_id, pos, CASE WHEN pos % 23 <> 0 THEN unicode END AS unicode, implicit_space_before FROM ch WHERE pos > item_id % 10), k AS (SELECT *, lag(unicode) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM e WHERE unicode IS NOT NULL)
 SELECT item_id, string_agg(CASE WHEN implicit_space_before AND NOT coalesce(regexp_matches(b, '\s'), false) AND NOT regexp_matches(unicode, '\s') THEN ' ' ELSE '' END || unicode, '' ORDER BY pos) AS source, string_agg(unicode, '' ORDER BY pos) AS plain FROM k GROUP BY item_id""")
def source_texts(spark, sf_dir):
    c = _typed(spark, sf_dir).where("pos > item_id % 10").withColumn("unicode", F.when(F.col("pos") % 23 != 0, F.col("unicode")))
    rows = c.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "unicode", "implicit_space_before"))).alias("c"))
    return rows.select("item_id", X.source_text(F.col("c")).alias("source"), X.plain_text(F.col("c")).alias("plain"))


@query("WITH " + P_SQL + r" SELECT lang, CAST(greatest(1, sum(length(regexp_replace(src, '\s', '', 'g')))) AS BIGINT) AS denominator FROM p GROUP BY lang")
def lint_denominator(spark, sf_dir):
    return rel.paragraphs(spark, sf_dir).groupBy("lang").agg(score.denominator(F.col("src")).cast("bigint").alias("denominator"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN 'A' ELSE NULL END AS char FROM part""")
def glyph_characters(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "A.alt").when(k == 1, "f_i").when(k == 2, "space").when(k == 3, ".notdef").when(k == 4, "A").otherwise("control")
    table = F.create_map(*(F.lit(x) for x in ("A", "A", "space", " ", "f_i", "x", "control", "\u0001")))
    return rel.table(spark, sf_dir, "part").select("p_partkey", X.glyph_character(name, table).alias("char"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'u' END WHEN c_custkey % 3 = 0 THEN 'c' ELSE 'e' END AS text, c_custkey % 700 BETWEEN 1 AND 600 AS timeout_ok,
 CASE WHEN c_custkey % 5 = 0 THEN 'typeset_overflow' ELSE 'policy' END AS reason, '11.' || c_custkey AS version FROM customer""")
def decoding_and_settings(spark, sf_dir):
    k = F.col("c_custkey")
    has = k % 2 == 0
    text = X.decoded(has, F.when(k % 4 == 0, "u"), F.when(k % 3 == 0, "c"), F.lit("e"))
    reason = readers.preserved_reason(F.when(k % 5 == 0, '{"reason":"typeset_overflow"}').otherwise("policy"))
    out = F.concat(F.lit("\n tool 7\nqpdf version 11."), k.cast("string"), F.lit(", rest 3\n"))
    return rel.table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), X.valid_timeout(k % 700).alias("timeout_ok"), reason.alias("reason"), X.version_of(out, "qpdf").alias("version"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 4 = 2 AS complete FROM customer""")
def evidence_completeness(spark, sf_dir):
    k = F.col("c_custkey")
    good = F.upper(F.sha2(k.cast("string"), 256))
    tokens = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("string").alias("token"), i.alias("occurrences")))
    e = F.struct(F.when(k % 3 != 0, good).otherwise(F.substring(good, 1, 63)).alias("request_sha256"), good.alias("response_sha256"), F.lit(2).alias("source_token_types"), F.lit(3).alias("target_token_types"), tokens((k % 4).cast("int") + F.when(k % 4 == 0, 1).otherwise(0)).alias("source_tokens"), tokens(F.lit(3)).alias("target_tokens"))
    return rel.table(spark, sf_dir, "customer").select("c_custkey", e.alias("e")).select("c_custkey", readers.evidence_complete(F.col("e")).alias("complete"))


@query("""WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, bool_or(l_orderkey % 4 = 1 AND l_linenumber = 2) AS moved, count(*) AS n FROM li GROUP BY 1)
 SELECT l_orderkey, NOT moved AND l_orderkey % 3 <> 1 AS same FROM c""")
def paragraph_identity(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    c = lambda size: F.struct("l_linenumber", F.chr(97 + F.col("p") % 26).alias("unicode"), size.alias("size"), F.when(F.col("p") % 2 == 0, F.col("p")).alias("object"))
    moved = F.when((F.col("l_orderkey") % 4 == 1) & (F.col("l_linenumber") == 2), 9.5).otherwise(9.0)
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(c(F.lit(9.0)))).alias("a"), F.array_sort(F.collect_list(c(moved))).alias("b"))
    k = F.col("l_orderkey") % 3
    said = F.when(k == 1, "other words").when(k == 2, F.concat(F.lit(" "), X.plain_text(F.col("a"))))
    return rows.select("l_orderkey", X.paragraph_identity(F.col("a"), F.col("b"), said).alias("same"))


# --- pages -----------------------------------------------------------------------


@query("WITH " + P_SQL + """, q AS (SELECT doc_id, reading_order // 5 AS page_index, CASE reading_order % 3 WHEN 0 THEN 'unsupported_font' ELSE 'typeset_overflow' END AS reason FROM p WHERE reading_order % 2 = 0),
 r AS (SELECT doc_id, list(reason || '=' || n ORDER BY reason || '=' || n) AS reasons FROM (SELECT doc_id, reason, count(*) AS n FROM q GROUP BY ALL) GROUP BY 1)
 SELECT doc_id, CAST(count(DISTINCT page_index) AS INTEGER) AS pages, CAST(count(*) AS BIGINT) AS paragraphs, CAST(least(16, count(*)) AS INTEGER) AS samples, reasons FROM q JOIN r USING (doc_id) GROUP BY doc_id, reasons""")
def degradation_summary(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir).where("reading_order % 2 = 0")
    q = p.select("doc_id", F.floor(F.col("reading_order") / 5).alias("page_index"), "reading_order", F.when(F.col("reading_order") % 3 == 0, "unsupported_font").otherwise("typeset_overflow").alias("reason"))
    return E.degradation_summary(q, ["doc_id"]).select("doc_id", F.size("pages").alias("pages"), "paragraphs", F.size("samples").alias("samples"), "reasons")


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (l_partkey % 3 = 0) = count(*) THEN 'form_only' WHEN count(*) FILTER (l_partkey % 3 = 0) > 0 THEN 'mixed' ELSE 'page' END AS ownership FROM lineitem GROUP BY 1""")
def form_ownership(spark, sf_dir):
    return scan.ownership(rel.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3 == 0).alias("in_form")), ["l_orderkey"])


@query("""SELECT l_orderkey // 64 AS page, CAST(count(*) FILTER (l_linenumber <> 4 AND l_partkey % 8 NOT IN (3, 7) AND l_suppkey % 5 <> 0) AS BIGINT) AS visible, CAST(count(*) FILTER (l_linenumber <> 4 AND (l_partkey % 8 IN (3, 7) OR l_suppkey % 5 = 0)) AS BIGINT) AS invisible,
 bool_or(l_linenumber = 4) AS image, bool_and(l_partkey % 97 <> 0) AS complete FROM lineitem GROUP BY 1""")
def show_evidence(spark, sf_dir):
    li = rel.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("page"), F.when(F.col("l_linenumber") == 4, "image").otherwise("text").alias("kind"), (F.col("l_partkey") % 8).alias("render_mode"), (F.col("l_suppkey") % 5 == 0).alias("clipped"), (F.col("l_partkey") % 97 != 0).alias("balanced"))
    return scan.page_evidence(li, ["page"])


@query("WITH " + B_SQL + """, g AS (SELECT page, CASE WHEN owner % 3 > 0 THEN "left" % 23 END AS a, CASE WHEN owner % 4 > 0 THEN bottom % 19 END AS b, top - bottom AS h FROM b), e AS (SELECT a AS gap, h FROM g UNION ALL SELECT b, h FROM g)
 SELECT CAST(count(*) AS BIGINT) AS holes, round(sum(gap * h), 6) AS area FROM e WHERE gap > 7.5""")
def continuity_holes(spark, sf_dir):
    b = rel.boxes(spark, sf_dir)
    gaps = b.select(F.when(F.col("owner") % 3 > 0, F.col("left") % 23).alias("gap_left"), F.when(F.col("owner") % 4 > 0, F.col("bottom") % 19).alias("gap_right"), (F.col("top") - F.col("bottom")).alias("h"))
    return A.holes(gaps, F.lit(7.5), F.col("h"))


@query("WITH " + B_SQL + """, m AS (SELECT page, owner, "left" AS l, bottom AS b, "right" AS r, top AS t, owner % 3 - 1.0 AS m0, owner % 5 - 2.0 AS m1, owner % 7 - 3.0 AS m2, owner % 2 + 0.5 AS m3 FROM b),
 k AS (SELECT page, owner, l * m0 + b * m2 + 1 AS x1, l * m0 + t * m2 + 1 AS x2, r * m0 + b * m2 + 1 AS x3, r * m0 + t * m2 + 1 AS x4, l * m1 + b * m3 + 2 AS y1, l * m1 + t * m3 + 2 AS y2, r * m1 + b * m3 + 2 AS y3, r * m1 + t * m3 + 2 AS y4 FROM m)
 SELECT page, owner, round(CAST(least(x1, x2, x3, x4) AS DOUBLE), 6) AS "left", round(CAST(least(y1, y2, y3, y4) AS DOUBLE), 6) AS bottom, round(CAST(greatest(x1, x2, x3, x4) AS DOUBLE), 6) AS "right", round(CAST(greatest(y1, y2, y3, y4) AS DOUBLE), 6) AS top FROM k""")
def transformed_boxes(spark, sf_dir):
    k = F.col("owner")
    m = F.array(k % 3 - 1.0, k % 5 - 2.0, k % 7 - 3.0, k % 2 + 0.5, F.lit(1.0), F.lit(2.0))
    r = G.transformed(m, G.Rect.of(""))
    return rel.boxes(spark, sf_dir).select("page", "owner", *(round6(getattr(r, c)).alias(c) for c in ("left", "bottom", "right", "top")))


@query("""SELECT p_partkey AS document, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS equal, CAST(2 AS BIGINT) AS compared FROM part WHERE p_partkey % 4 > 0
 UNION ALL SELECT p_partkey, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM part WHERE p_partkey % 4 = 0""")
def pixel_fidelity(spark, sf_dir):
    k = F.col("p_partkey")
    image = lambda last: F.concat(F.lit("P6 2 1 255\nabc"), last).cast("binary")
    mask = F.when(k % 4 == 0, F.array(F.array(F.lit(1), F.lit(0), F.lit(2), F.lit(1)))).otherwise(F.array().cast("array<array<int>>"))
    p = rel.table(spark, sf_dir, "part").select(k.cast("string").alias("document"), F.lit(0).alias("page_index"), image(F.lit("xyz")).alias("a"), image(F.when(k % 3 == 0, "xyz").otherwise("xyw")).alias("b"), mask.alias("mask"))
    return pdf_content.pixel_fidelity(p).select(F.col("document").cast("bigint").alias("document"), "equal", "compared")


# --- readers and sinks -----------------------------------------------------------


@query("""SELECT p_partkey AS document, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'a' WHEN 1 THEN NULL ELSE 'z' END AS unicode, pos <> 2 AS visible, pos = 2 AS implicit_space_before, CAST(p_size AS DOUBLE) AS font_size, CASE WHEN p_partkey % 2 = 0 THEN 'unsupported_font' END AS preserved FROM part, (VALUES (0), (1), (2)) t(pos)""")
def snapshot_characters(spark, sf_dir):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    chars = F.concat(F.lit('[{"unicode":"a","font_size":'), size, F.lit('},{"font_size":'), size, F.lit('},{"unicode":"z","visible":false,"implicit_space_before":true,"font_size":'), size, F.lit("}]"))
    doc = F.concat(F.lit('{"schema_version":1,"pages":[{"index":3,"geometry":{"width":9,"height":9,"rotate_degrees":0},"paragraphs":[{"reading_order":5,'), F.when(k % 2 == 0, '"preserved":"{\\"reason\\":\\"unsupported_font\\"}",').otherwise(""), F.lit('"text":{"kind":"chars","chars":'), chars, F.lit("}}]}]}"))
    d = rel.table(spark, sf_dir, "part").select(k.alias("document"), F.from_json(doc, S.DOCUMENT).alias("d")).select("document", "d.*")
    p = readers.paragraphs(d)
    c = readers.characters(p).select("document", "pos", "unicode", "visible", "implicit_space_before", "font_size")
    return c.join(p.select("document", "preserved"), "document")


@query("""SELECT p_partkey AS document, CAST(0 AS INTEGER) AS page_index, p_partkey + 7 AS object FROM part UNION ALL SELECT p_partkey, 1, p_partkey + x FROM part, (VALUES (8), (9)) t(x)""")
def page_content_objects(spark, sf_dir):
    k = F.col("p_partkey")
    ref = lambda n: F.concat(F.lit('"'), (k + n).cast("string"), F.lit(' 0 R"'))
    report = F.concat(F.lit('{"pages":[{"contents":'), ref(7), F.lit('},{"contents":['), ref(8), F.lit(","), ref(9), F.lit("]}]}"))
    return readers.content_objects(rel.table(spark, sf_dir, "part").select(k.alias("document"), report.alias("value")))


@query("""SELECT p_partkey, p_partkey + x AS object, p_partkey * 10 + x AS offset FROM part, (VALUES (1), (2)) t(x)""")
def xref_offsets(spark, sf_dir):
    k = F.col("p_partkey")
    line = lambda n: F.concat((k + n).cast("string"), F.lit("/0: uncompressed; offset = "), (k * 10 + n).cast("string"), F.lit("\n"))
    report = F.concat(line(1), F.lit("5/0: compressed; stream = 4, index = 0\n"), line(2))
    p = rel.table(spark, sf_dir, "part").select("p_partkey", F.explode(readers.xref_offsets(report)).alias("x"))
    return p.select("p_partkey", "x.object", "x.offset")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new2' END AS v FROM customer""")
def key_value_insert(spark, sf_dir):
    c = rel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    store = c.where("k % 3 = 0").withColumn("v", F.lit("old"))
    new = c.withColumn("o", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.concat(F.lit("new"), F.col("o").cast("string")))
    return sinks.inserted(store, new.select("k", "v", "o"), "k", "o")


@query("""SELECT '{"event":"result","pages":' || c_custkey || '}' AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '{"event":"error"}' FROM customer WHERE c_custkey % 2 = 1""")
def event_line_sink(spark, sf_dir):
    k = F.col("c_custkey")
    return sinks.event_lines(rel.table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "result").otherwise("error").alias("event"), F.when(k % 2 == 0, k).alias("pages")))


@query("WITH " + _SCORE_SQL + """, m AS (SELECT paper // 50 AS document, dimension, min(score) AS score FROM d GROUP BY ALL)
 SELECT document, '| dimension | score |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || dimension || ' | ' || printf('%.6f', score) || ' |', chr(10) ORDER BY dimension) || chr(10) AS markdown FROM m GROUP BY document""")
def report_markdown(spark, sf_dir):
    d = _scores(spark, sf_dir).groupBy(F.floor(F.col("paper") / 50).alias("document"), F.col("dimension").cast("string").alias("dimension")).agg(F.min("score").alias("score"))
    return sinks.report_markdown(d)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2049 > 0 THEN CAST((p_size * 37 * 1000 + (p_partkey % 2049) // 2) // (p_partkey % 2049) AS BIGINT) END AS width FROM part""")
def glyph_widths(spark, sf_dir):
    k = F.col("p_partkey")
    return rel.table(spark, sf_dir, "part").select("p_partkey", glyph_width(F.col("p_size") * 37, k % 2049).alias("width"))


@query("""WITH e AS (SELECT user_id AS run, CAST(event_id % 3 AS VARCHAR) AS stage, CASE WHEN event_id % 8 = 0 THEN 'stage_started' WHEN event_id % 8 = 7 THEN 'stage_finished' WHEN event_id % 8 < 6 THEN 'page_progress' ELSE 'summary' END AS event,
  event_id % 5 AS page, event_id % 4 + 1 AS total FROM events),
 c AS (SELECT run, stage, count(*) FILTER (event = 'stage_started') AS started, count(*) FILTER (event = 'stage_finished') AS finished, count(DISTINCT page) FILTER (event = 'page_progress') AS pages, max(total) FILTER (event = 'page_progress') AS total_pages
 FROM e WHERE event <> 'summary' GROUP BY ALL)
 SELECT run, stage, CAST(started AS BIGINT) AS started, CAST(finished AS BIGINT) AS finished, CAST(pages AS BIGINT) AS pages, CAST(total_pages AS BIGINT) AS total_pages, finished > 0 AND pages = coalesce(total_pages, 0) AS complete FROM c""")
def stage_progress(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 8 == 0, "stage_started").when(i % 8 == 7, "stage_finished").when(i % 8 < 6, "page_progress").otherwise("summary")
    e = rel.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (i % 3).cast("string").alias("stage"), kind.alias("event"), (i % 5).alias("page_index"), (i % 4 + 1).cast("bigint").alias("total_pages"))
    return E.stage_progress(e, ["run"])


@query("""WITH e AS (SELECT user_id AS run, event_id, CASE event_id % 4 WHEN 0 THEN event_id % 6 // 2 END AS n FROM events)
 SELECT run, CAST(coalesce(arg_min(n, event_id) FILTER (n IS NOT NULL), 0) AS BIGINT) AS n FROM e GROUP BY run""")
def summary_array_length(spark, sf_dir):
    """Events with an array under the key, with a number there, and without the key."""
    i = F.col("event_id")
    array = F.concat(F.lit('{"event":"summary","kept":['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.when(k < F.floor(i % 6 / 2), "{}")), ","), F.lit("]}"))
    value = F.when(i % 4 == 0, array).when(i % 4 == 1, '{"event":"summary","kept":7}').otherwise('{"event":"result"}')
    return E.summary_array_length(rel.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", value.alias("value")), ["run"], "event_id", "kept")
