"""Queries over paragraphs: conservation, predicates, keys and glossaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vellumlake.functions import text as X
from vellumlake.functions.numeric import ratio1
from vellumlake.operators import relational as R
from vellumlake.plans import relations as rel
from vellumlake.plans.relations import LABEL_SQL, P_SQL, T_SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _token_sides(spark, sf_dir):
    t = rel.lossy(rel.paragraphs(spark, sf_dir))
    keys = ["doc_id", "lang", "reading_order"]
    return R.multiset(t, keys, rel.tokens("src")), R.multiset(t, keys, rel.tokens("tgt")), keys


_MISSING_SQL = "WITH " + T_SQL + r""", s AS (SELECT doc_id, lang, reading_order, token, count(*) AS n FROM
 (SELECT doc_id, lang, reading_order, unnest(regexp_extract_all(src, '[0-9]+(?:[.][0-9]+)?%?')) AS token FROM t) GROUP BY ALL),
 u AS (SELECT doc_id, reading_order, token, count(*) AS n FROM
 (SELECT doc_id, reading_order, unnest(regexp_extract_all(tgt, '[0-9]+(?:[.][0-9]+)?%?')) AS token FROM t) GROUP BY ALL),
 m AS (SELECT s.doc_id, s.lang, s.reading_order, s.token, s.n AS expected, least(s.n, coalesce(u.n, 0)) AS found
 FROM s LEFT JOIN u USING (doc_id, reading_order, token))
"""


@query(_MISSING_SQL + """SELECT lang, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(expected - found) AS BIGINT) AS missing,
 round(CAST(sum(found) AS DOUBLE) / sum(expected), 6) AS rate FROM m GROUP BY lang""")
def conservation_rate(spark, sf_dir):
    source, target, keys = _token_sides(spark, sf_dir)
    m = R.multiset_missing(source, target, keys)
    return m.groupBy("lang").agg(F.sum("expected").alias("expected"), F.sum("missing").alias("missing"), F.sum("found").alias("_f")).select("lang", "expected", "missing", ratio1(F.col("_f"), F.col("expected")).alias("rate"))


@query(_MISSING_SQL + "SELECT doc_id, reading_order, token, CAST(expected - found AS BIGINT) AS missing FROM m WHERE expected > found")
def token_multiset_missing(spark, sf_dir):
    source, target, keys = _token_sides(spark, sf_dir)
    return R.multiset_missing(source, target, keys).where("missing > 0").select("doc_id", "reading_order", "token", "missing")


@query("WITH " + P_SQL + " SELECT doc_id, reading_order, src, CAST(length(src) AS BIGINT) AS n FROM p")
def paragraph_explode(spark, sf_dir):
    return rel.paragraphs(spark, sf_dir).select("doc_id", "reading_order", "src", F.length("src").cast("bigint").alias("n"))


@query("WITH " + P_SQL + f""", q AS (SELECT doc_id, {LABEL_SQL} AS label FROM p)
 SELECT doc_id, bool_or(label = 'text') AS translatable, bool_and(label <> 'text') AS passthrough, bool_and(label = 'table') AS only_table,
 CAST(count(*) AS BIGINT) AS paragraphs FROM q GROUP BY doc_id""")
def translatable_paragraphs(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir).withColumn("label", rel.label())
    policy = X.policy(F.col("label"))
    return p.groupBy("doc_id").agg(F.bool_or(policy == "translate").alias("translatable"), F.bool_and(policy == "passthrough").alias("passthrough"), F.bool_and(F.col("label") == "table").alias("only_table"), F.count("*").alias("paragraphs"))


@query("""SELECT lang, c, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang, c""")
def char_histogram(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents")
    return d.select("lang", F.explode(X.characters(F.col("text"))).alias("c")).groupBy("lang", "c").agg(F.count("*").alias("n"))


@query("WITH " + P_SQL + r""" SELECT b.item_id, p.doc_id, p.reading_order FROM benchmark b JOIN p
 ON regexp_replace(b.text, '\s+', '', 'g') = regexp_replace(p.src, '\s+', '', 'g') WHERE regexp_replace(p.src, '\s+', '', 'g') <> ''""")
def text_compare_key_pairs(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir).withColumn("key", X.compare_key(F.col("src"))).where("key <> ''")
    b = rel.table(spark, sf_dir, "benchmark").select("item_id", X.compare_key(F.col("text")).alias("key"))
    return p.join(b, "key").select("item_id", "doc_id", "reading_order")


@query("WITH " + P_SQL + r""", q AS (SELECT lang, trim(src) AS s FROM p), c AS (SELECT lang, NOT regexp_matches(s, '\p{L}') AS identity,
 (s NOT LIKE '% %' AND len(string_split(s, '@')) = 2 AND string_split(s, '@')[1] <> '' AND contains(string_split(s, '@')[2], '.')
 AND NOT starts_with(string_split(s, '@')[2], '.') AND NOT ends_with(string_split(s, '@')[2], '.')) AS email, s FROM q)
 SELECT lang, CAST(count(*) FILTER (identity) AS BIGINT) AS identities, CAST(count(*) FILTER (email) AS BIGINT) AS emails,
 CAST(count(*) FILTER (s <> '' AND NOT email AND NOT identity) AS BIGINT) AS echo_retry FROM c GROUP BY lang""")
def local_identity_class(spark, sf_dir):
    p, s = rel.paragraphs(spark, sf_dir), F.col("src")
    return p.groupBy("lang").agg(F.count_if(X.local_identity(s)).alias("identities"), F.count_if(X.email_shape(s)).alias("emails"), F.count_if(X.echo_retry(s)).alias("echo_retry"))


@query("WITH " + P_SQL + """, q AS (SELECT lang, length(src) >= 40 AND 2 * length(regexp_replace(src, '[^A-Za-z]', '', 'g')) >= length(src) AS prose FROM p)
 SELECT lang, CAST(count(*) AS BIGINT) AS paragraphs, CAST(count(*) FILTER (prose) AS BIGINT) AS prose,
 round(CAST(count(*) FILTER (prose) AS DOUBLE) / count(*), 6) AS rate FROM q GROUP BY lang""")
def prose_shape_rate(spark, sf_dir):
    n = F.count_if(X.prose_shaped(F.col("src")))
    return rel.paragraphs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("paragraphs"), n.alias("prose"), ratio1(n, F.count("*")).alias("rate"))


_SYNTH = "concat(src, CASE reading_order % 4 WHEN 1 THEN '  {v1}' WHEN 2 THEN ' <b1>x' WHEN 3 THEN '' ELSE '{l2}<b' END)"


@query("WITH " + P_SQL + f""", q AS (SELECT doc_id, {_SYNTH} AS s FROM p)
 SELECT doc_id, CAST(sum(CAST(contains(s, '{{v') AS INTEGER) + CAST(contains(s, '{{l') AS INTEGER) + CAST(contains(s, '<b') AS INTEGER)) AS BIGINT) AS residue,
 CAST(count(*) FILTER (contains(s, '  ') OR regexp_matches(s, '^\\s|\\s$')) AS BIGINT) AS abnormal FROM q GROUP BY doc_id""")
def placeholder_residue(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir).withColumn("s", F.expr(_SYNTH))
    return p.groupBy("doc_id").agg(F.sum(X.placeholder_residue(F.col("s"))).alias("residue"), F.count_if(X.abnormal_space(F.col("s"))).alias("abnormal"))


@query("""SELECT item, numbering FROM (SELECT '(' || c_custkey || ') ' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE '-[2]' END AS item FROM customer)
 , LATERAL (SELECT regexp_matches(item, '^[0-9.()\\[\\]\\- ]*[0-9][0-9.()\\[\\]\\- ]*$') AS numbering)""".replace("\\\\", "\\"))
def numbering_only(spark, sf_dir):
    c = rel.table(spark, sf_dir, "customer")
    item = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(") "), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("-[2]"))
    return c.select(item.alias("item")).withColumn("numbering", X.numbering_only(F.col("item")))


def _ranges_sql(ranges) -> str:
    return " OR ".join(f"u BETWEEN {a} AND {b}" for a, b in ranges)


@query(f"""WITH c AS (SELECT lang, unicode(c) AS u FROM (SELECT lang, unnest(string_split(text || '漢、α', '')) AS c FROM documents) WHERE c <> '')
 SELECT lang, CASE WHEN {_ranges_sql(X.CJK)} THEN 'cjk' WHEN {_ranges_sql(X.LATIN)} THEN 'latin' ELSE 'default' END AS script, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")
def script_preference_counts(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents").select("lang", F.explode(X.characters(F.concat("text", F.lit("漢、α")))).alias("c"))
    # one row a character first: the ranges are tried once for each distinct one
    n = d.groupBy("lang", "c").agg(F.count("*").alias("n"))
    return n.groupBy("lang", X.script_preference(F.col("c")).alias("script")).agg(F.sum("n").alias("n"))


@query("WITH " + P_SQL + f""", q AS (SELECT p.*, {LABEL_SQL} AS label FROM p), z AS (SELECT lang, label = 'text' AS eligible,
 repeat('字', CAST(length(src) % 7 AS INTEGER)) || src AS translated, CASE WHEN doc_id % 9 = 0 THEN 'translation_failure' END AS tr,
 CASE WHEN reading_order % 8 = 5 THEN 'typeset_overflow' END AS ty, length(src) % 7 AS han FROM q)
 SELECT lang, CAST(count(*) AS BIGINT) AS eligible_paragraphs, CAST(count(*) FILTER (tr IS NULL AND ty IS NULL) AS BIGINT) AS translated_paragraphs,
 CAST(sum(han) AS BIGINT) AS translated_han, CAST(sum(CASE WHEN tr IS NULL AND ty IS NULL THEN han ELSE 0 END) AS BIGINT) AS published_han,
 round(CAST(count(*) FILTER (tr IS NULL AND ty IS NULL) AS DOUBLE) / count(*), 6) AS paragraph_coverage,
 CASE WHEN sum(han) = 0 THEN 1.0 ELSE round(CAST(sum(CASE WHEN tr IS NULL AND ty IS NULL THEN han ELSE 0 END) AS DOUBLE) / sum(han), 6) END AS han_weighted_coverage,
 CAST((count(*) - count(*) FILTER (tr IS NULL AND ty IS NULL)) * 5 AS DOUBLE) AS weighted FROM z WHERE eligible GROUP BY lang""")
def coverage_dimension(spark, sf_dir):
    from vellumlake.operators import score

    return score.coverage(_coverage_pairs(spark, sf_dir), ["lang"])


def _coverage_pairs(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir)
    text = F.concat(F.repeat(F.lit("字"), (F.length("src") % 7).cast("int")), F.col("src"))
    return p.select("lang", (X.policy(rel.label()) == "translate").alias("eligible"), text.alias("translated"), F.when(F.col("doc_id") % 9 == 0, "translation_failure").alias("translated_reason"), text.alias("typeset"), F.when(F.col("reading_order") % 8 == 5, "typeset_overflow").alias("typeset_reason"))


@query("WITH " + P_SQL + f""", q AS (SELECT lang, {LABEL_SQL} AS label, CASE WHEN doc_id % 9 = 0 THEN 'translation_failure' END AS tr,
 CASE WHEN reading_order % 8 = 5 THEN 'typeset_overflow' END AS ty FROM p)
 SELECT lang, coalesce(ty, tr) AS reason, CAST(count(*) AS BIGINT) AS n FROM q WHERE label = 'text' AND coalesce(ty, tr) IS NOT NULL GROUP BY ALL""")
def preserved_reasons(spark, sf_dir):
    from vellumlake.operators import score

    return score.preserved_reasons(_coverage_pairs(spark, sf_dir), ["lang"])


@query("WITH " + T_SQL + r""", q AS (SELECT lang, src, tgt, """ + LABEL_SQL + r""" = 'text' AS translatable FROM t)
 SELECT lang, CAST(count(*) FILTER (NOT translatable) AS BIGINT) AS policy, CAST(0 AS BIGINT) AS superscript,
 CAST(count(*) FILTER (regexp_matches(src, '^[0-9.()\[\]\- ]*[0-9][0-9.()\[\]\- ]*$')) AS BIGINT) AS numbering, CAST(count(*) FILTER (trim(src) = '') AS BIGINT) AS blank,
 CAST(count(*) FILTER (NOT translatable) * 10 + count(*) FILTER (regexp_matches(src, '^[0-9.()\[\]\- ]*[0-9][0-9.()\[\]\- ]*$')) * 5
  + count(*) FILTER (trim(src) = '') * 5 AS DOUBLE) AS weighted
 FROM q WHERE regexp_replace(src, '\s+', '', 'g') <> regexp_replace(tgt, '\s+', '', 'g') GROUP BY lang""")
def overtranslation_dimension(spark, sf_dir):
    from vellumlake.operators import score

    t = rel.lossy(rel.paragraphs(spark, sf_dir))
    pairs = t.select("lang", F.col("src").alias("source"), F.col("tgt").alias("translated"), (X.policy(rel.label()) == "translate").alias("translatable"), F.lit(False).alias("superscript"))
    return score.overtranslation(pairs, ["lang"])


@query("WITH " + P_SQL + """, q AS (SELECT lang, CASE reading_order % 5 WHEN 1 THEN '。' || src WHEN 2 THEN src || '（' WHEN 3 THEN '!' WHEN 4 THEN src || '{v1}' ELSE src END AS s FROM p),
 a AS (SELECT lang, CAST(left(s, 1) = '。' OR right(s, 1) = '（' AS INTEGER) AS k, CAST(s = '!' AS INTEGER) AS i, CAST(contains(s, '{v') AS INTEGER) AS r,
 CAST(contains(s, '  ') OR left(s, 1) = ' ' OR right(s, 1) = ' ' AS INTEGER) AS w FROM q)
 SELECT lang, CAST(sum(k) AS BIGINT) AS kinsoku, CAST(sum(i) AS BIGINT) AS isolated, CAST(sum(r) AS BIGINT) AS residue, CAST(sum(w) AS BIGINT) AS whitespace,
 CAST(sum(k) * 3 + sum(i) + sum(r) * 10 + sum(w) AS DOUBLE) AS weighted FROM a GROUP BY lang""")
def lint_dimension(spark, sf_dir):
    from vellumlake.operators import score

    s = F.expr("CASE reading_order % 5 WHEN 1 THEN concat('。', src) WHEN 2 THEN concat(src, '（') WHEN 3 THEN '!' WHEN 4 THEN concat(src, '{v1}') ELSE src END")
    return score.lint(rel.paragraphs(spark, sf_dir).select("lang", s.alias("s")), ["lang"], "s")


@query("WITH " + P_SQL + r""", q AS (SELECT doc_id, reading_order, regexp_replace(src, '[^(){}\[\]]', '', 'g') AS s FROM p WHERE contains(src, '(') OR contains(src, '[') OR contains(src, '{') OR contains(src, ')') OR contains(src, ']') OR contains(src, '}')),
 r AS (SELECT doc_id, reading_order, replace(replace(replace(s, '()', ''), '[]', ''), '{}', '') AS s FROM q),
 r2 AS (SELECT doc_id, reading_order, replace(replace(replace(s, '()', ''), '[]', ''), '{}', '') AS s FROM r)
 SELECT doc_id, reading_order, s = '' AS balanced FROM r2""")
def delimiters_balanced(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir).where(F.col("src").rlike(r"[(\[{)\]}]"))
    return p.select("doc_id", "reading_order", X.delimiters_balanced(F.col("src")).alias("balanced"))


@query("""SELECT doc_id, sha256(text) AS text_sha256, rpad(left(hex(encode('doc-' || doc_id)), 32), 32, '0') AS trailer_hex, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""".replace("hex(encode('doc-' || doc_id))", "lower(hex(encode('doc-' || doc_id)))"))
def cache_key_hash(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return d.select("doc_id", X.sha256_text(F.col("text")).alias("text_sha256"), X.trailer_id(name).alias("trailer_hex"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("""SELECT r_name, sha256(string_agg(n_name || '=' || CAST(n_nationkey AS VARCHAR) || chr(10), '' ORDER BY n_name)) AS fingerprint FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def fingerprint_ordered(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation").join(F.broadcast(rel.table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    line = F.concat("n_name", F.lit("="), F.col("n_nationkey").cast("string"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("n_name", line.alias("line"))))
    return n.groupBy("r_name").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["line"]), ""), 256).alias("fingerprint"))


@query("""SELECT coalesce(u.source, a.source) AS source, coalesce(u.target, a.target) AS target FROM
 (SELECT n_name AS source, 'user:' || n_name AS target FROM nation WHERE n_nationkey % 2 = 0) u FULL JOIN
 (SELECT n_name AS source, 'auto:' || n_name AS target FROM nation WHERE n_nationkey % 3 = 0) a ON u.source = a.source""")
def glossary_merge(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation")
    of = lambda who, k: n.where(F.col("n_nationkey") % k == 0).select(F.col("n_name").alias("source"), F.concat(F.lit(who), "n_name").alias("target"))
    return R.merged(of("user:", 2), of("auto:", 3), "source", "target")


_TERMS = ("the", "of and", "les", "der", "tion", "que")


@query("WITH " + P_SQL + ", terms(source) AS (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + """),
 q AS (SELECT p.doc_id, p.reading_order, t.source, p.src, CASE WHEN p.doc_id % 4 = 0 THEN p.src ELSE replace(p.src, t.source, upper(t.source)) END AS tgt FROM p JOIN terms t ON contains(p.src, t.source)),
 c AS (SELECT source, (length(src) - length(replace(src, source, ''))) // length(source) AS n, (length(tgt) - length(replace(tgt, upper(source), ''))) // length(source) AS m FROM q)
 SELECT source, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(least(n, m)) AS BIGINT) AS found, CAST(greatest(0, sum(n) - sum(least(n, m))) AS BIGINT) AS violations FROM c GROUP BY source""")
def glossary_consistency(spark, sf_dir):
    p = rel.paragraphs(spark, sf_dir)
    terms = spark.createDataFrame([(t,) for t in _TERMS], "source string")
    hit = R.term_occurrences(p, terms, "src", "source")
    tgt = F.when(F.col("doc_id") % 4 == 0, F.col("src")).otherwise(F.replace(F.col("src"), F.col("source"), F.upper("source")))
    m = X.occurrences(tgt, F.upper("source"))
    # the lesser of both is taken in each paragraph, before sums
    out = hit.withColumn("m", F.least(F.col("n"), m)).groupBy("source").agg(F.sum("n").alias("expected"), F.sum("m").alias("found"))
    return out.withColumn("violations", F.greatest(F.lit(0), F.col("expected") - F.col("found")))


@query("WITH " + P_SQL + """, k AS (SELECT DISTINCT sha256(src) AS key FROM p), i AS (SELECT key FROM k WHERE substr(key, 1, 1) = 'a'),
 t AS (SELECT key, CASE WHEN substr(key, 3, 1) IN ('0', '1') THEN 'bad' ELSE 'ok' END AS state FROM k WHERE substr(key, 1, 1) IN ('b', 'c', '1', '2'))
 SELECT lang, CASE WHEN i.key IS NOT NULL THEN 'identity' WHEN t.state = 'ok' THEN 'hit' ELSE 'miss' END AS status, CAST(count(*) AS BIGINT) AS n
 FROM p LEFT JOIN i ON sha256(src) = i.key LEFT JOIN t ON sha256(src) = t.key GROUP BY ALL""")
def cache_hit_miss(spark, sf_dir):
    """Identity table first, then translations; a hit counts only if what it restores is valid."""
    p = rel.paragraphs(spark, sf_dir).select("lang", X.sha256_text(F.col("src")).alias("key"))
    keys = p.select("key").distinct()
    identity = keys.where("substr(key, 1, 1) = 'a'").withColumn("same", F.lit(True))
    cached = keys.where("substr(key, 1, 1) in ('b', 'c', '1', '2')").withColumn("state", F.when(F.substring("key", 3, 1).isin("0", "1"), "bad").otherwise("ok"))
    hit = p.join(identity, "key", "left").join(cached, "key", "left")
    status = F.when(F.col("same"), "identity").when(F.col("state") == "ok", "hit").otherwise("miss")
    return hit.groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS token FROM conversations WHERE role IN ('user', 'assistant')),
 s AS (SELECT conv_id, token, count(*) AS n FROM w WHERE role = 'user' GROUP BY ALL), t AS (SELECT conv_id, token, count(*) AS n FROM w WHERE role = 'assistant' GROUP BY ALL)
 SELECT s.conv_id, CAST(sum(s.n) AS BIGINT) AS expected, CAST(sum(greatest(0, s.n - coalesce(t.n, 0))) AS BIGINT) AS missing FROM s LEFT JOIN t USING (conv_id, token) GROUP BY s.conv_id""")
def turn_multiset_difference(spark, sf_dir):
    c = rel.table(spark, sf_dir, "conversations")
    side = lambda r: R.multiset(c.where(F.col("role") == r), ["conv_id"], F.split("text", " "))
    return R.multiset_missing(side("user"), side("assistant"), ["conv_id"]).groupBy("conv_id").agg(F.sum("expected").alias("expected"), F.sum("missing").alias("missing"))


@query("""SELECT h.doc_id, h.codes, CASE WHEN h.codes THEN 'default' ELSE 'x' END AS kind FROM (SELECT doc_id, (64976 <= doc_id + 64900 AND doc_id + 64900 <= 65007) OR (doc_id + 64900) % 65536 >= 65534 AS codes FROM documents) h""")
def noncharacter_codes(spark, sf_dir):
    d = rel.table(spark, sf_dir, "documents")
    code = X.noncharacter(F.col("doc_id") + 64900)
    return d.select("doc_id", code.alias("codes"), F.when(code, "default").otherwise("x").alias("kind"))


@query("""WITH u AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'http://a.example/v1/' WHEN 2 THEN 'https://a.example/v1/responses' WHEN 3 THEN 'https://u:p@a.example' WHEN 4 THEN 'https://a.example/x?q=1' ELSE 'https://a.example/proxy' END AS base,
 CASE c_custkey % 7 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 408 WHEN 3 THEN 503 WHEN 4 THEN 401 WHEN 5 THEN 422 ELSE 501 END AS status FROM customer)
 SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN base || '/v1/responses' WHEN 1 THEN 'http://a.example/v1/responses' WHEN 2 THEN base WHEN 5 THEN base || '/v1/responses' END AS url,
 CASE status WHEN 200 THEN 'ok' WHEN 401 THEN 'authentication_failed' WHEN 503 THEN 'translation_failed' WHEN 501 THEN 'translation_failed' ELSE 'backend_rejected' END AS reason,
 CASE status WHEN 429 THEN 'rate_limited' WHEN 408 THEN 'timeout' WHEN 503 THEN 'server_error' END AS retry FROM u""")
def request_endpoints(spark, sf_dir):
    base = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'http://a.example/v1/' WHEN 2 THEN 'https://a.example/v1/responses' WHEN 3 THEN 'https://u:p@a.example' WHEN 4 THEN 'https://a.example/x?q=1' ELSE 'https://a.example/proxy' END")
    status = F.expr("CASE c_custkey % 7 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 408 WHEN 3 THEN 503 WHEN 4 THEN 401 WHEN 5 THEN 422 ELSE 501 END")
    e = X.error_class(status)
    return rel.table(spark, sf_dir, "customer").select("c_custkey", X.responses_url(base).alias("url"), e["reason"].alias("reason"), e["retry"].alias("retry"))


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(l_partkey % 40 - l_suppkey % 20, 0.25 * (6 + l_linenumber)) AS DOUBLE) AS gap, l_partkey % 40 - l_suppkey % 20 < 0.25 * (6 + l_linenumber) AS clamped FROM lineitem""")
def section_number_gap(spark, sf_dir):
    d = lambda c: c.cast("double")
    p = X.section_number(F.lit(10.0), d(10 + F.col("l_partkey") % 40), d(F.col("l_suppkey") % 20), d(6 + F.col("l_linenumber")))
    return rel.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p["gap"].alias("gap"), p["clamped"].alias("clamped"))


@query()
def conserved_tokens_full(spark, sf_dir):
    """Tokens by the full lexer, by language; unit tests hold its cases."""
    from vellumlake.functions.lexer import HINT, tokens_of

    p = rel.paragraphs(spark, sf_dir).where(F.col("src").rlike(HINT))
    return p.select("lang", F.explode(tokens_of("src")).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query()
def executor_outcomes(spark, sf_dir):
    """Outcomes of the translation executor with the compressing backend, by language."""
    from vellumlake.operators import executor

    p = rel.paragraphs(spark, sf_dir)
    out = executor.translated(p, executor.compressing, ["doc_id", "lang", "reading_order"])
    return out.groupBy("lang", "outcome").agg(F.count("*").alias("n"), F.sum("conservation_retries").alias("conservation_retries"))


@query()
def placeholder_validate(spark, sf_dir):
    """Violations of answers that lose, repeat or break a placeholder, by kind."""
    from vellumlake.functions import placeholders as P

    def broken(k, text):
        request = P.encode([("text", text), ("formula", ""), ("bold", "b")])
        answer = {0: request.text + " ", 1: request.text.replace("{v1}", ""), 2: request.text + "{v1}", 3: request.text + "{v", 4: request.text.replace("</b1>", "") + " "}[k]
        return P.violation(request.tokens, answer, request.text) or "valid"

    @F.pandas_udf("string")
    def judged(k: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([broken(a, b) for a, b in zip(k, text)], dtype="object")

    p = rel.table(spark, sf_dir, "benchmark")
    return p.groupBy(judged((F.col("item_id") % 5).cast("int"), F.col("text")).alias("violation")).agg(F.count("*").alias("n"))
