import random

import pytest
from pyspark.sql import functions as F

from vellumlake.functions import geometry as G
from vellumlake.functions import placeholders as P
from vellumlake.functions import text as X
from vellumlake.functions.lexer import conserved_tokens, missing_tokens, tokens_of
from vellumlake.operators import executor as E


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("40K", ["40000"]), ("36M", ["36000000"]), ("3600 万", ["36000000"]), ("4.5 million", ["4500000"]), ("450 万", ["4500000"]),
        ("1/4", ["1/4"]), ("四分之一", ["1/4"]), ("37/100", ["37%"]), ("37%", ["37%"]), ("40 K", ["40", "K"]), ("50/100", ["1/2"]),
        ("−1/4", ["1/4"]), ("-1/4", ["-1", "4"]), ("+5", ["+5"]), ("1990s", ["1990", "s"]), ("1,234", ["1234"]), ("1,2345", ["1", "2345"]),
        ("5e", ["5"]), ("5e3%", ["5e3%"]), ("3.50 km [1, 2]", ["3.5", "km", "[1, 2]"]), ("x-3 -3", ["3", "-3"]), ("零分之一", []), ("-0", ["0"]), ("", []),
    ],
)
def test_tokens(text, tokens):
    assert conserved_tokens(text) == tokens


def test_missing_keeps_multiplicity():
    assert missing_tokens("4 4 5 km", "40 4 km") == ["4", "5"]
    assert missing_tokens("4.5 million", "450 万") == []


def test_tokens_column(spark):
    rows = spark.createDataFrame([("a 1/2",), (None,), ("",)], "t string").select(tokens_of("t").alias("x")).collect()
    assert [r.x for r in rows] == [["1/2"], None, []]


REQUEST = P.encode([("text", "Translated "), ("formula", ""), ("bold", " strong "), ("formula", "")])


def test_encoding():
    assert REQUEST.text == "Translated {v1}<b1> strong </b1>{v2}"
    assert P.encode([("text", "a<{")]).text == "a{l1}{l2}"


@pytest.mark.parametrize(
    "answer, broken",
    [
        ("x {v1}<b1>y</b1>{v2}", None), ("x {v1}<b1>y</b1>", "missing"), ("x {v1}{v1}<b1>y</b1>{v2}", "duplicate"), ("{v9}", "unknown"),
        ("{v1}<b1>{v2}", "tag_nesting"), ("{v2}<b1>y</b1>{v1}", "formula_order"), ("{v1", "partial_token"), ("{v0}", "partial_token"),
        (REQUEST.text, "backend_echo"),
    ],
)
def test_violations(answer, broken):
    assert P.violation(REQUEST.tokens, answer, REQUEST.text) == broken
    assert broken is None or P.correction(REQUEST.tokens, broken, answer)


def test_restore():
    assert P.restore(REQUEST, "甲{v1}<b1>乙</b1>{v2}丙") == [[("甲", False)], [("乙", True)], [("丙", False)]]


def test_executor_budgets():
    p = P.encode([("text", "Speed is 5 km")])
    assert E.execute(p, E.conserving).outcome == "translated"
    lost = E.execute(p, E.compressing)
    assert (lost.outcome, lost.attempts, lost.conservation_retries, lost.missing) == ("content_conservation_violation", 2, 1, ("5", "km"))
    echo = E.execute(p, E.identity)
    assert (echo.outcome, echo.attempts, echo.suspicious) == ("identity", 2, True)
    assert E.execute(p, E.conserving, cached="速 5 km").cache == "hit"
    assert E.execute(p, E.conserving, cached="速 6 km").cache == "miss"
    broken = E.execute(p, lambda t, n, hint: "{v7}")
    assert (broken.outcome, broken.violation, broken.attempts) == ("placeholder_violation", "unknown", 2)


def test_executor_frame(spark):
    rows = E.translated(spark.createDataFrame([(1, "abc 4 km"), (2, "12"), (3, "abc 4 km"), (4, "")], "k int, src string"), E.conserving, ["k"]).orderBy("k").collect()
    assert [r.outcome for r in rows] == ["translated", "local_identity", "translated", "local_identity"]


def check(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "expr, text, want",
    [
        (X.email_shape, " a@b.c ", True), (X.email_shape, "a@b@c.d", False), (X.email_shape, "a@.bc", False), (X.local_identity, "12 ⅷ", False),
        (X.numbering_only, "1.2 (3)", True), (X.numbering_only, "..", False), (X.abnormal_space, "a  b", True), (X.abnormal_space, "　a", True),
        (X.abnormal_space, "a b", False), (X.isolated_punctuation, "。", True), (X.delimiters_balanced, "（a[b]）", True), (X.delimiters_balanced, "(]", False),
        (X.delimiters_balanced, ")", False), (X.delimiters_balanced, "", True), (X.han_count, "漢字x", 2), (X.compare_key, "ﬁ ﬀ x", "fiffx"),
        (X.compare_key, "sur\u00ad vive", "survive"), (lambda c: X.joined_lines(F.split(c, "\n")), "Order must sur\u00ad\n\n vive a  line", "Order must survive a line"),
        (lambda c: X.version_of(c, "tool"), "x 1\nthe tool 2.3.4, (c) 2020", "2.3.4"), (X.version_of, "\n v 10.5)\n", "10.5"), (X.isolated_punctuation, "…", False),
        (X.placeholder_residue, "{v1}{v2}<b1>", 2), (X.kinsoku, "。a", True), (X.trailer_id, "ab", "6162" + "0" * 28), (X.valid_sha256, "g" * 64, False),
    ],
)
def test_text_predicates(spark, expr, text, want):
    assert check(spark, expr, text) == want


def test_source_text(spark):
    df = spark.createDataFrame([([("a", False), ("b", True), (None, True), (" ", True), ("c", True)],)], "c array<struct<unicode:string,implicit_space_before:boolean>>")
    r = df.select(X.source_text(F.col("c")).alias("s"), X.plain_text(F.col("c")).alias("p")).first()
    assert (r.s, r.p) == ("a b c", "ab c")
    first = spark.createDataFrame([([(None, True), ("a", True), ("b", None)],), ([],)], df.schema)
    assert [r[0] for r in first.select(X.source_text(F.col("c"))).collect()] == [" ab", ""]


def test_composite_key_tells_fields_apart(spark):
    a, b = spark.sql("select 'ab' as x, 'c' as y").select(X.composite_key(F.col("x"), F.col("y"))).first()[0], spark.sql("select 'a' as x, 'bc' as y").select(X.composite_key(F.col("x"), F.col("y"))).first()[0]
    assert a != b


def test_transform_kind(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (-1.0, 0.0, 0.0, 1.0), (0.0, 1.0, -1.0, 0.0), (1.0, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(G.transform_kind(*map(F.col, "abcd"))).collect()] == ["upright", "mirrored", "rotated", "skewed"]


def test_conserving_backend_keeps_tokens():
    random.seed(2)
    for _ in range(200):
        t = " ".join(random.choice(["word", "5 km", "1/4", "37%", "x3", "[1, 2]", "4.5"]) for _ in range(8))
        assert missing_tokens(t, E.conserving(t)) == []


def test_identity_and_glyph_names(spark):
    df = spark.createDataFrame([([("a", None)], [("a", None)], None), ([("a", None)], [("a", 1.0)], None), ([("a", 1.0)], [("a", 1.0)], " a")], "a array<struct<unicode:string,x:double>>, b array<struct<unicode:string,x:double>>, t string")
    assert [r[0] for r in df.select(X.paragraph_identity(F.col("a"), F.col("b"), F.col("t"))).collect()] == [True, False, True]
    names = spark.createDataFrame([("A.sc",), ("f_i",), (".notdef",), ("zzz",), ("bad",)], "n string")
    table = F.create_map(F.lit("A"), F.lit("A"), F.lit("bad"), F.lit("﷐"))
    assert [r[0] for r in names.select(X.glyph_character(F.col("n"), table)).collect()] == ["A", None, None, None, None]


def test_fake_translations_by_their_rules():
    """Letters by their code, what stays, and pieces of at most six letters chosen by the hash of the text."""
    from vellumlake.operators import executor as E

    n = len(E.HAN_SAMPLE)
    letters = lambda t: "".join(E.HAN_SAMPLE[ord(c) % n] for c in t)
    assert E.conserving("ab 3.5 km, 12ms x") == letters("ab") + " 3.5 km, 12ms " + letters("x")
    assert E.conserving("5 kmx km") == "5 " + letters("kmx") + " " + letters("km")
    assert E.conserving("{v1}<b2>q</b2>{v0}") == "{v1}<b2>" + letters("q") + "</b2>{" + letters("v") + "0}"
    assert E.conserving("-3e5% 模 °C 7 °C") == "-3e5% 模 °" + letters("C") + " 7 °C"

    def seed(t):
        s = 2166136261
        for b in t.encode():
            s = ((s ^ b) * 16777619) % 2**64
        return s

    pick = lambda t, piece, k: "".join(E.HAN_SAMPLE[(seed(t) + 7 * piece + 5 * i) % n] for i in range(k))
    for text, parts in (("hello world", [(0, 5)]), ("a", [(0, 1)]), ("x" * 40, [(0, 6)])):
        assert E.compressing(text) == "".join(pick(text, *p) for p in parts)
    t = "abcd{v1} ef<b9> <bx"
    assert E.compressing(t) == pick(t, 0, 2) + "{v1}" + pick(t, 1, 1) + "<b9>" + pick(t, 2, 1) + pick(t, 3, 1)
    assert E.compressing("  ") == pick("  ", 0, 1) and E.compressing("{l3}") == "{l3}"
