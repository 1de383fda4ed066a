import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellumlake.operators import ordered as O
from vellumlake.operators import relational as R
from vellumlake.operators import scan, spatial, tree


def test_anchored_lines(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.0005, 1.001, 1.0015, 3.0])], "p int, o bigint, y double")
    assert [r.line for r in O.anchored_lines(df, ["p"], "o", "y").orderBy("o").collect()] == [0, 0, 0, 1, 2]


def test_detections_first_wins(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 5), (0, 1, 0.9, 3), (0, 2, 0.4, 1)], "p int, q int, s double, o int")
    assert [tuple(r) for r in O.detections(df, ["p"], "q", "s", "o").collect()] == [(0, 1, 0.9, 3)]


def test_budget_equals_loop(spark):
    random.seed(3)
    ids = ["a", "b", "c", "scan_summary"]
    rows = [(0, i, random.choice(ids)) for i in range(300)]
    per, total, n, kept = 10, 25, {}, []
    ordinary = 0
    for _, i, x in rows:
        ok = x == "scan_summary" or (ordinary < total and n.get(x, 0) < per)
        if ok:
            n[x] = n.get(x, 0) + 1
            ordinary += x != "scan_summary"
        kept.append((i, ok))
    got = O.budgeted(spark.createDataFrame(rows, "d int, o bigint, id string"), ["d"], "id", "o", per, total)
    assert sorted((r.o, r.kept) for r in got.collect()) == kept


def test_inversions(spark):
    random.seed(4)
    rows = [(k, i, random.random()) for k in range(3) for i in range(40 + k)]
    want = {k: sum(a[2] > b[2] for a, b in itertools.combinations([r for r in rows if r[0] == k], 2)) for k in range(3)}
    got = O.order_divergence(spark.createDataFrame(rows, "k int, a int, b double"), ["k"], "a", "b")
    assert {r.k: r.inversions for r in got.collect()} == want


def test_splice(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "X"), (4, 6, "")])], "t string, s array<struct<start:int,end:int,new:string>>")
    assert df.select(O.spliced(F.col("t"), F.col("s"))).first()[0] == "aXcd"


def test_greedy_equals_loop(spark):
    random.seed(5)
    rows = [(p, a, b, round(random.random(), 1)) for p in range(2) for a in range(8) for b in range(8)]
    want = []
    for p in range(2):
        la, lb = set(), set()
        for _, a, b, d in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1], r[2])):
            if a not in la and b not in lb:
                la.add(a)
                lb.add(b)
                want.append((p, a, b))
    got = spatial.greedy_matching(spark.createDataFrame(rows, "p int, lid bigint, rid bigint, d double"), "p", ["d", "lid", "rid"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rigid_deltas(spark):
    s = spark.createDataFrame([("u", 0, "a", 0.0, 0.0), ("u", 1, "b", 1.0, 0.0), ("w", 2, "c", 0.0, 0.0), ("w", 3, "d", 5.0, 0.0)], "unit string, glyph int, char string, x double, y double")
    t = spark.createDataFrame([("a", 2.0, 3.0), ("b", 3.0, 3.0), ("c", 1.0, 1.0), ("d", 9.0, 1.0)], "char string, tx double, ty double")
    assert [tuple(r) for r in spatial.rigid_deltas(s, t, "unit").collect()] == [("u", 2.0, 3.0)]


def test_terms_beyond_the_broadcast(spark):
    texts = spark.createDataFrame([(1, "the cat the"), (2, "dog"), (3, "")], "k int, t string")
    terms = spark.createDataFrame([("the",), ("dog",), ("cow",)], "s string")
    both = [sorted((r.k, r.s, r.n) for r in R.term_occurrences(texts, terms, "t", "s", most_terms=m).collect()) for m in (10, 0)]
    assert both[0] == both[1] == [(1, "the", 2), (2, "dog", 1)]


def test_every_term_counts_on_both_ways(spark):
    """Terms of one and two characters, repeated, empty and quoted ones; texts repeated, empty and shorter than a term."""
    words = ["a", "ab", "abc", "abc", "b", "", "字", "字典", "\"\\x", "zz", "cabb"]
    texts = ["abcabc", "ab", "a", "", "字典字", "x\"\\x", "abcabc", "ccabb"]
    want = sorted((i, w, t.count(w)) for i, t in enumerate(texts) for w in set(words) if w and w in t)
    df, terms = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(w,) for w in words], "s string")
    for most in ({}, {"most_terms": 0}, {"most_bytes": 0}):
        assert sorted((r.k, r.s, r.n) for r in R.term_occurrences(df, terms, "t", "s", **most).collect()) == want
    assert R.term_occurrences(df, terms.limit(0), "t", "s").count() == 0


def test_inheritance_finds_cycles(spark):
    good = spark.createDataFrame([(1, None, 5), (2, 1, None), (3, 2, None)], "node bigint, parent bigint, v int")
    assert sorted(map(tuple, tree.inherited(good, "v").collect())) == [(1, 5, 0), (2, 5, 1), (3, 5, 2)]
    bad = spark.createDataFrame([(1, 2, None), (2, 1, None)], "node bigint, parent bigint, v int")
    with pytest.raises(Exception, match="cycle"):
        tree.inherited(bad, "v").collect()


def test_scan_verdicts(spark):
    def verdict(classes):
        df = spark.createDataFrame([(0, i, c) for i, c in enumerate(classes)], "d int, page_index int, page_class string")
        return scan.scan_summary(df, ["d"]).first().rejected

    assert verdict(["scanned"] * 4 + ["content"]) and not verdict(["scanned"] * 3 + ["content"]) and not verdict(["blank"])
    assert verdict(["scanned"] * 4 + ["content"] + ["blank"] * 5)


def test_array_helpers(spark):
    df = spark.sql("select array(1,2,3) a, array(1,2) b, array(1,4) c")
    r = df.select(R.first_mismatch(F.col("a"), F.col("b")), R.first_mismatch(F.col("b"), F.col("c")), R.first_mismatch(F.col("a"), F.col("a")), R.is_prefix(F.col("b"), F.col("a"))).first()
    assert tuple(r) == (2, 1, None, True)
