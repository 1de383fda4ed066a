import pytest

from vellumlake.llm import toxicity as T


def test_folding_and_borders():
    x = T.Lexicon(whole={"idiot": 3.0, "clown": 3.0}, prefix={"lowe": 2.0})
    assert x.weigh("You 1D10T!")[0] == 3.0 and x.weigh("іdіоt")[0] == 3.0 and x.weigh("i​diot")[0] == 3.0
    assert x.weigh("idiotic")[0] == 0 and x.weigh("aidiot")[0] == 0 and x.weigh("Loweide")[0] == 2.0 and x.weigh("xlowe")[0] == 0
    assert x.weigh("a clown fish")[0] == 0 and x.weigh("a clown")[0] == 3.0 and x.weigh("")[0] == 0
    assert x.weigh("idiot " * 20000) == (3.0 * 20000, 20000)


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.6), ("sf0.1", 0.85)])
def test_held_out(spark, sf, least):
    d, l = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(d, T.learn(d, l)).join(l, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) >= least and sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "you idiot", 3), (2, "you idiot", 3)], "doc_id bigint, text string, score int")
    l = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = T.score(d, T.learn(d, l)).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert T.score(d.limit(0), T.Lexicon()).count() == 0


def plain_weight(text, lexicon):
    """Every pattern looked for at every place, one after the other."""
    s, best = T.fold(text), {}
    border = lambda i: not (0 <= i < len(s) and s[i].isalnum())
    free = [(i, i + len(p)) for p in map(T.fold, T.EXCEPTIONS) for i in range(len(s)) if s.startswith(p, i) and border(i - 1) and border(i + len(p))]
    for kind, words in (("w", lexicon.whole), ("p", lexicon.prefix)):
        for w, weight in words.items():
            at = s.find(w)
            while at >= 0:
                if border(at - 1) and (kind == "p" or border(at + len(w))) and not any(a <= at and at + len(w) <= b for a, b in free):
                    best[at] = max(best.get(at, 0.0), weight)
                at = s.find(w, at + 1)
    return sum(best.values()), len(s.split())


def test_scores_equal_a_plain_search(spark):
    """The learned lexicon over a whole table, and ties, repeated rows, very long texts and clashing columns."""
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = T.learn(d, l)
    assert lexicon.whole["trash"] != T.SEED_WEIGHT
    lexicon.prefix.update({"then": 0.5, "trash": 0.25, "eaux": 1.5})
    odd = [(-1, "a stupid question, stupid"), (-1, "a stupid question, stupid"), (-2, "STUPID " * 100_000), (-3, "trash bin trash"), (None, "idiot")]
    rows = d.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id bigint, text string")).selectExpr("*", "'x' as score", "1 as held_out", "2 as _text", "3 as _held")
    texts = rows.where("length(text) < 20000 or doc_id < 0").collect()
    got = {}
    for r in T.score(rows, lexicon).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == rows.count() and len(got[-1]) == 2 and got[-1][0] == got[-1][1]
    for t in texts:
        if t.doc_id == -2:
            assert got[-2][0].n_words == 100_000 and got[-2][0].toxic_weight == pytest.approx(100_000 * lexicon.whole["stupid"])
            continue
        r = got[t.doc_id][0]
        weight, n = plain_weight(t.text or "", lexicon)
        assert (r.toxic_weight, r.n_words) == (pytest.approx(weight), n), t.text
        assert r.predicted == (r.score >= 0.7)


def test_learning_does_not_see_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = l.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = T.learn(d, l), T.learn(d.withColumns({"lang": T.F.lit("x"), "source": T.F.lit("y")}).repartition(5), flipped)
    assert (a.whole, a.prefix, a.curve, a.cut) == (b.whole, b.prefix, b.curve, b.cut)
