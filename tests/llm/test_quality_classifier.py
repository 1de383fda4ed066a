import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumlake.llm import common, queries
from vellumlake.llm import quality_classifier as Q


def test_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = Q.judged(docs, train)
    assert got.count() == docs.count()
    rows = got.join(test, "doc_id").select("quality", "_kept").collect()
    good, bad = [r._kept for r in rows if r.quality], [r._kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.96 and sum(bad) / len(bad) < 0.15


@pytest.mark.parametrize("bound", [None, 0])
def test_posterior_equals_plain_arithmetic(spark, monkeypatch, bound):
    if bound == 0:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 17)
    rng = np.random.default_rng(0)
    rows = [(i, f"h{i % 4}", f"p{i % 3}", float(p)) for i, p in enumerate(rng.uniform(0.05, 0.95, 200))]
    df = spark.createDataFrame(rows, "i int, _host string, _path string, _p double")
    s = Q.sites(df)
    got = {r.i: r for r in Q.with_posterior(df, s).collect()}
    mu = sum(r[3] for r in rows) / len(rows)
    assert s.mu == pytest.approx(mu)
    for i, h, p, own in rows[:40]:
        hk, pk = [r[3] for r in rows if r[1] == h], [r[3] for r in rows if (r[1], r[2]) == (h, p)]
        host = (sum(hk) - own + s.host_strength * mu) / (len(hk) - 1 + s.host_strength)
        path = (sum(pk) - own + s.path_strength * host) / (len(pk) - 1 + s.path_strength)
        odds = Q.logit(own) + Q.logit(path) - Q.logit(mu)
        assert (got[i]._host_post, got[i]._path_post, got[i]._posterior) == pytest.approx((host, path, 1 / (1 + np.exp(-odds))))


def test_sparse_sites_shrink(spark):
    rows = [(f"h{i % 50}", "", 0.9 if i % 50 < 25 else 0.2) for i in range(5000)] + [("lonely", "", 0.2)]
    df = spark.createDataFrame(rows, "_host string, _path string, _p double")
    s = Q.sites(df)
    got = {r._host: r._host_post for r in Q.with_posterior(df, s).collect()}
    assert got["lonely"] == pytest.approx(s.mu) and got["h1"] > 0.85 and got["h30"] < 0.3


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, 5), (2, "", "en", "s", 6), (None, "a b", "en", "s", 7)], "doc_id bigint, text string, lang string, source string, x int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.judged(docs, none).where("_kept").count() == 3
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], none.schema)
    assert Q.judged(docs, labels).select("x", "_kept").count() == 3
    assert Q.judged(docs.limit(0), labels).count() == 0


def test_clashing_columns_and_odd_rows_come_out(spark):
    """Columns named as the operator's own pass; long texts, repeated rows and ids, ties."""
    names = ["_p", "_host", "_path", "_value", "_posterior", "_kept", "_host_post", "_path_post", "_row", "_k", "_n", "_hot", "_salt", "y", "x", "odd.name"]
    good, bad = "the house of the man is not far from here and it was good", "$$$ ### $$$ BUY 111 222 ***"
    base = [(i, good if i % 2 else bad) for i in range(40)] + [(1, good)] * 5 + [(None, good), (100, good * 20_000), (101, None)]
    df = spark.createDataFrame([(i, t, f"s{(i or 0) % 2}", "en", *range(16)) for i, t in base], "doc_id bigint, text string, source string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2, "doc_id bigint, quality int, toxic int")
    out = Q.judged(df, labels)
    assert out.columns == df.columns + ["__p", "__host_post", "__path_post", "__posterior", "__kept"]
    got = out.collect()
    assert len(got) == len(base) and {tuple(r)[4:20] for r in got} == {tuple(range(16))}
    assert {r["__kept"] for r in got if r.text == good} == {True} and {r["__kept"] for r in got if r.text == bad} == {False}
    assert len({r["__posterior"] for r in got if r.doc_id == 1}) == 1


def test_threshold_equals_trying_every_cut(spark):
    rng = np.random.default_rng(4)
    for n, places in ((3000, 3), (400, 12), (2, 1)):
        y = np.arange(n) % 2
        p = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2), 0.001, 0.999), places)
        good, bad = p[y == 1], p[y == 0]
        values = np.unique(p)
        cuts = [values[0], *((values[1:] + values[:-1]) / 2)]
        gain = [(good >= c).mean() + (bad < c).mean() if (good >= c).mean() >= Q.KEEP else -1 for c in cuts]
        rows = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, _posterior double").repartition(3)
        cut = Q.threshold(rows)
        assert any(cut == pytest.approx(c) and g == pytest.approx(max(gain)) for c, g in zip(cuts, gain))


def test_every_labelled_row_counts(spark):
    """More labelled rows than the 20,000 that were once taken: each takes part in the fit, once."""
    good, bad = "the house of the man is not far from here and it was good", "$$$ ### $$$ BUY 111 222 ***"
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    seen, real = [], Q.fit_classifier
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Q, "fit_classifier", lambda known, *rest: seen.append(known.count() if hasattr(known, "count") else len(known)) or real(known, *rest))
        out = Q.judged(docs.unionAll(docs.limit(10)), docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality")))
        assert out.where("_kept").count() == 12_500 + docs.limit(10).where("doc_id % 2 = 0").count()
    assert seen == [25_000]


def test_fit_equals_plain_newton(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(600) % 3 == 0).astype(int)
    x = rng.normal(size=(600, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    c = Q.fit_classifier(spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y int, x array<double>").repartition(4))
    z = Q._design((x - x.mean(0)) / x.std(0))
    p = 1 / (1 + np.exp(-z @ c.beta))
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    assert z.T @ (w * (y - p)) == pytest.approx(np.array([1e-6, *[1.0] * 6]) * c.beta, abs=1e-5)
    one = spark.createDataFrame([(x[5].tolist(),)], "x array<double>").select(c.prob(F.col("x"))).first()[0]
    assert one == pytest.approx(np.clip(p[5], Q.LOW, Q.HIGH))


def test_the_query_covers_documents_and_pages(spark, sf_dir):
    got = queries.op10_quality_classifier(spark, sf_dir).collect()
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages")}
    assert sum(r.kind == "document" for r in got) == n["documents"] and sum(r.kind == "page" for r in got) == n["pages"]
    sites = {(r.host, r.path) for r in got if r.kind == "page"}
    assert len(sites) > 20 and all(h and p.startswith("/") for h, p in sites)
