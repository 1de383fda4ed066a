import re

import numpy as np

from vellumlake.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = ["", " \n\t", "a", "a b c d e a b c d e", "x x x x x x", "one\ntwo\none\n\n \none", "é ü # * $$ |<>", "a b c d e f g h " * 3, "\x1ca\x85b c d", "z " * 500 + "y " * 3]


def test_base_counts_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(100)] + [" ".join(f"w{i}" for i in rng.integers(0, 6000, 9000))]
    for t in texts[:-1]:
        assert Q.statistics(t)[0] == brute(t), repr(t)
    long = texts[-1] + " " + texts[-1][:200].rsplit(" ", 1)[0]
    words = long.split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    assert Q.statistics(long)[0][4] == len(hit) > 0


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, Q.N_FEATURES))
    f = Q.Forest.grown(x)
    assert f.score(np.full((1, Q.N_FEATURES), 8.0))[0] > np.quantile(f.score(x), 0.99)
    assert (Q.Forest.grown(x).score(x[:9]) == f.score(x[:9])).all()


def test_verdicts_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    rows = [(got[r.doc_id], r.quality) for r in labels.collect()]
    good = [g.kept for g, q in rows if q == 1 and not g.base_failed]
    assert sum(good) / len(good) > 0.97
    assert sum(not g.kept for g, q in rows if q == 0) / sum(q == 0 for _, q in rows) > 0.9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (None, "w " * 30000, 2), (3, " ".join(f"w{i}" for i in range(40)), 3)], "doc_id bigint, text string, kept int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, none)).collect()}
    assert [got[k].base_failed for k in (1, 2, None, 3)] == [True, True, True, False] and got[3].kept and not got[1].kept
    assert Q.judge(docs.limit(0), Q.RuleModel(None, 1.0)).count() == 0


def plain_score(forest, x):
    """Mean path length by walking each tree node by node."""
    total = 0.0
    for f, s, p in zip(forest.feature, forest.split, forest.path):
        k = 0
        while f[k] >= 0:
            k = 2 * k + 1 + (x[f[k]] >= s[k])
        total += p[k]
    n = forest.psi
    expected = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return 2 ** (-total / len(forest.path) / max(expected, 1e-9))


def test_verdicts_equal_plain_walks(spark, sf_dir):
    """Every verdict of the whole table again, and the threshold by trying every cut."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = Q.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    score = {i: plain_score(model.forest, Q.statistics(t)[1]) for i, t in text.items()}
    for r in Q.judge(docs, model).collect():
        want = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert abs(r.anomaly - score[r.doc_id]) < 1e-9 and r.base_failed == failed and r.kept == (not failed and r.anomaly <= model.threshold)
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in text}
    good, bad = ([score[i] for i, q in known.items() if q == v] for v in (1, 0))
    gain = lambda c: (lambda k, b: k + b if k >= Q.KEEP else -1)(sum(s <= c for s in good) / len(good), sum(s > c for s in bad) / len(bad))
    cuts = sorted({*good, *bad})
    assert gain(model.threshold) >= max(map(gain, [(a + b) / 2 for a, b in zip(cuts, cuts[1:])] + cuts[-1:])) - 1e-12


def test_ties_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "zz " * 30), (2, "x " * 200_000), (None, "m n o p q r s t u v w x")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, anomaly string, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    sample = Q.labelled_sample(docs, labels, "quality", 10).collect()
    assert sorted((r.doc_id, r.text[:3], r._value) for r in sample) == [(1, "a b", 1), (2, "x x", 0)]
    assert Q.labelled_sample(docs, labels, "quality", 1).count() == 1
    got = Q.judge(docs, Q.fit(docs, labels)).collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 4
