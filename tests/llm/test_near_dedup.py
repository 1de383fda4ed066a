import random
from itertools import combinations

import numpy as np
import pytest

from vellumlake.llm import common
from vellumlake.llm import near_dedup as N


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width):
    sets = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df, **k):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.components(df, **k).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_whole_table_equals_brute_force(spark, sf_dir, width):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs, width=width) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_groups_that_stars_part(spark, monkeypatch):
    """Near copies around the threshold: many members of a bucket aren't similar to its centre."""
    monkeypatch.setattr(N, "PAIRS_PER_MEMBER", 0)
    monkeypatch.setattr(N, "BLOCK", 16)
    random.seed(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for k in random.sample(range(120), random.choice([2, 5, 7, 8, 9, 12])):
            words[k] = f"x{random.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df, width=2) == brute(rows, 2)


def test_a_hot_bucket_without_broadcasts(spark, monkeypatch):
    """Many different texts with one beginning, every size bound at its least: hot keys and hot ends of edges are dealt out."""
    for where, name, value in ((common, "BROADCAST_BYTES", 0), (common, "HOT_ROWS", 3), (N, "FEW", 0), (N, "SALTS", 2), (N, "BLOCK", 8), (N, "PAIRS_PER_MEMBER", 0)):
        monkeypatch.setattr(where, name, value)
    random.seed(5)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(90):
        words = list(base)
        for k in random.sample(range(100), random.choice([3, 6, 9, 14])):
            words[k] = f"x{random.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, rows[i % 3][1]) for i in range(30)] + [(3000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(df, width=2) == brute(rows, 2)


def test_rows_grow_with_members_not_pairs(spark, monkeypatch):
    """150 long texts that bitmaps can't tell from similar ones: 11,175 pairs, each in many buckets, and two links."""
    counts, real = [], type(spark.range(0)).mapInArrow

    def counted(self, fn, schema, *rest, **more):
        made = spark.sparkContext.accumulator(0)
        counts.append(made)

        def run(batches):
            for batch in fn(batches):
                made.add(batch.num_rows)
                yield batch

        return real(self, run, schema, *rest, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    random.seed(7)
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in range(1500)]
        for k in random.sample(range(1500), 65):
            words[k] = f"x{random.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(500, rows[70][1] + " more"), (501, rows[90][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df, width=2) == brute(rows, 2)
    assert max(c.value for c in counts) <= N.BANDS * len(rows)


def test_members_meet_by_rare_elements(spark, monkeypatch):
    """Buckets with many blocks outside their largest component."""
    for name, value in (("BLOCK", 8), ("MOST_BLOCKS", 0)):
        monkeypatch.setattr(N, name, value)
    random.seed(11)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(80):
        words = list(base)
        for k in random.sample(range(100), random.choice([4, 6, 8, 12])):
            words[k] = f"x{random.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df, width=2) == brute(rows, 2)


def test_looked_up_equals_a_join(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "hot" if i % 3 else f"k{i}", i) for i in range(400)], "id bigint, k string, _hot bigint")
    table = rows.where("k is not null").groupBy("k").count().select("k", "count", "k").toDF("k", "n", "v")
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(table, ["k"], how).select("id", "k", "_hot", "n", "v").collect()))
        for bound, least in ((None, 1000), (0, 1000), (0, 5)):
            common.HOT_ROWS, before = least, common.HOT_ROWS
            try:
                got_ = common.looked_up(rows, table, ["k"], common.F.col("id"), count="n", how=how, bound=bound)
                assert sorted(map(str, got_.select("id", "k", "_hot", "n", "v").collect())) == want
            finally:
                common.HOT_ROWS = before


def test_odd_rows(spark):
    rows = [(5, "a b c"), (3, "A B C"), (4, "one"), (1, "ONE"), (8, None), (9, ""), (10, " \t"), (11, "É b c"), (12, "é b c"), (13, "x " * 40000), (14, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, keys string")
    assert got(df, width=2) == brute(rows, 2)
    assert N.components(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "zz y")], "doc_id bigint, text string")
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in N.components(twice, width=2).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_bitmap_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 5000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        differ = int(np.bitwise_count((N.bitmap(a) ^ N.bitmap(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_sketches_collide_as_they_should():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(200):
        a = np.unique(N.mix(rng.integers(0, 2**63, 100).astype(np.uint64)))
        b = np.unique(np.concatenate([a[:-10], N.mix(rng.integers(0, 2**63, 10).astype(np.uint64))]))
        hits += bool((N.bands(a) == N.bands(b)).any())
    assert hits == 200
    one = np.array([7], np.uint64)
    assert len(set(N.bands(one).tolist())) == N.BANDS


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a bigint, b bigint")
    assert {r.node: r.root for r in N.connected(links).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
