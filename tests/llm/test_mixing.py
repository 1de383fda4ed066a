import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from vellumlake.llm import common
from vellumlake.llm import mixing as M


def docs(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(2000)] + [(5000, None, "s1"), (5001, "", None), (5002, "a b", None), (5002, "a b", None)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, lang string, _n int"), rows


def places(df, mix):
    return M.assignments(M.narrow(df), mix)


def shares(rows):
    t = Counter()
    for _, x, s in rows:
        t[s or ""] += len((x or "").split())
    return t


def test_bisection_meets_its_targets(spark):
    df, rows = docs(spark)
    t = shares(rows)
    total = sum(t.values())
    entropy = lambda a: (lambda q: -sum(x * math.log(x) for x in q))([(v / total) ** a / sum((u / total) ** a for u in t.values()) for v in t.values()])
    mix = M.plan(df, target_entropy=0.9)
    assert mix.total == total and entropy(mix.alpha) == pytest.approx(0.9 * math.log(len(t)), abs=1e-6)
    mix = M.plan(df, max_repetition=1.5)
    low, high = min(t.values()), max(t.values())
    assert (low / high) ** (mix.alpha - 1) == pytest.approx(1.5, abs=1e-6)
    assert M.plan(df).alpha == 1.0 and M.plan(df, target_entropy=1.0).alpha == pytest.approx(0.0, abs=1e-6)


def test_realised_budgets(spark):
    df, rows = docs(spark)
    mix = M.plan(df, target_entropy=0.95, max_repetition=3.0)
    plan = {r.source: r for r in mix.plan.collect()}
    placed = places(df, mix).collect()
    tokens, seen = Counter(), Counter()
    blocks = defaultdict(list)
    for r in placed:
        tokens[r.source or ""] += r.n_tokens
        seen[r.doc_id] += 1
        blocks[r.source, r.block, r.epoch].append(r.position)
    for s, p in plan.items():
        n_blocks = max(1, -(-p.docs // M.BLOCK))
        assert abs(tokens[s] - p.target_tokens) <= 8 * n_blocks, (s, tokens[s], p)
        assert p.epochs >= 1 - 1e-9
    assert set(seen) == {r[0] for r in rows}  # no document is left out
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values())
    assert seen[5002] >= 2
    again = Counter(r.doc_id for r in M.mixed(df, mix).collect())
    assert again == seen and M.mixed(df, mix).columns == df.columns


def test_budget_below_the_corpus(spark):
    df, rows = docs(spark)
    total = sum(shares(rows).values())
    got = places(df, M.plan(df, budget_tokens=total / 4)).collect()
    assert sum(r.n_tokens for r in got) == pytest.approx(total / 4, rel=0.02)


def test_few_sources(spark):
    df, _ = docs(spark)
    one = df.where("source = 'hot'")
    mix = M.plan(one, 0.5, 2.0)
    assert mix.alpha == 1.0 and places(one, mix).count() == one.count() and mix.met_entropy and mix.met_repetition
    none = df.limit(0)
    assert places(none, M.plan(none, 0.5, 2.0)).count() == 0
    blank = df.where("text is null")
    assert M.mixed(blank, M.plan(blank, 0.5, 2.0)).count() == 1


def test_a_target_that_no_weights_meet_is_said(spark):
    df, rows = docs(spark)
    mix = M.plan(df, target_entropy=0.2)
    assert mix.alpha == 1.0 and not mix.met_entropy and mix.met_repetition
    mix = M.plan(df, target_entropy=0.95)
    assert mix.met_entropy
    mix = M.plan(df, target_entropy=1.0, max_repetition=1.0)
    assert not mix.met_entropy and mix.met_repetition and mix.repetition == pytest.approx(1.0)


def test_clashing_columns_come_out(spark):
    names = ["_n", "_source", "_epochs", "_block", "_blocks", "_key", "_times", "_copy", "_hot", "_salt", "_cold", "odd.name"]
    rows = [(i % 3, "a b c", f"s{i % 2}", *range(12)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = M.mixed(df, M.plan(df, 0.9, 2.0))
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(12))}


def test_rows_without_ids_and_long_texts_are_dealt_out(spark):
    df = spark.createDataFrame([(None, f"w{i} " * (1 + i % 3), "s") for i in range(5000)] + [(7, "same", "s")] * 20 + [(8, "x " * 400_000, "s")], "doc_id bigint, text string, source string")
    got = places(df, M.plan(df, 0.9, 2.0)).collect()
    assert len(got) == 5021 and len({r.block for r in got}) == 10
    assert len({r.block for r in got if r.doc_id == 7}) == 1 and max(r.n_tokens for r in got) == 400_000


def spark_hash(*values):
    """Spark's xxhash64 of longs and texts."""
    h = 42
    for v in values:
        raw = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - 2**64 if h >= 2**63 else h


def brute(rows, target, limit, seed=1):
    """Shares, bisection, epochs, blocks and permutations by plain loops."""
    tokens, docs_ = Counter(), Counter()
    for _, x, s in rows:
        tokens[s or ""] += len((x or "").split())
        docs_[s or ""] += 1
    total, live = sum(tokens.values()), [t for t in tokens.values() if t]
    weights = lambda a: [(t / total) ** a / sum((u / total) ** a for u in live) for t in live]
    entropy = lambda a: -sum(x * math.log(x) for x in weights(a))

    def least(met):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if met(mid) else (mid, high)
        return high

    alpha = max(least(lambda a: entropy(a) <= target * math.log(len(live))), least(lambda a: (min(live) / max(live)) ** (a - 1) <= limit))
    z = sum((t / total) ** alpha for t in live)
    weight = {s: (t / total) ** alpha / z if t else 0.0 for s, t in tokens.items()}
    budget = max(t / weight[s] for s, t in tokens.items() if t)
    out = Counter()
    for s in tokens:
        epochs = weight[s] * budget / tokens[s] if tokens[s] else 1.0
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
        blocks, n_blocks = defaultdict(list), max(1, -(-docs_[s] // M.BLOCK))
        for i, x, of in rows:
            if (of or "") == s:
                key = spark_hash("" if i is None else str(i), x or "")
                blocks[spark_hash(struct.pack("<i", seed), key) % n_blocks].append((key, len((x or "").split()), i))
        for b, members in blocks.items():
            for epoch in range(1, math.ceil(epochs) + 1):
                members.sort(key=lambda m: (spark_hash(struct.pack("<i", seed), epoch, m[0]), m[0]))
                share, seen = (epochs - math.floor(epochs)) * sum(n for _, n, _ in members), 0
                for position, (key, n, i) in enumerate(members, 1):
                    # equal rows go together, by the last of them
                    seen = sum(m[1] for m in members[: position + sum(m[0] == key for m in members[position:])])
                    if epoch <= epochs or seen - n / 2 < share:
                        out[i, s, n, epoch, b, position] += 1
    return out


@pytest.mark.parametrize("bound", [None, 0])
def test_every_place_equals_plain_loops(spark, monkeypatch, bound):
    """Hot and small sources, repeated, null and equal rows; with and without broadcasts."""
    monkeypatch.setattr(M, "BLOCK", 40)
    if bound == 0:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 9), "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])) for i in range(600)] + [(3, "w w", "a")] * 5 + [(None, f"n{i}", "b") for i in range(50)] + [(9000, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter((r.doc_id, r.source or "", r.n_tokens, r.epoch, r.block, r.position) for r in places(df, M.plan(df, 0.95, 3.0)).collect())
    assert got == brute(rows, 0.95, 3.0)
