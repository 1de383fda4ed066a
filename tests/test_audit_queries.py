"""Registered queries without SQL, whole, against plain loops over the smallest tables."""

from collections import Counter, defaultdict

from vellumlake import catalog


def test_rigid_bodies_equal_a_plain_search(spark, sf_dir):
    least = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        p, s = least.get((r[0], r[1]), (r[2], r[3]))
        least[r[0], r[1]] = min(p, r[2]), min(s, r[3])
    moves = defaultdict(list)
    for (unit, glyph), (p, s) in least.items():
        x, y = p % 100, s % 100
        to = x + 2 + (glyph if unit % 3 == 0 else 0), y + 1
        moves[unit].append((float(to[0] - x), float(to[1] - y)))
    want = sorted((unit, *each[0]) for unit, each in moves.items() if len(set(each)) == 1)
    got = sorted(map(tuple, catalog.QUERIES["rigid_bodies"](spark, sf_dir).collect()))
    assert got == want and any(unit % 20 for unit, _, _ in got)


def test_supported_alignment_equals_a_plain_loop(spark, sf_dir):
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    rest = {(i, i + (i % 13 == 0)) for i in ids}
    anchors = {(a, b) for a, b in rest if a % 100 == 1}
    accepted, turns = set(anchors), 0
    while True:
        ls, rs = {a for a, _ in accepted}, {b for _, b in accepted}
        free = {(a, b) for a, b in rest if a not in ls and b not in rs}
        l, r = Counter(a for a, _ in free), Counter(b for _, b in free)
        new = {(a, b) for a, b in free if l[a] == r[b] == 1 and ((a - 1, b - 1) in accepted or (a + 1, b + 1) in accepted)}
        if not new:
            break
        accepted, turns = accepted | new, turns + 1
    got = catalog.QUERIES["supported_alignment"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(accepted - anchors) and turns > 8
