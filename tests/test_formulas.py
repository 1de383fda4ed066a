import random

from pyspark.sql import functions as F

from vellumlake.operators import audit as A
from vellumlake.operators import formulas as M
from vellumlake.operators import sequence as S
from vellumlake.operators import spatial, tree


def paragraph(spark, *chars):
    """(text, formula, left, right) on one baseline, or with more fields."""
    rows = [(1, i, c[0], c[1], "translate", 10.0, 10.0, float(c[2]), float(c[3]), 8.0, 18.0, c[4] if len(c) > 4 else None) for i, c in enumerate(chars)]
    return spark.createDataFrame(rows, "p int, pos int, unicode string, formula boolean, policy string, baseline double, size double, left double, right double, bottom double, top double, region int")


def test_fragments_stop_at_spaces_gaps_and_baselines(spark):
    c = paragraph(spark, ("2", False, 0, 4), ("x", True, 4, 8), (")", False, 9, 12), ("a", False, 12, 16), (" ", False, 16, 18), ("3", False, 18, 22))
    assert sorted(r.fragment for r in M.adjacent_fragments(c, ["p"]).collect()) == [")a", "2"]
    far = paragraph(spark, ("x", True, 0, 4), ("2", False, 9.5, 12))
    assert M.adjacent_fragments(far, ["p"]).count() == 0
    word = paragraph(spark, ("x", True, 0, 4), *((k, False, 4 + i, 5 + i) for i, k in enumerate("model")))
    assert [r.fragment for r in M.adjacent_fragments(word, ["p"]).collect()] == ["model"]
    off = word.withColumn("baseline", F.when(F.col("pos") == 1, 13.0).otherwise(F.col("baseline")))
    assert M.adjacent_fragments(off, ["p"]).count() == 0


def test_units_join_across_marks_out_of_place(spark):
    """A comma extracted before the formula that stands left of it, at the paragraph's end."""
    c = paragraph(spark, ("x", True, 0, 4), (",", False, 9, 11), ("y", True, 4, 9))
    (u,) = M.units(c, ["p"], F.lit(5.0)).collect()
    assert (u.start, u.end, u.text, u.left, u.right, u.expects_left, u.expects_right) == (0, 2, "xy", 0.0, 9.0, False, True)
    in_place = paragraph(spark, ("x", True, 0, 4), (",", False, 4, 6), ("y", True, 7, 9))
    assert sorted((r.start, r.end, r.expects_left, r.expects_right) for r in M.units(in_place, ["p"], F.lit(5.0)).collect()) == [(0, 0, False, True), (2, 2, True, False)]
    more = paragraph(spark, ("x", True, 0, 4, 7), (",", False, 9, 11), ("y", True, 4, 9, 7), ("w", False, 12, 15))
    assert [r.text for r in M.units(more, ["p"], F.lit(5.0)).collect()] == ["xy"]
    other = paragraph(spark, ("x", True, 0, 4, 7), (",", False, 9, 11), ("y", True, 4, 9, 8), ("w", False, 12, 15))
    assert sorted(r.text for r in M.units(other, ["p"], F.lit(5.0)).collect()) == ["x", "y"]


def test_radicals_attach_both_ways_only(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 10.0, 10.0), (1, 1, 100.0, 0.0, 105.0, 10.0, 10.0), (1, 2, 100.0, 5.0, 105.0, 10.0, 10.0)], "p int, radical int, left double, bottom double, right double, top double, size double")
    f = spark.createDataFrame([(1, 7, 6.0, 0.0, 9.0, 9.0), (1, 8, 106.0, 0.0, 110.0, 9.0), (1, 9, 200.0, 0.0, 210.0, 9.0)], "p int, formula int, left double, bottom double, right double, top double")
    assert [tuple(x) for x in M.attached_radicals(r, f, ["p"]).collect()] == [(1, 0, 7)]


def test_sequence_rule():
    free = lambda text: [(c, True, True) for c in text]
    engine = lambda text: [(c, True) for c in text]
    assert S.corresponding(free("abcd"), engine("xabd"), []) == ([0, 1, 3], [1, 2, 3])
    assert S.corresponding(free("abcd"), engine("xayz"), []) == ([], [])  # one of four
    assert S.corresponding(free("ab"), engine("a" + "-" * 15 + "b"), []) == ([0, 1], [0, 16])
    assert S.corresponding(free("ab"), engine("a" + "-" * 16 + "b"), []) == ([0], [0])  # too far, but equal places
    held = [("q", True, False), *free("ab")]
    assert S.corresponding(held, [("a", True), ("b", True), ("q", False), ("a", True), ("b", True)], [(0, 2)]) == ([1, 2], [3, 4])


def test_sequence_query_equals_the_rule_page_by_page(spark, sf_dir):
    from vellumlake import catalog

    got = {}
    for r in catalog.QUERIES["sequence_only"](spark, sf_dir).collect():
        got.setdefault((r.item_id, r.side), []).append(r.pos)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        n, text = r.item_id, r.text
        free = [i % 50 >= 10 for i in range(len(text))]
        walk = [(c, (n + i + 1) % 11 != 3, f) for i, (c, f) in enumerate(zip(text, free))]
        engine = [("#" if (n + i) % 6 == 0 else c, f) for i, (c, f) in enumerate(zip(text, free))]
        left, right = S.corresponding(walk, engine, [(i, i) for i, f in enumerate(free) if not f])
        assert sorted(got.get((n, "walk"), [])) == left and sorted(got.get((n, "engine"), [])) == right


def boxes(n, pages, seed):
    rng = random.Random(seed)
    return [(rng.randrange(pages), i, *(lambda x, y: (x, y, x + rng.randint(1, 60), y + rng.randint(1, 40)))(rng.randint(0, 300), rng.randint(0, 200))) for i in range(n)]


BOX = "page int, owner bigint, left int, bottom int, right int, top int"


def test_neighbours_and_collisions_equal_all_pairs(spark):
    rows = boxes(400, 2, 1) + [(0, 9001, -50, 0, 20, 150), (0, 9002, 25, 60, 30, 62)]
    df = spark.createDataFrame(rows, BOX).selectExpr("page", "owner", *(f"cast({c} as double) {c}" for c in ("left", "bottom", "right", "top")))
    want, hit = set(), set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1]:
                level, gap = a[5] > b[3] + 0.01 and b[5] > a[3] + 0.01, b[2] - a[4]
                if level and -0.01 <= gap <= 1.5 * max(a[5] - a[3], b[5] - b[3]) + 0.01:
                    want.add((a[0], a[1], b[1]))
                if a[1] < b[1] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]):
                    hit.add((a[0], a[1], b[1]))
    for cell in (16.0, 5.0, 500.0):
        assert sorted(map(tuple, spatial.line_neighbours(df, ["page"], "owner", cell).collect())) == sorted(want)
    assert sorted(map(tuple, spatial.collisions(df, ["page"], "owner").collect())) == sorted(hit)


def test_rigid_moves_among_common_characters_equal_all_pairs(spark):
    rng = random.Random(2)
    src = [(p, u, g, rng.choice("ab"), rng.randint(0, 8) / 4, rng.randint(0, 8) / 4) for p in range(2) for u in range(12) for g in range(3)]
    dst = [(p, c, x + (0.5 if u % 2 else g), y + 1) for p, u, g, c, x, y in src]
    want = []
    for p, u in sorted({(r[0], r[1]) for r in src}):
        glyphs, found = [r for r in src if r[:2] == (p, u)], {}
        for r in glyphs:
            for q in dst:
                if q[0] == p and q[1] == r[3]:
                    found.setdefault((round(q[2] - r[4], 3), round(q[3] - r[5], 3)), set()).add(r[2])
        full = [(dx * dx + dy * dy, dx, dy) for (dx, dy), s in found.items() if len(s) == len(glyphs)]
        if full:
            want.append((p, u, *min(full)[1:]))
    s = spark.createDataFrame(src, "page int, unit int, glyph int, char string, x double, y double")
    t = spark.createDataFrame(dst, "page int, char string, tx double, ty double")
    assert sorted(map(tuple, spatial.rigid_deltas(s, t, "unit", keys=["page"]).collect())) == want


def test_component_ink_takes_the_first_that_is_free(spark):
    rng = random.Random(3)
    near = lambda: (lambda x, y: (x, y, x + 5, y + 5))(rng.randint(0, 30) / 10, rng.randint(0, 30) / 10)
    comp = [(p, i, rng.choice(["vector", "image"]), *near()) for p in range(2) for i in range(30)]
    ink = [(p, i, rng.choice(["vector", "image"]), *near()) for p in range(2) for i in range(30)]
    want = []
    for p in range(2):
        used = set()
        for c in (c for c in comp if c[0] == p):
            by = A.TOLERANCES[c[2]]
            hit = next((k[1] for k in ink if k[0] == p and k[1] not in used and k[2] == c[2] and all(abs(a - b) <= by for a, b in zip(c[3:], k[3:]))), None)
            if hit is not None:
                used.add(hit)
                want.append((p, c[1], hit))
    schema = "page int, {} bigint, kind string, left double, bottom double, right double, top double"
    got = A.component_ink(spark.createDataFrame(comp, schema.format("lid")), spark.createDataFrame(ink, schema.format("rid")), "page")
    assert sorted(map(tuple, got.collect())) == want


def test_depth_limits(spark):
    import pytest

    chain = lambda n: spark.createDataFrame([(i, i - 1 if i else None, 5 if i == 0 else None, i) for i in range(n)], "node bigint, parent bigint, v int, ord bigint")
    assert tree.inherited(chain(17), "v", 16).where("node = 16").first().depth == 16
    with pytest.raises(Exception, match="too deep"):
        tree.inherited(chain(18), "v", 16).collect()
    got = {r.node: (r.v, r.complete) for r in tree.inherited(chain(18), "v", 16, lenient=True).collect()}
    assert got[16] == (5, True) and got[17] == (None, False)
    assert tree.outline(chain(17), 16).where("node = 16").first().path == list(range(17))
    with pytest.raises(Exception, match="too deep"):
        tree.outline(chain(18), 16).collect()
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        wide = spark.createDataFrame([(i, None if i == 0 else 0, None, i) for i in range(200)], "node bigint, parent bigint, v int, ord bigint")
        assert tree.outline(wide).count() == 200
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "parent bigint, child bigint")
    with pytest.raises(ValueError):
        tree.leaves(ring, spark.createDataFrame([(1,)], "node bigint"))


def test_formulas_grow_by_digits_that_belong_to_them(spark):
    def grown(*chars):
        rows = [(1, i, *c) for i, c in enumerate(chars)]
        c = spark.createDataFrame(rows, "p int, pos int, unicode string, formula boolean, policy string, size double, baseline double, left double, right double, implicit_space_before boolean")
        return [(r.pos, r.anchor, r.evidence) for r in M.expanded(c, ["p"]).where("anchor is not null").orderBy("pos").collect()]

    def char(text, at, formula=False, policy="translate", size=10.0, up=0.0, space=False):
        return (text, formula, policy, size, 100.0 + up, 10.0 * at, 10.0 * at + 10, space)

    # a script and the rest of its number; the letter after them stays
    assert grown(char("x", 0, True), char("1", 1, size=6.0, up=3.0), char("2", 2, size=6.0, up=3.0), char("m", 3)) == [(1, 0, "script_baseline"), (2, 0, "contiguous_digit_run")]
    # digits go on a formula's number up to a space, a gap, or what isn't translated
    assert grown(char("4", 0, True), char("5", 1), char("6", 2, space=True)) == [(1, 0, "contiguous_digit_run")]
    assert grown(char("4", 0, True), char("5", 2)) == []
    assert grown(char("4", 0, True), char("5", 1, policy="passthrough"), char("6", 2)) == []
    # no formula, no growth; full-size digits beside a letter are none of it; small ones too far off its baseline either
    assert grown(char("4", 0), char("5", 1)) == []
    assert grown(char("x", 0, True), char("5", 1)) == []
    assert grown(char("x", 0, True), char("5", 1, size=6.0, up=8.0)) == []
    # a digit whose place isn't known
    assert grown(char("4", 0, True), ("5", False, "translate", 10.0, None, None, None, False)) == []
