import math
import random

import pytest
from pyspark.sql import functions as F

from vellumlake.functions.numeric import glyph_width
from vellumlake.operators import audit as A
from vellumlake.operators import events as E


def test_glyphs_take_the_first_free_one(spark):
    random.seed(1)
    left = [(p, c, i, random.random(), random.random()) for i, (p, c) in enumerate((p, c) for p in range(2) for c in "ab" for _ in range(12))]
    right = [(p, c, i, random.random(), random.random()) for i, (p, c) in enumerate((p, c) for p in range(2) for c in "ab" for _ in range(12))]
    used, want = set(), []
    for p, c, i, x, y in left:
        for q, d, j, u, v in right:
            if (p, c) == (q, d) and j not in used and abs(x - u) <= 0.25 and abs(y - v) <= 0.25 and math.hypot(x - u, y - v) <= 0.25:
                used.add(j)
                want.append((p, i, j))
                break
    l = spark.createDataFrame(left, "page int, char string, lid bigint, lx double, ly double")
    r = spark.createDataFrame(right, "page int, char string, rid bigint, rx double, ry double")
    assert sorted(map(tuple, A.glyph_matches(l, r, "page").collect())) == sorted(want)


def test_support_spreads_to_a_fixpoint(spark):
    cand = [(i, i) for i in range(10)] + [(20, 20), (21, 21), (21, 22)]
    accepted = {(3, 3)}
    while True:
        free = [(a, b) for a, b in set(cand) if a not in {x for x, _ in accepted} and b not in {y for _, y in accepted}]
        new = {(a, b) for a, b in free if sum(x == a for x, _ in free) == sum(y == b for _, y in free) == 1 and any((a + d, b + d) in accepted for d in (-1, 1))}
        if not new:
            break
        accepted |= new
    df = spark.createDataFrame(cand, "l bigint, r bigint")
    got = A.supported_pairs(df, df.where("l = 3"))
    assert sorted(map(tuple, got.collect())) == sorted(accepted - {(3, 3)})


def test_settings(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "f string, e string")
    assert [r[0] for r in df.select(A.preferred(F.col("f"), F.col("e"), F.lit("d"))).collect()] == ["a", "b", "d"]
    with pytest.raises(Exception, match="empty setting"):
        df.select(A.preferred(F.lit(" "), F.col("e"))).collect()


def test_holes(spark):
    gaps = spark.createDataFrame([(1.0, 9.0), (None, 5.0)], "gap_left double, gap_right double")
    assert tuple(A.holes(gaps, F.lit(4.0), F.lit(2.0)).first()) == (2, 28.0)


def test_progress_of_stages(spark):
    rows = [(1, "scan", "stage_started", None, None), (1, "scan", "page_progress", 0, 2), (1, "scan", "page_progress", 1, 2), (1, "scan", "page_progress", 1, 2), (1, "scan", "stage_finished", None, None), (1, "write", "stage_started", None, None), (1, None, "result", None, None)]
    df = spark.createDataFrame(rows, "run int, stage string, event string, page_index int, total_pages int")
    assert sorted(tuple(r) for r in E.stage_progress(df, ["run"]).collect()) == [(1, "scan", 1, 1, 2, 2, True), (1, "write", 1, 0, 0, None, False)]
    assert E.stage_progress(df.limit(0), ["run"]).count() == 0


def test_length_of_the_first_array(spark):
    rows = [(1, 0, '{"kept":3}'), (1, 1, '{"kept":[1,[2]]}'), (1, 2, '{"kept":[]}'), (2, 0, "not json"), (2, 1, None), (3, 5, '{"kept":[]}')]
    df = spark.createDataFrame(rows, "run int, at int, value string")
    assert sorted(tuple(r) for r in E.summary_array_length(df, ["run"], "at", "kept").collect()) == [(1, 2), (2, 0), (3, 0)]


def test_widths_are_rounded_half_up(spark):
    df = spark.createDataFrame([(1, 2048), (1, 3), (500, 1000), (1, 2000), (65535, 1), (5, 0), (None, 5)], "a int, u int")
    assert [r[0] for r in df.select(glyph_width(F.col("a"), F.col("u"))).collect()] == [0, 333, 500, 1, 65535000, None, None]
