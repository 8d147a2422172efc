import random

import pytest

from rooftally.operators import box_join as B

BOXES = "id int, minx double, miny double, maxx double, maxy double"


def some(rng, n, sizes=(0.0, 0.001, 0.01, 0.3, 2.0, 20.0)):
    out = []
    for k in range(n):
        w, h = rng.choice(sizes) * rng.random(), rng.choice(sizes) * rng.random()
        x, y = rng.uniform(-60, 60 - w), rng.uniform(-60, 60 - h)
        if k % 3 == 0:  # on the lines of the grid, so that boxes touch
            x, y, w, h = (round(v * 4) / 4 for v in (x, y, w, h))
        out.append((k, x, y, x + w, y + h))
    return out


def meet(a, b):
    return a[3] >= b[1] and a[1] <= b[3] and a[4] >= b[2] and a[2] <= b[4]


@pytest.mark.parametrize("huge", [False, True])
def test_pairs_and_semi_join_against_all_pairs(spark, huge):
    rng = random.Random(3)
    left, right = some(rng, 400), some(rng, 150)
    if huge:
        left += [(1000, -180.0, -90.0, 180.0, 90.0), (1001, -50.0, -50.0, 50.0, 50.0)]
        right += [(2000, -100.0, -80.0, 0.0, 0.0)]
    nulls = [(3000, None, 0.0, 1.0, 1.0), (3001, None, None, None, None)]
    a, b = spark.createDataFrame(left + nulls, BOXES), spark.createDataFrame(right + nulls, BOXES)
    want = sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    assert sorted(tuple(r) for r in B.box_pairs(a, b).select("l.id", "r.id").collect()) == want
    got = B.meeting_any(a.union(a), b)
    assert got.columns == a.columns and sorted(r.id for r in got.collect()) == sorted(2 * list({x for x, _ in want}))


def test_no_boxes(spark):
    a, none = spark.createDataFrame(some(random.Random(1), 5), BOXES), spark.createDataFrame([], BOXES)
    assert B.meeting_any(a, none).count() == 0 and B.meeting_any(none, a).count() == 0
    assert B.box_pairs(a, none).count() == 0 and B.box_pairs(none, a).count() == 0


def test_one_huge_box_does_not_widen_the_cells_of_others(spark):
    """The cells that are looked up grow by the huge box's own few, not by its extent for every other box."""
    rng = random.Random(8)
    small = some(rng, 300, (0.001, 0.01))
    a = spark.createDataFrame(small, BOXES)
    b = spark.createDataFrame(small[:50], BOXES)
    huge = spark.createDataFrame([(-1, -50.0, -50.0, 50.0, 50.0)], BOXES)
    before = B._registered(a, "l", B.classes_in_use(b)).count()
    after = B._registered(a.union(huge), "l", B.classes_in_use(b)).count()
    assert after - before <= 4
    assert B._registered(b, "r", B.classes_in_use(a.union(huge))).count() <= B._registered(b, "r", B.classes_in_use(a)).count() + 4 * 50


def test_a_class_reaches_its_boxes():
    from rooftally.operators import grid

    assert max(grid.LEVELS) + 1 == grid.TOP and grid.FINEST * grid.STEP ** grid.TOP >= 360


def test_semi_join_repeats_no_scan(spark, tmp_path):
    spark.createDataFrame(some(random.Random(2), 50), BOXES).write.parquet(str(tmp_path / "f"))
    areas = spark.createDataFrame(some(random.Random(4), 20), BOXES)
    plan = B.meeting_any(spark.read.parquet(str(tmp_path / "f")), areas)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
