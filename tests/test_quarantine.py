"""Bad geometries set aside, typed properties, joins by shape and statistics from footers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exact import intersects, overlap_area
from helpers import collection, documents, feature, square
from rooftally.functions.simplify import _crosses, _near_pairs
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators import shape_join
from rooftally.sources import aois as A
from rooftally.sources import quarantine as Q

MP = "array<array<array<array<double>>>>"


def shapes():
    ring = square(0.0, 0.0)
    return {1: [[ring]], 2: [[ring[:-1]]], 3: [[ring[:2] + ring[:1]]], 4: None, 5: [[ring, ring[:-1]]], 6: [[ring], [square(1.0, 1.0)]],
            7: [[[[0.0, float("nan")], *ring[1:4], [0.0, float("nan")]]]], 8: []}


@pytest.mark.parametrize("wkb", [False, True])
def test_rings_and_torn_bytes(spark, tmp_path, wkb):
    df = spark.createDataFrame(list(shapes().items()), f"id int, geometry {MP}")
    want = {1: None, 2: Q.OPEN_RING, 3: Q.SHORT_RING, 4: None, 5: Q.OPEN_RING, 6: None, 7: Q.NO_NUMBER, 8: None}
    if wkb:
        df = df.withColumn("geometry", multipolygon_to_wkb("geometry"))
        torn = df.where("id = 1").select(F.lit(9).alias("id"), F.expr("substring(geometry, 1, 30)").alias("geometry"))
        df = df.union(torn).union(df.where("id = 1").select(F.lit(10).alias("id"), F.expr("cast('x' AS binary)").alias("geometry")))
        want |= {9: "truncated WKB geometry", 10: "truncated WKB geometry"}
    done = Q.set_aside(df.repartition(3), path=str(tmp_path / "q"))
    assert {r.id: r.problem for r in done.bad.collect()} == {k: v for k, v in want.items() if v}
    assert sorted(r.id for r in done.sound.collect()) == sorted(k for k, v in want.items() if not v)
    assert done.sound.dtypes == df.dtypes and (done.n_sound, done.n_bad) == (done.sound.count(), done.bad.count())


def test_nothing_bad_and_nothing_at_all(spark):
    df = spark.createDataFrame([(1, [[square(0.0, 0.0)]])], f"id int, geometry {MP}")
    assert Q.set_aside(df).bad.count() == 0 and Q.set_aside(df.where("false")).sound.count() == 0


def test_properties_keep_their_types(spark):
    docs = documents(spark, a=collection(feature([square(0.0, 0.0)], whole=7, big=2 ** 60, text="7", yes=True, no=False, none=None, real=2.5, exp=1e3, list=[1, "a"], obj={"k": 1})),
                     bare='{"type":"FeatureCollection","features":[{"type":"Feature"}]}', text="<html>")
    rows = {r.slug: r for r in A.typed_properties(docs).select(
        "slug", F.to_json("properties").alias("json"), F.transform_values("properties", lambda k, v: F.schema_of_variant(v)).alias("kinds")).collect()}
    assert rows["a"].kinds == {"whole": "BIGINT", "big": "BIGINT", "text": "STRING", "yes": "BOOLEAN", "no": "BOOLEAN", "none": "VOID", "real": "DOUBLE",
                               "exp": "DOUBLE", "list": "STRING", "obj": "STRING"}
    import json
    assert json.loads(rows["a"].json) == {"whole": 7, "big": 2 ** 60, "text": "7", "yes": True, "no": False, "none": None, "real": 2.5, "exp": 1000.0,
                                          "list": '[1,"a"]', "obj": '{"k":1}'}
    assert rows["bare"].kinds == {} and rows["text"].kinds == {}


def test_pairs_by_shape_against_exact_arithmetic(spark):
    rng = random.Random(6)
    def some(n):
        out = []
        for _ in range(n):
            x, y, s = rng.randrange(16) / 8, rng.randrange(16) / 8, rng.choice((0.125, 0.25, 0.5, 1.0))
            out.append(rng.choice(([[square(x, y, s)]], [[square(x, y, s), square(x + s / 4, y + s / 4, s / 2)]],
                                   [[[[x, y], [x + s, y], [x, y + s], [x, y]]]], [[square(x, y, s / 4)], [square(x + s / 2, y, s / 4)]])))
        return out
    left, right = some(40) + [None, []], some(30)
    a, b = (spark.createDataFrame(list(enumerate(v)), f"{n} int, geometry {MP}") for v, n in ((left, "a"), (right, "b")))
    got = {(r.a, r.b): r.shared_deg2 for r in shape_join.shape_pairs(a, b, "a", "b").collect()}
    want = {(i, j): float(overlap_area(p, q)) for i, p in enumerate(left) if p for j, q in enumerate(right) if intersects(p, q)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    alone = shape_join.only_in_first_by_shape(a.union(a), b, least_share=0.25)
    covered = {i for (i, j), s in want.items() if s > 0.25 * float(overlap_area(left[i], left[i]))}
    assert sorted(r.a for r in alone.collect()) == sorted(2 * [i for i in range(len(left)) if i not in covered])


def test_near_pairs_hold_all_that_meet():
    rng = np.random.default_rng(0)
    for n in (2, 3, 200):
        x, y = rng.random((2, n))
        w, h = rng.random((2, n)) ** 4
        meet = {(a, b) for a in range(n) for b in range(a + 1, n) if x[a] + w[a] >= x[b] and x[b] + w[b] >= x[a] and y[a] + h[a] >= y[b] and y[b] + h[b] >= y[a]}
        got = {(min(p), max(p)) for i, j in _near_pairs(x, x + w, y, y + h) for p in zip(i.tolist(), j.tolist())}
        assert meet <= got


def test_crossings_of_a_ring_of_a_million_vertices():
    n = 1_000_000
    a = 2 * np.pi * np.arange(n + 1) / n
    r = 1 + 0.1 * np.sin(1000 * a)
    x, y = r * np.cos(a), r * np.sin(a)
    x[-1], y[-1] = x[0], y[0]
    ring = np.zeros(n + 1, int)
    assert not _crosses(x, y, ring)
    x[500_000], y[500_000] = 0.0, 2.0  # one vertex far across the ring
    assert _crosses(x, y, ring)
