"""Footprints that don't fit an area's tiles, by the shuffled way, against the broadcast way and exact arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from exact import intersects, overlap_area
from helpers import collection, documents, feature, square
from rooftally.functions import geometry as G
from rooftally.operators import grid
from rooftally.operators import spatial_join as J
from rooftally.sources.aois import read_aois

MP = "array<array<array<array<double>>>>"


def star(rng, x, y, r, n):
    """A ring around a point, of varying radius."""
    radii = [r * (0.5 + rng.random() / 2) for _ in range(n)]
    ring = [[x + q * math.cos(2 * math.pi * k / n), y + q * math.sin(2 * math.pi * k / n)] for k, q in enumerate(radii)]
    return ring + ring[:1]


def disc(n, r=2.0, x=-50.0, y=-20.0):
    ring = [[x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return ring + ring[:1]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(11)
    areas = {f"s{k}": [star(rng, -50 + k % 3, -20 + k // 3, rng.choice((0.02, 0.2, 0.5)), 9)] for k in range(6)}
    areas["holed"] = [square(-47.0, -21.0, 0.5), square(-46.875, -20.875, 0.25)]
    shapes = [[[star(rng, rng.uniform(-51, -46), rng.uniform(-21, -18), rng.choice((0.001, 0.05, 0.4, 2.0)), 7)]] for _ in range(50)]
    shapes += [[[square(-47.5, -21.0, 0.5)]], [[square(-46.8, -20.8, 0.1)]], [[square(-46.875, -20.875, 0.25)]], [[square(-46.5, -20.5, 1.0)]]]
    shapes += [[[square(-60.0, -40.0, 30.0), square(-52.0, -22.0, 0.5)]], shapes[5], shapes[5]]
    tiles = J.tile_aois(read_aois(documents(spark, **{n: collection(feature(rings)) for n, rings in areas.items()})))
    rows = spark.createDataFrame([(k, g, "g") for k, g in enumerate(shapes)], f"id int, geometry {MP}, bf_source string")
    return areas, shapes, tiles, rows


@pytest.fixture(scope="module")
def cut(spark, mixed):
    """The same areas, all counted as long: tiled at one level, and cut."""
    old, grid.MANY_EDGES = grid.MANY_EDGES, 3
    try:
        areas = {n: collection(feature(rings)) for n, rings in mixed[0].items()}
        tiles = J.tile_aois(read_aois(documents(spark, **areas)))
    finally:
        grid.MANY_EDGES = old
    assert tiles.n_long == tiles.n_aois == len(areas)
    return tiles


def test_all_ways_agree_with_exact_arithmetic(mixed, cut):
    areas, shapes, tiles, rows = mixed
    want = {(k, n): overlap_area(g, [rings]) for n, rings in areas.items() for k, g in enumerate(shapes) if intersects(g, [rings])}
    for t, limit in ((tiles, J.BROADCAST_BYTES), (tiles, 0), (cut, 0)):
        got = {(r.id, r.aoi): r.area_deg2 for r in J.clip(rows, t, ("id",), broadcast_bytes=limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[p] == pytest.approx(float(want[p]), rel=1e-6, abs=1e-12) for p in want)


def test_shapes_kept_columns_and_copies(mixed, cut):
    _, _, tiles, rows = mixed
    twice = rows.union(rows.where("id % 7 = 0"))
    shapes = J.clip(twice, cut, ("id", "bf_source"), with_geometry=True, broadcast_bytes=0).withColumn("measured", F.expr(G.polygon_area("mp")))
    found = shapes.select("id", "aoi", "bf_source", "area_deg2", "measured").collect()
    plain = J.clip(twice, tiles, ("id", "bf_source")).select("id", "aoi").collect()
    assert sorted(tuple(r)[:2] for r in found) == sorted(map(tuple, plain))
    assert all(r.bf_source == "g" and r.measured == pytest.approx(r.area_deg2, rel=1e-6, abs=1e-12) for r in found)


@pytest.mark.parametrize("width", [1e-3, 1e-7])
def test_a_tiny_area_inside_a_footprint_by_the_shuffled_way(spark, width, monkeypatch):
    tiny = collection(feature([[[-44.5, -20.5], [-44.5 + width, -20.5], [-44.5, -20.5 + width], [-44.5, -20.5]]]))
    tiles = J.tile_aois(read_aois(documents(spark, tiny=tiny)))
    f = spark.createDataFrame([(1, [[square(-45.0, -21.0, 1.0)]]), (2, [[square(-44.4, -20.4, 1.0)]])], f"id int, geometry {MP}")
    monkeypatch.setattr(grid, "MANY_EDGES", 3)
    for t in (tiles, J.tile_aois(read_aois(documents(spark, tiny=tiny)))):
        assert [(r.id, r.area_deg2 < 1e-6) for r in J.clip(f, t, ("id",), broadcast_bytes=0).collect()] == [(1, True)]


def test_contact_on_the_lines_of_the_grid(spark, monkeypatch):
    """Large squares that touch an area from each side, along tile borders: matches without area."""
    tiles = J.tile_aois(read_aois(documents(spark, a=collection(feature([square(-45.0, -20.0, 1.0)])))))
    sides = {1: (-46.0, -20.0), 2: (-44.0, -20.0), 3: (-45.0, -21.0), 4: (-45.0, -19.0), 5: (-46.0, -21.0), 6: (-44.0, -19.0), 7: (-43.5, -20.0)}
    f = spark.createDataFrame([(k, [[square(x, y, 1.0)]]) for k, (x, y) in sides.items()], f"id int, geometry {MP}")
    monkeypatch.setattr(grid, "MANY_EDGES", 3)
    long = J.tile_aois(read_aois(documents(spark, a=collection(feature([square(-45.0, -20.0, 1.0)])))))
    for t, limit in ((tiles, J.BROADCAST_BYTES), (tiles, 0), (long, 0)):
        assert sorted((r.id, r.area_deg2) for r in J.clip(f, t, ("id",), broadcast_bytes=limit).collect()) == [(k, 0.0) for k in range(1, 7)]


def test_no_row_holds_more_of_a_long_boundary_than_a_tile(spark):
    """An area of 100,000 vertices and large footprints: no tile has over a hundredth of the edges, and sizes are right."""
    n = 100_000
    tiles = J.tile_aois(read_aois(documents(spark, disc=collection(feature([disc(n)])))))
    assert tiles.n_long == 1 and tiles.n_aois == 1
    most, total = tiles.tiles.agg(F.max(F.size("segs")), F.sum(F.size("segs"))).first()
    assert n <= total < 2 * n and most <= n / 100
    rng = random.Random(4)
    spots = [(rng.uniform(-53, -48), rng.uniform(-23, -18), rng.uniform(0.3, 1.5)) for _ in range(25)]
    f = spark.createDataFrame([(k, [[square(*s)]]) for k, s in enumerate(spots)], f"id int, geometry {MP}")
    coarse = [[disc(200)]]
    got = {r.id: r.area_deg2 for r in J.clip(f, tiles, ("id",)).collect()}
    want = {k: float(overlap_area([[square(*s)]], coarse)) for k, s in enumerate(spots) if intersects([[square(*s)]], coarse)}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-3, abs=3e-3) for k in want)


def test_a_small_boundary_has_one_top_row(mixed):
    _, _, tiles, _ = mixed
    assert tiles.n_long == 0 and tiles.tiles.where(F.col("level") == grid.TOP).count() == tiles.n_aois
    assert all(last == base + grid.COARSER for base, last in tiles.kinds)
