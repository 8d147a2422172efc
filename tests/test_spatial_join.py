import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import collection, documents, feature, lot_corner, square
from exact import intersects, overlap_area
from rooftally.functions import geometry as G
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators import spatial_join as J
from rooftally.sources.aois import read_aois
from rooftally.sources.footprints import prepare_footprints

MP = "array<array<array<array<double>>>>"
UNIT = 2.0 ** -12


def star(rng, cx, cy, radius, n):
    """Simple, usually concave ring on the lattice around a centre, either way round."""
    pts = []
    for k in range(n):
        angle = 2 * math.pi * (k + rng.random() * 0.7) / n
        reach = radius * (0.35 + 0.65 * rng.random())
        pts.append([round((cx + reach * math.cos(angle)) / UNIT) * UNIT, round((cy + reach * math.sin(angle)) / UNIT) * UNIT])
    pts = [p for i, p in enumerate(pts) if p != pts[i - 1]]
    if rng.random() < 0.5:
        pts.reverse()
    return pts + [pts[0]]


def holed(rng, cx, cy, radius):
    c = round(radius * 0.2 / UNIT) * UNIT
    hole = [[cx - c, cy - c], [cx + c, cy - c], [cx + c, cy + c], [cx - c, cy + c], [cx - c, cy - c]]
    return [star(rng, cx, cy, radius, 4)[:1] and [[cx - radius, cy - radius], [cx + radius, cy - radius],
                                                  [cx + radius, cy + radius], [cx, cy + radius * 1.5],
                                                  [cx - radius, cy + radius], [cx - radius, cy - radius]], hole]


def random_world(seed, n_aois, n_footprints, sizes):
    rng = random.Random(seed)
    aois, footprints = [], []
    for i in range(n_aois):
        cx, cy = -45 + rng.randrange(-80, 80) / 1024, -21 + rng.randrange(-80, 80) / 1024
        r = rng.choice((0.01, 0.04, 0.1))
        r = round(r / UNIT) * UNIT
        mp = [[star(rng, cx, cy, r, rng.randrange(5, 30))]] if i % 3 else [holed(rng, cx, cy, r)]
        if i % 5 == 4:
            mp = mp + [[star(rng, cx + 4 * r, cy, r, 7)]]
        aois.append((f"a{i}", mp))
    for i in range(n_footprints):
        cx, cy = -45 + rng.randrange(-120, 160) / 1024, -21 + rng.randrange(-120, 120) / 1024
        size = rng.choice(sizes)
        size = max(UNIT, round(size / UNIT) * UNIT)
        if i % 3 == 0:
            x, y = round(cx / UNIT) * UNIT, round(cy / UNIT) * UNIT
            mp = [[square(x, y, size)]]
        elif i % 3 == 1:
            mp = [[star(rng, cx, cy, size, rng.randrange(4, 9))]]
        else:
            mp = [[star(rng, cx, cy, size, 5)], [square(round(cx / UNIT) * UNIT + 3 * size, round(cy / UNIT) * UNIT, size)]]
        footprints.append((i, mp))
    return aois, footprints


def frames(spark, aois, footprints):
    a = prepare_footprints(spark.createDataFrame(aois, f"slug string, mp {MP}"), "mp")
    return a, spark.createDataFrame(footprints, f"id int, geometry {MP}")


def expected_pairs(aois, footprints):
    out = {}
    for slug, a in aois:
        for i, f in footprints:
            if intersects(f, a):
                out[(i, slug)] = float(overlap_area(f, a))
    return out


@pytest.mark.parametrize("seed,sizes", [(1, (UNIT * 2, UNIT * 4)), (2, (0.003, 0.02)), (3, (UNIT * 4, 0.05, 0.2))])
def test_general_polygons_against_exact_arithmetic(spark, seed, sizes):
    """Concave shapes, holes, parts; small, large and very large footprints; many exact contacts."""
    aois, footprints = random_world(seed, 8, 150, sizes)
    a, f = frames(spark, aois, footprints)
    tiles = J.tile_aois(a)
    rows = J.clip(f, tiles, ("id",), with_geometry=True).select("id", "aoi", "area_deg2", F.expr(
        G.polygon_area("mp")).alias("shape_area")).collect()
    want = expected_pairs(aois, footprints)
    got = {(r.id, r.aoi): r.area_deg2 for r in rows}
    assert len(rows) == len(got)
    assert set(got) == set(want)
    full = {i: float(overlap_area(m, m)) for i, m in footprints}
    for r in rows:
        tolerance = 1e-8 * full[r.id]
        assert abs(r.area_deg2 - want[(r.id, r.aoi)]) <= tolerance
        assert abs(r.shape_area - want[(r.id, r.aoi)]) <= tolerance


def test_wkb_and_shuffled_join_give_the_same_pairs(spark):
    aois, footprints = random_world(4, 6, 120, (UNIT * 2, 0.01, 0.1))
    a, f = frames(spark, aois, footprints)
    tiles = J.tile_aois(a)
    wkb = f.withColumn("geometry", multipolygon_to_wkb("geometry"))
    want = sorted(map(tuple, J.clip(f, tiles, ("id",)).select("id", "aoi", F.round("area_deg2", 14)).collect()))
    for df, limit in ((wkb, 1 << 30), (f, 0), (wkb, 0)):
        got = sorted(map(tuple, J.clip(df, tiles, ("id",), broadcast_bytes=limit)
                         .select("id", "aoi", F.round("area_deg2", 14)).collect()))
        assert got == want


def test_hot_tile_is_salted_and_complete(spark):
    """A third of all rows on one spot, many of them exact copies: nothing is lost or doubled."""
    spot = spark.range(3000).select(F.col("id").cast("int"), F.lit([[square(-45.3, -21.9, 2 ** -12)]]).cast(MP)
                                    .alias("geometry"))
    rest = spark.range(6000).select((F.col("id") + 3000).cast("int").alias("id"), F.expr(
        "array(array(array(array(-45.4 + id * 1e-5D, -21.9D), array(-45.39995 + id * 1e-5D, -21.9D),"
        " array(-45.39995 + id * 1e-5D, -21.8999D), array(-45.4 + id * 1e-5D, -21.9D))))").cast(MP).alias("geometry"))
    world = spot.unionByName(rest)
    box = [[[[-45.41, -21.95], [-45.2, -21.95], [-45.2, -21.85], [-45.41, -21.85], [-45.41, -21.95]]]]
    a = prepare_footprints(spark.createDataFrame([("all", box)], f"slug string, mp {MP}"), "mp")
    tiles = J.tile_aois(a)
    shuffled = J.clip(world, tiles, ("id",), broadcast_bytes=0)
    r = shuffled.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).first()
    assert (r.n, r.d) == (9000, 9000)


def test_long_rings_are_tiled_in_chunks(spark):
    """A ring of more vertices than one chunk holds: a circle, with footprints in, on and off its boundary."""
    n = 5000
    ring = [[-45 + 0.3 * math.cos(2 * math.pi * k / n), -21 + 0.3 * math.sin(2 * math.pi * k / n)] for k in range(n)]
    a = prepare_footprints(spark.createDataFrame([("circle", [[ring + ring[:1]]])], f"slug string, mp {MP}"), "mp")
    tiles = J.tile_aois(a)
    rng = random.Random(5)
    squares = [(i, [[square(-45 + rng.uniform(-0.35, 0.35), -21 + rng.uniform(-0.35, 0.35), 0.002)]]) for i in range(3000)]
    got = {r.id: r.area_deg2 for r in J.clip(spark.createDataFrame(squares, f"id int, geometry {MP}"), tiles, ("id",))
           .collect()}
    for i, mp in squares:
        far = [math.hypot(x + 45, y + 21) for x, y in mp[0][0][:4]]
        if max(far) < 0.2999:
            assert got[i] == pytest.approx(4e-6, rel=1e-9)
        elif min(far) > 0.3001 and max(far) > 0.31:
            assert i not in got
    inside = sum(got.values())
    assert inside == pytest.approx(math.pi * 0.09 * 3000 * 4e-6 / 0.49, rel=0.05)


def test_full_tiles_need_no_boundary_work(spark):
    """Most of a large area is full tiles, and one area keeps a bounded number of them."""
    box = [[[[-46.0, -22.0], [-45.0, -22.0], [-45.0, -21.0], [-46.0, -21.0], [-46.0, -22.0]]]]
    a = prepare_footprints(spark.createDataFrame([("box", box)], f"slug string, mp {MP}"), "mp")
    tiles = J.tile_aois(a)
    n = {r.full: r.n for r in tiles.tiles.where("level = base").groupBy(F.col("segs").isNull().alias("full"))
         .agg(F.count("*").alias("n")).collect()}
    assert n[True] > 7 * n[False]
    assert sum(n.values()) <= 67 * 67


def test_area_over_part_of_the_lots(spark, lots):
    """A slanted area over the middle of two streets meets the eight lots there and no other."""
    (x0, y0), (x1, y1) = lot_corner(2), lot_corner(13)
    slanted = [[x0 - 0.0005, y0 - 0.001], [x1 + 0.0015, y0 - 0.001], [x1 + 0.0025, y1 + 0.001], [x0 - 0.0005, y1 + 0.001],
               [x0 - 0.0005, y0 - 0.001]]
    tiles = J.tile_aois(read_aois(documents(spark, middle=collection(feature([slanted])))))
    rows = J.clip(lots, tiles, ("id", "bf_source", "confidence")).collect()
    assert sorted(r.id for r in rows) == [2, 3, 4, 5, 10, 11, 12, 13]
    assert {r.id: r.confidence for r in rows}[12] == 0.5 + 12 / 64


def test_one_polygon_for_a_plain_cut(spark):
    """A footprint cut by a straight border comes back as one clean ring."""
    doc = collection(feature([[[-45.0, -21.0], [-44.0, -21.0], [-44.0, -20.0], [-45.0, -20.0], [-45.0, -21.0]]]))
    tiles = J.tile_aois(read_aois(documents(spark, a=doc)))
    f = spark.createDataFrame([(1, [[[[-45.25, -20.5], [-44.75, -20.5], [-44.75, -20.25], [-45.25, -20.25],
                                      [-45.25, -20.5]]]])], f"id int, geometry {MP}")
    row = J.clip(f, tiles, ("id",), with_geometry=True).first()
    assert row.area_deg2 == 0.0625
    assert sorted(map(tuple, row.mp[0][0][:-1])) == [(-45.0, -20.5), (-45.0, -20.25), (-44.75, -20.5), (-44.75, -20.25)]
    assert len(row.mp) == 1 and row.mp[0][0][0] == row.mp[0][0][-1]


def test_null_geometry_falls_out(spark):
    doc = collection(feature([[[-45.0, -21.0], [-44.0, -21.0], [-44.0, -20.0], [-45.0, -20.0], [-45.0, -21.0]]]))
    tiles = J.tile_aois(read_aois(documents(spark, a=doc)))
    f = spark.createDataFrame([(1, None), (2, [[square(-44.5, -20.5)]])], f"id int, geometry {MP}")
    assert [r.id for r in J.clip(f, tiles, ("id",)).collect()] == [2]
    wkb = f.withColumn("geometry", multipolygon_to_wkb("geometry"))
    assert [r.id for r in J.clip(wkb, tiles, ("id",)).collect()] == [2]


def test_no_area_is_an_error(spark, lots):
    empty = read_aois(documents(spark, bad="no json here"))
    with pytest.raises(ValueError):
        J.clip(lots, J.tile_aois(empty))


def test_crs_labels(lots):
    J.check_crs("EPSG:4326", "OGC:CRS84")
    with pytest.raises(ValueError, match="31983"):
        J.clip(lots, None, crs=("EPSG:4326", "EPSG:31983"))


@pytest.mark.parametrize("width", [1e-3, 1e-5, 1e-7])
def test_a_tiny_area_inside_a_footprint_is_a_match(spark, width):
    tiny = collection(feature([[[-44.5, -20.5], [-44.5 + width, -20.5], [-44.5, -20.5 + width], [-44.5, -20.5]]]))
    tiles = J.tile_aois(read_aois(documents(spark, tiny=tiny)))
    f = spark.createDataFrame([(1, [[square(-45.0, -21.0, 1.0)]]), (2, [[square(-44.4, -20.4, 1.0)]])], f"id int, geometry {MP}")
    assert [(r.id, r.area_deg2 < 1e-6) for r in J.clip(f, tiles, ("id",)).collect()] == [(1, True)]


@pytest.mark.parametrize("n", [5, 40])
def test_box_prefilter_means_the_same_for_any_number_of_areas(spark, n):
    """Areas along a diagonal: their common hull is nearly empty of them."""
    corners = [(-50 + 0.5 * k, -20 + 0.5 * k) for k in range(n)]
    areas = {f"a{k}": collection(feature([square(x, y, 0.1)])) for k, (x, y) in enumerate(corners)}
    tiles = J.tile_aois(read_aois(documents(spark, **areas)))
    spots = [(-50 + 0.25 * i, -20 + 0.25 * j) for i in range(2 * n) for j in range(2 * n)]
    f = prepare_footprints(spark.createDataFrame([(k, [[square(x, y, 0.01)]]) for k, (x, y) in enumerate(spots)], f"id int, geometry {MP}"))
    assert J.bbox_prefilter(f, tiles).count() == n


def test_detailed_rings_make_few_rows(spark):
    n = 4000
    ring = [[-50 + 0.2 * math.cos(2 * math.pi * (k % n) / n), -20 + 0.2 * math.sin(2 * math.pi * (k % n) / n)] for k in range(n + 1)]
    aois = read_aois(documents(spark, disc=collection(feature([ring]))))
    assert J._tile_rows(J._aoi_edges(aois.withColumnRenamed("slug", "aoi"))).count() < 10 * n
    f = spark.createDataFrame([(1, [[square(-50.01, -20.01, 0.02)]]), (2, [[square(-49.81, -20.0, 0.02)]]), (3, [[square(-49.7, -20.0, 0.02)]])],
                              f"id int, geometry {MP}")
    got = {r.id: r.area_deg2 for r in J.clip(f, J.tile_aois(aois), ("id",)).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(4e-4) and 0 < got[2] < 4e-4


def test_box_filter_reaches_the_scan(spark, lots, tmp_path):
    doc = collection(feature([[[-45.0, -21.0], [-44.0, -21.0], [-44.0, -20.0], [-45.0, -20.0], [-45.0, -21.0]]]))
    tiles = J.tile_aois(read_aois(documents(spark, a=doc)))
    prepare_footprints(lots).write.parquet(str(tmp_path / "f"))
    plan = J.clip(spark.read.parquet(str(tmp_path / "f")), tiles)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(maxx,-45.0)" in plan and "LessThanOrEqual(minx,-44.0)" in plan
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "confidence" not in plan.split("ReadSchema")[1].split("\n")[0]
