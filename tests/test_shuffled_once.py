"""The shuffled way sends each footprint once, and those far from all areas not at all."""

import re

from helpers import rectangle
from rooftally.operators import spatial_join as J


def areas(spark):
    boxes = [(x, -21.0, x + 0.05, -20.95) for x in (-45.0, -44.9, 3.0)]
    rows = [(f"a{k}", [[rectangle(b[0], b[1], b[2] - b[0], b[3] - b[1])]], *b) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "slug string, mp array<array<array<array<double>>>>, minx double, miny double, maxx double, maxy double")


def footprints(spark):
    rows = [(k, [[rectangle(-45.01 + 0.002 * (k % 60) + (20.0 if k % 3 == 0 else 0.0), -21.01 + 0.002 * (k // 60), 0.0005, 0.0005)]]) for k in range(1500)]
    return spark.createDataFrame(rows, "id int, geometry array<array<array<array<double>>>>")


def test_far_footprints_are_left_out_before_the_shuffle(spark):
    tiles, rows = J.tile_aois(areas(spark)), J.prepare_footprints(footprints(spark))
    placed = J._with_tile(J.near_ranges(rows, J.AoiTiles(**{**tiles.__dict__, "boxes": ((-180.0, -90.0, 180.0, 90.0),)})), tiles.kinds)
    kept = {r.id for r in J._near_cells(placed, tiles).select("id").collect()}
    assert {k for k in range(1500) if k % 3} <= kept and not kept & {k for k in range(1500) if k % 3 == 0}


def test_footprints_are_shuffled_once_and_pairs_are_the_same(spark):
    tiles, rows = J.tile_aois(areas(spark)), footprints(spark)
    one = sorted(map(tuple, J.clip(rows, tiles, ("id",)).select("id", "aoi", "area_deg2").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = J.clip(rows, tiles, ("id",), broadcast_bytes=0)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, shuffled.select("id", "aoi", "area_deg2").collect())) == one and len(one) > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(_tile", plan)) == 2  # footprints and areas


def test_edges_are_shuffled_once(spark):
    plan = J._tile_rows(J._aoi_edges(areas(spark).withColumnRenamed("slug", "aoi")))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(aoi[^,]*, level[^,]*, ix", plan)) == 1 and plan.count("Exchange hashpartitioning") == 2


def test_tiles_are_not_read_to_count_the_footprints_in_them(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write_and_read(df, name)

    write_and_read = J.write_and_read
    monkeypatch.setattr(J, "write_and_read", noted)
    tiles = J.tile_aois(areas(spark))
    rows = J.clip(footprints(spark), tiles, ("id",), broadcast_bytes=0).count()
    (name, plan), = plans
    assert name == "tile-counts" and "LeftSemi" not in plan and rows > 100
