import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import LOT_DEPTH, LOT_WIDTH, collection, documents, feature, lot_corner, rectangle, square
from rooftally.functions import geometry as G
from rooftally.functions import measures as M
from rooftally.functions.simplify import _crosses, _crossing_polygons
from rooftally.operators import layers as L
from rooftally.operators import lifecycle as T
from rooftally.operators import summary as S
from rooftally.operators.spatial_join import clip, tile_aois
from rooftally.plans.analyze import analyze
from rooftally.plans.dashboard import dashboard_payload
from rooftally.sources.aois import read_aois
from rooftally.sources.footprints import prepare_footprints
from rooftally.workspace import fresh_path

VALLEY = collection(feature([rectangle(-50.625, -15.375, 0.375, 0.25)], nome="Vale", uf="GO", area_km2_oficial=8.0))
SEA = collection(feature([[[-20.0, -15.0], [-19.75, -15.0], [-20.0, -14.5], [-20.0, -15.0]]], nome="Mar"))
LOT = LOT_WIDTH * LOT_DEPTH * M.M2_PER_DEG2  # at the equator


@pytest.fixture(scope="module")
def world(spark, lots):
    aois = read_aois(documents(spark, valley=VALLEY, sea=SEA)).cache()
    c = clip(lots, tile_aois(aois), ("id", "bf_source"), with_geometry=True).cache()
    return aois, c


def test_one_table_figures(spark, lots):
    df = prepare_footprints(lots)
    assert S.count_total(df).first().n == 24
    assert [tuple(r) for r in S.count_by_source(df).collect()] == [("google", 16), ("microsoft", 8)]
    assert [r.bf_source for r in S.distinct_sources(df).collect()] == ["google", "microsoft"]
    assert {r.bf_source: r.area_m2 for r in S.area_by_source(df).collect()} == pytest.approx(
        {"google": 16 * LOT, "microsoft": 8 * LOT})
    for r in S.mean_area_by_source(df, 60.0).collect():
        assert r.mean_m2 == pytest.approx(LOT / 2)


def test_null_areas_and_sources(spark):
    df = spark.createDataFrame([("a", "google", None, 1.0), ("a", None, 2.0, 1.0)],
                               "aoi string, bf_source string, area_deg2 double, m2_factor double")
    assert {r.bf_source: r.area_m2 for r in S.area_by_source(df).collect()}["google"] == 0.0
    r = S.summary_maps(S.aoi_summary(df)).first()
    assert r.n_by_source == {"google": 1, "None": 1} and r.area_m2_by_source == {"google": 0.0, "None": 2.0}
    h = {(x.bf_source, x.bucket): x.n for x in S.area_histogram(df).collect()}
    assert h[("google", ">=500")] == 1 and sum(h.values()) == 1


def test_summary_and_maps(world):
    aois, c = world
    rows = {r.aoi: r for r in S.summary_maps(S.aoi_summary(c), aois).collect()}
    assert rows["valley"].total == 24 and rows["valley"].n_by_source == {"google": 16, "microsoft": 8}
    assert rows["valley"].display_name == "Vale/GO"
    assert rows["sea"].total == 0 and rows["sea"].n_by_source == {}


def test_comparison(world):
    aois, c = world
    rows = {r.aoi: r for r in S.compare_aois(c, aois).collect()}
    r = rows["valley"]
    assert r.bbox_km2 == pytest.approx(0.25 * 111 * 0.375 * 111 * math.cos(math.radians(-15.25)))
    assert r.density_bbox == pytest.approx(24 / r.bbox_km2) and r.density_official == 3.0
    assert (r.total, r.n_google, r.n_microsoft) == (24, 16, 8)
    lot = LOT * math.cos(math.radians(-15.25))
    assert r.area_m2_google == pytest.approx(16 * lot) and r.mean_m2_microsoft == pytest.approx(lot)
    shares = {x.bf_source: x.pct for x in S.share_by_source(S.aoi_summary(c)).collect()}
    assert shares == pytest.approx({"google": 200 / 3, "microsoft": 100 / 3})
    labels = {x.aoi: x for x in S.source_comparison(S.compare_aois(c, aois)).collect()}
    assert labels["valley"].coverage == "prominent microsoft" and labels["valley"].gap_m2 == pytest.approx(0, abs=1e-3)


def test_areas_without_footprints_are_compared_with_zeros(world):
    aois, c = world
    r = {r.aoi: r for r in S.compare_aois(c, aois).collect()}["sea"]
    assert (r.total, r.n_google, r.n_microsoft, r.area_m2_google, r.mean_m2_microsoft) == (0, 0, 0, 0.0, 0.0)
    assert r.density_bbox == 0.0 and r.density_official == 0.0 and r.bbox_km2 > 0
    label = {x.aoi: x for x in S.source_comparison(S.compare_aois(c, aois)).collect()}["sea"]
    assert label.built_m2 == 0.0
    assert [t.aoi for t in S.comparison_table(S.compare_aois(c, aois)).collect()] == ["sea", "valley"]


@pytest.mark.parametrize("pct,label", [(100.0, "google dominates"), (90.0, "google dominates"),
                                       (89.9, "significant microsoft"), (70.0, "significant microsoft"),
                                       (69.9, "prominent microsoft"), (0.0, "prominent microsoft")])
def test_coverage_labels(spark, pct, label):
    assert spark.range(1).select(M.coverage_class(F.lit(pct))).first()[0] == label


def test_bucket_edges_are_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 49.99, 50.0, 100.0, 199.9, 200.0, 500.0)], "m double")
    assert [r[0] for r in df.select(M.area_bucket(F.col("m"))).collect()] == [
        "<50", "<50", "50-100", "100-200", "100-200", "200-500", ">=500"]


def test_histogram_is_dense(world):
    aois, c = world
    rows = {(r.aoi, r.bf_source, r.bucket): r.n for r in S.area_histogram(c, aois).collect()}
    assert len(rows) == 2 * 2 * 5
    assert rows[("valley", "google", ">=500")] == 16 and sum(rows.values()) == 24


def test_ratio(spark, world):
    aois, c = world
    wide = S.compare_aois(c, aois).where("aoi = 'valley'")
    both = wide.unionByName(wide.withColumn("aoi", F.lit("third")).withColumn("total", F.lit(8).cast("bigint"))
                            .withColumn("official_km2", F.lit(16.0)))
    r = S.aoi_ratio(both, spark.createDataFrame([("valley", "third")], "aoi_a string, aoi_b string")).first()
    assert r.n_ratio == 3.0 and r.km2_ratio == 0.5 and r.built_ratio == 1.0


def test_analyze(spark, lots):
    rows = analyze(lots, documents(spark, valley=VALLEY)).collect()
    assert {(r.bf_source, r.n) for r in rows} == {("google", 16), ("microsoft", 8)}
    for r in rows:
        assert r.area_m2 == pytest.approx(r.n * LOT * math.cos(math.radians(-15.25)), rel=1e-6)


def test_layers(world):
    _, c = world
    rows = L.layers(c, min_area_m2=1000.0, tolerance=1e-5).collect()
    assert len(rows) == 24 and all(r.area_m2 > 0 and len(r.mp[0][0]) == 5 for r in rows)
    assert L.layers(c, min_area_m2=LOT).count() == 0  # a lot is smaller away from the equator


@pytest.mark.parametrize("call", [lambda d: L.filter_source(d, "osm"), lambda d: L.filter_min_area(d, 0),
                                  lambda d: L.filter_min_area(d, -1.0), lambda d: L.layers(d, tolerance=0)])
def test_layer_arguments(world, call):
    with pytest.raises(ValueError):
        call(world[1])


def test_minimum_area_with_and_without_latitude(spark):
    df = spark.createDataFrame([(1, 95.0 / M.M2_PER_DEG2), (2, 105.0 / M.M2_PER_DEG2)], "id int, area_deg2 double")
    assert [r.id for r in L.filter_min_area(df, 100.0).collect()] == [2]
    assert L.filter_min_area(df, 100.0, M.m2_factor(-21.88)).count() == 0  # 105 m2 at the equator are 97 there
    assert L.filter_min_area(df, 100.0, M.m2_factor(-10.0)).count() == 1


def test_simplify(spark):
    def dense(ring):
        out = []
        for a, b in zip(ring, ring[1:]):
            out += [a, [(a[0] + b[0]) / 2, (a[1] + b[1]) / 2 + 1e-9]]
        return out + [ring[-1]]

    ring = square(0.0, 0.0, 1.0)
    triangle = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    wiggly = [[x / 100, 0.004 * (x % 2)] for x in range(101)] + [[1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, [[dense(ring)]]), (2, [[triangle]]), (3, [[wiggly]]), (4, None),
                                (5, [[dense(square(0.0, 0.0, 4.0)), dense(square(1.0, 1.0, 1.0))], [ring]])],
                               "id int, mp array<array<array<array<double>>>>")
    got = {r.id: r.mp for r in L.simplify(df, 0.01).collect()}
    assert got[1] == [[ring]] and got[2] == [[triangle]] and got[4] is None
    assert len(got[3][0][0]) == 5
    assert got[5] == [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)], [ring]]
    huge = L.simplify(df.where("id = 1"), 100.0).first().mp
    assert len(huge[0][0]) >= 4


def test_simplified_rings_do_not_cross_each_other(spark):
    """The shell's bulge around a hole goes with the tolerance, so the polygon stays as it was; alone, the shell is thinned."""
    shell = [[0.0, 0.0], [2.0, -0.9], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.9, -0.6], [2.1, -0.6], [2.1, 3.0], [1.9, 3.0], [1.9, -0.6]]
    df = spark.createDataFrame([(1, [[shell, hole]]), (2, [[shell]]), (3, [[[p + [5.0] for p in shell]]])],
                               "id int, mp array<array<array<array<double>>>>").repartition(1)
    got = {r.id: r.mp for r in L.simplify(df, 1.0).collect()}
    assert got[1] == [[shell, hole]] and got[2] == got[3] == [[[p for p in shell if p != [2.0, -0.9]]]]


def test_crossings_of_long_rings_in_blocks():
    n = 6000
    angle = 2 * np.pi * np.arange(n + 1) / n
    x, y = np.cos(angle), np.sin(angle)
    x[-1], y[-1] = x[0], y[0]
    ring = np.zeros(n + 1, int)
    assert not _crosses(x, y, ring)
    assert not _crosses(np.append(x, x / 2), np.append(y, y / 2), np.append(ring, ring + 1))
    assert _crosses(np.append(x, x / 2 + 0.7), np.append(y, y / 2), np.append(ring, ring + 1))
    x[n // 2] = 2.0
    assert _crosses(x, y, ring)


def test_small_polygons_are_judged_together_as_one_by_one():
    rng = np.random.default_rng(5)
    xs, ys, rings, polygons, want = [], [], [], [], []
    for p in range(300):
        parts = []
        for _ in range(rng.integers(1, 3)):
            n = int(rng.integers(3, 8))
            x, y = rng.integers(0, 30, n).astype(float), rng.integers(0, 30, n).astype(float)
            parts.append((np.append(x, x[0]), np.append(y, y[0])))
        ring = np.concatenate([np.full(len(x), k) for k, (x, _) in enumerate(parts)])
        x, y = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
        want.append(_crosses(x, y, ring))
        xs.append(x), ys.append(y), rings.append(ring + 10 * p), polygons.append(np.full(len(x), p))
    found = _crossing_polygons(*[np.concatenate(v) for v in (xs, ys, rings, polygons)])
    assert 0 < len(found) < 300 and sorted(found) == [p for p in range(300) if want[p]]


def test_centre_and_hectares(spark, lots):
    r = L.with_centre(L.with_area(prepare_footprints(lots), M.m2_factor())).where("id = 9").first()
    x, y = lot_corner(9)
    assert (r.centre_lon, r.centre_lat) == (x + LOT_WIDTH / 2, y + LOT_DEPTH / 2)
    assert r.area_m2 == round(LOT, 2) and r.area_ha == pytest.approx(r.area_m2 / 1e4)


def test_dashboard(world):
    aois, c = world
    rows = {r.aoi: r for r in dashboard_payload(c, aois).collect()}
    r = rows["valley"]
    assert r.bounds_sw == [-15.375, -50.625] and r.bounds_ne == [-15.125, -50.25] and r.official_km2 == 8.0
    assert r.histogram["google"] == {"<50": 0, "50-100": 0, "100-200": 0, "200-500": 0, ">=500": 16}
    assert r.files == {s: [f"data/aoi=valley/bf_source={s}/part=0"] for s in M.SOURCES}
    assert rows["sea"].total == 0 and sum(rows["sea"].histogram["google"].values()) == 0
    with pytest.raises(ValueError):
        dashboard_payload(c, aois.where("false"))


def test_table_lifecycle(spark, lots):
    path = fresh_path(spark, "db")
    db = "db_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}'")
    for name in ("footprints_bra", "footprints_xyz9", "aoi_x", "recorte_x", "footprints_downtown"):
        lots.repartition(8).write.saveAsTable(f"{db}.{name}")
    stats = {r.table_name: r for r in T.table_stats(spark, db).collect()}
    assert list(stats) == sorted(stats) and stats["aoi_x"].n_rows == 24 and stats["aoi_x"].n_bytes > 0
    assert [n for n, r in stats.items() if r.prunable] == ["footprints_bra"]
    assert T.prune_tables(spark, db) == ["footprints_bra"] and "footprints_bra" in T.list_tables(spark, db)
    T.prune_tables(spark, db, confirm=True)
    assert T.list_tables(spark, db) == ["aoi_x", "footprints_downtown", "footprints_xyz9", "recorte_x"]
    assert T.compact_table(spark, db, "recorte_x", fresh_path(spark, "c")) == {"rows": 24, "files": 8}
    assert "recorte_x_bak" not in T.list_tables(spark, db)
    for _ in range(2):  # an older backup is replaced
        T.compact_table(spark, db, "recorte_x", fresh_path(spark, "c"), confirm=True)
    after = {r.table_name: r for r in T.table_stats(spark, db).collect()}
    assert after["recorte_x"].n_rows == after["recorte_x_bak"].n_rows == 24
    assert after["recorte_x"].n_files == 1
    lots.repartition(4).write.partitionBy("bf_source").saveAsTable(f"{db}.recorte_p")
    assert T.compact_table(spark, db, "recorte_p", fresh_path(spark, "c"), rows_per_file=8, confirm=True) == {"rows": 24, "files": 3}
    assert spark.table(f"{db}.recorte_p").where("bf_source = 'google'").count() == 16
    names = {r.column_name: r.column_type for r in T.describe_table(spark, db, "recorte_p").collect()}
    assert names["id"] == "int" and names["bf_source"] == "string"


def test_stats_go_on_after_an_unreadable_table(spark, lots):
    path = fresh_path(spark, "db")
    db = "db_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}'")
    for name in ("a_good", "b_bad", "c_good"):
        lots.coalesce(1).write.saveAsTable(f"{db}.{name}")
    for f in spark.table(f"{db}.b_bad").inputFiles():
        with open(f.removeprefix("file://"), "wb") as out:
            out.write(b"no parquet")
    rows = {r.table_name: r for r in T.table_stats(spark, db).collect()}
    assert rows["a_good"].n_rows == rows["c_good"].n_rows == 24 and rows["b_bad"].error and rows["b_bad"].n_rows is None


def test_polygon_area_ignores_ring_direction(spark):
    ring = square(0.0, 0.0, 2.0)
    df = spark.createDataFrame([([[ring, square(0.5, 0.5, 1.0)]],), ([[ring[::-1], square(0.5, 0.5, 1.0)]],)],
                               "mp array<array<array<array<double>>>>")
    assert [r[0] for r in df.select(F.expr(G.polygon_area("mp"))).collect()] == [3.0, 3.0]
