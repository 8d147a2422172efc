import json
import struct

import pytest
from pyspark.sql import functions as F

from helpers import LOT_DEPTH, LOT_WIDTH, WEST, collection, documents, feature, lot_corner, rectangle, square
from rooftally.functions import geometry as G
from rooftally.functions.wkb import multipolygon_to_wkb, wkb_problem, wkb_stats, wkb_to_multipolygon
from rooftally.sources import aois as A
from rooftally.sources import footprints as P
from rooftally.sources import writers as K

MP = "array<array<array<array<double>>>>"
FIELD = [[[-51.5, -12.25], [-51.0, -12.5], [-50.75, -12.0], [-51.25, -11.75], [-51.5, -12.25]]]
ISLES = [[rectangle(-40.5, -3.0, 0.25, 0.5)], [[[-32.5, -3.75], [-32.25, -3.75], [-32.375, -3.5], [-32.5, -3.75]]]]


# --- areas of interest -------------------------------------------------------------------------------------------
def test_list_skips_what_is_not_an_area(spark, tmp_path):
    files = {"z_field.geojson": collection(feature(FIELD, nome="Várzea", lots=24)), "m_bare.geojson": json.dumps({"type": "FeatureCollection"}),
             "a_text.geojson": "<html>moved</html>", "b_none.geojson": collection(), "c_field.json": collection(feature(FIELD))}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    listed = {r.slug: r.properties for r in A.list_aois(A.read_documents(spark, str(tmp_path))).collect()}
    assert listed == {"m_bare": {}, "z_field": {"nome": "Várzea", "lots": "24"}}


def test_missing_folder_is_an_empty_listing(spark, tmp_path):
    assert A.list_aois(A.read_documents(spark, str(tmp_path / "nowhere"))).count() == 0


def shifted(ring, dx=0.0, dy=0.0):
    return [[x + dx, y + dy] for x, y in ring]


def test_rules(spark):
    """Each way of breaking a good document names its own rule."""
    good = feature(FIELD)
    broken = {
        "plain": (collection(good), []),
        "parts": (collection(feature(ISLES, "MultiPolygon")), []),
        "renamed": (collection(good, kind="Topology"), ["not a FeatureCollection"]),
        "doubled": (collection(good, feature(ISLES, "MultiPolygon")), ["not exactly one feature"]),
        "emptied": (collection(), ["not exactly one feature", "not Polygon or MultiPolygon"]),
        "line": (collection(feature(FIELD[0], "LineString")), ["not Polygon or MultiPolygon"]),
        "east": (collection(feature([shifted(FIELD[0], dx=240.0)])), ["longitude outside [-180, 180]"]),
        "north": (collection(feature([shifted(FIELD[0], dy=110.0)])), ["latitude outside [-90, 90]"]),
        "bare": (collection(feature([])), ["no coordinates"])}
    found = {r.slug: r.violations for r in A.check_aois(documents(spark, **{k: d for k, (d, _) in broken.items()})).collect()}
    assert found == {k: v for k, (_, v) in broken.items()}


def test_bounds_of_parts(spark):
    r = A.read_aois(documents(spark, isles=collection(feature(ISLES, "MultiPolygon")))).first()
    assert (r.minx, r.miny, r.maxx, r.maxy) == (-40.5, -3.75, -32.25, -2.5)


@pytest.mark.parametrize("properties,name", [({"nome": "Várzea", "uf": "MT"}, "Várzea/MT"), ({"nome": "Várzea"}, "Várzea"),
                                             ({"uf": "MT"}, "slug/MT"), ({"nome": "V", "uf": ""}, "V"), ({}, "slug")])
def test_display_name(spark, properties, name):
    assert A.read_aois(documents(spark, slug=collection(feature(FIELD, **properties)))).first().display_name == name


def test_get_aoi(spark):
    docs = documents(spark, good=collection(feature(FIELD)), bad=collection(feature(FIELD), kind="Feature"))
    assert A.get_aoi(docs, "good").first().slug == "good"
    with pytest.raises(LookupError):
        A.get_aoi(docs, "other")
    with pytest.raises(ValueError, match="FeatureCollection"):
        A.get_aoi(docs, "bad")


def test_features_without_the_one_feature_rule(spark):
    rows = A.read_features(documents(spark, a=collection(feature(FIELD, k=1), feature(ISLES, "MultiPolygon", k=2)))).collect()
    assert [(r.feature_no, len(r.mp), r.properties["k"]) for r in rows] == [(0, 1, "1"), (1, 2, "2")]


def test_ring_checks(spark):
    docs = documents(spark, ok=collection(feature(FIELD)), open=collection(feature([FIELD[0][:-1]])),
                     far=collection(feature([square(10.0, 10.0, 1.0)])))
    rows = {r.slug: r for r in A.ring_checks(A.read_aois(docs), (-74, -34, -34, 5)).collect()}
    assert rows["ok"].closed and rows["ok"].four_points and rows["ok"].in_country
    assert not rows["open"].closed and not rows["far"].in_country


def test_enrich_fills_only_what_is_absent(spark):
    b = A.read_aois(documents(spark, cambuquira_mg=collection(feature(FIELD)), other_1=collection(feature(FIELD))))
    b = b.drop("properties").withColumn("code", F.when(F.col("slug") == "other_1", 3100000).otherwise(3110707))
    rows = {r.slug: r.properties for r in A.enrich_aois(b, A.default_metadata(spark), "code", "official").collect()}
    assert rows["cambuquira_mg"]["ibge_code"] == "3110707" and rows["cambuquira_mg"]["area_km2_oficial"] == "246.38"
    assert rows["other_1"] == {"nome": "other_1", "ibge_code": "3100000", "fonte_poligono": "official"}
    with pytest.raises(Exception, match="bad municipal code"):
        A.enrich_aois(b.withColumn("code", F.lit(311)), A.default_metadata(spark), "code", "x").collect()
    with pytest.raises(Exception, match="bad slug"):
        A.enrich_aois(b.withColumn("slug", F.lit("a-b")), A.default_metadata(spark), "code", "x").collect()


def test_written_areas_are_not_replaced_unasked(spark, tmp_path):
    path = str(tmp_path / "aois")
    aois = A.read_aois(documents(spark, one=collection(feature(FIELD, nome='with "quotes" and ção')),
                                 two=collection(feature(ISLES, "MultiPolygon"))))
    K.write_aois(aois, path)
    with pytest.raises(Exception, match="exist"):
        K.write_aois(aois, path)
    K.write_aois(aois, path, overwrite=True)
    back = A.read_aois(A.read_documents(spark, path, one_per_line=True)).orderBy("slug").collect()
    assert [r.slug for r in back] == ["one", "two"]
    assert back[0].properties["nome"] == 'with "quotes" and ção' and back[1].minx == -40.5


# --- footprints ---------------------------------------------------------------------------------------------------
def test_country_partition(spark, lots, tmp_path):
    base = str(tmp_path / "bucket")
    two = lots.withColumn("country_iso", F.lit("BRA")).unionByName(
        lots.withColumn("country_iso", F.lit("LSO")).where("id < 5"))
    K.write_geoparquet(two, f"{base}/by_country_s2", "geometry", ("country_iso",))
    df = P.read_country(spark, base, "BRA")
    assert df.count() == 24 and {"geometry", "bf_source"} <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country_iso" in plan
    single = f"{base}/single"
    (lots.where("bf_source = 'google'").drop("bf_source").withColumn("country_iso", F.lit("BR"))
     .write.partitionBy("country_iso").parquet(single))
    assert P.read_country_single_source(spark, single, "BR").select("bf_source").distinct().first()[0] == "google"


@pytest.mark.parametrize("call", [
    lambda s: P.read_country(s, "/x", "br"), lambda s: P.read_country(s, "/x", "BR"),
    lambda s: P.read_country(s, "/x", "BRA", "by_s2"), lambda s: P.read_country_single_source(s, "/x", "BRA"),
    lambda s: P.read_materialised(s, "no_such_table")])
def test_bad_arguments(spark, call):
    with pytest.raises(ValueError):
        call(spark)


def test_measures_of_the_lots(spark, lots):
    r = P.prepare_footprints(lots).agg(F.sum("area_deg2"), F.min("minx"), F.max("maxy")).first()
    assert tuple(r) == (24 * LOT_WIDTH * LOT_DEPTH, WEST, lot_corner(23)[1] + LOT_DEPTH)


# --- WKB -------------------------------------------------------------------------------------------------------------
def wkb(mp, big=False, srid=None):
    o = ">" if big else "<"

    def polygon(rings):
        body = b"".join(struct.pack(o + "I", len(r)) + b"".join(struct.pack(o + "dd", *p) for p in r) for r in rings)
        return struct.pack(o + "BII", not big, 3, len(rings)) + body

    head = struct.pack(o + "BI", not big, 6 | (0x20000000 if srid else 0))
    return head + (struct.pack(o + "I", srid) if srid else b"") + struct.pack(o + "I", len(mp)) + b"".join(map(polygon, mp))


SHAPES = [[[square(0.0, 0.0, 1.0)]], [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)], [square(10.0, 0.0, 2.0)]],
          [[square(-3.0, -3.0, 1.0)[:3] + [[-3.0, -3.0]]]]]


def test_wkb_both_byte_orders_and_srid(spark):
    rows = [(i, bytearray(w)) for i, w in enumerate(
        [wkb(SHAPES[0]), wkb(SHAPES[1], big=True), wkb(SHAPES[2], srid=4326), wkb(SHAPES[1])])] + [(4, None)]
    df = spark.createDataFrame(rows, "id int, w binary").repartition(1)
    got = {r.id: (r.mp, r.s) for r in df.select("id", wkb_to_multipolygon("w").alias("mp"), wkb_stats("w").alias("s"))
           .collect()}
    assert [got[i][0] for i in range(5)] == [SHAPES[0], SHAPES[1], SHAPES[2], SHAPES[1], None]
    assert tuple(got[1][1]) == (0.0, 0.0, 12.0, 4.0, 19.0)
    assert got[2][1].area_deg2 == 0.5 and got[4][1].area_deg2 is None


def test_wkb_round_trip(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)] + [(9, None)], f"id int, mp {MP}")
    back = df.select("id", "mp", wkb_to_multipolygon(multipolygon_to_wkb("mp")).alias("again"),
                     F.expr(G.polygon_area("mp")).alias("a")).collect()
    assert all(r.mp == r.again for r in back)
    assert [r.a for r in sorted(back, key=lambda r: r.id)] == [1.0, 19.0, 0.5, None]


def packed(kind, body, order="<", z=False, m=False, iso=False, srid=None):
    """WKB of ``kind`` in either way of marking more numbers; ``body`` is packed behind the header."""
    code = kind + (1000 * (z + 2 * m) if iso else (0x80000000 * z) | (0x40000000 * m) | (0x20000000 if srid else 0))
    head = struct.pack(order + "BI", order == "<", code) + (struct.pack(order + "I", srid) if srid else b"")
    return head + body


def numbered(points, order, more):
    return b"".join(struct.pack(order + "d" * (2 + more), *p, *[7.5] * more) for p in points)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("z,m,iso", [(False, False, False), (True, False, False), (True, False, True), (False, True, True),
                                     (False, True, False), (True, True, False), (True, True, True)])
def test_more_numbers_per_point_in_both_forms(spark, order, z, m, iso):
    ring, line = square(1.0, 2.0, 4.0), [[0.0, 0.0], [3.0, 1.0], [5.0, -2.0]]
    how = {"order": order, "z": z, "m": m, "iso": iso}
    srid = {} if iso else {"srid": 4326}
    body = struct.pack(order + "I", len(ring)) + numbered(ring, order, z + m)
    polygon = packed(3, struct.pack(order + "I", 1) + body, **how)
    shapes = [packed(3, struct.pack(order + "I", 1) + body, **how, **srid),
              packed(6, struct.pack(order + "I", 2) + polygon * 2, **how, **srid),
              packed(1, numbered([[9.0, -9.0]], order, z + m), **how, **srid),
              packed(2, struct.pack(order + "I", 3) + numbered(line, order, z + m), **how),
              packed(4, struct.pack(order + "I", 2) + packed(1, numbered([[1.0, 1.0]], order, z + m), **how)
                     + packed(1, numbered([[2.0, 5.0]], order, z + m), **how), **how)]
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(shapes)], "id int, w binary").repartition(1)
    got = {r.id: r for r in df.select("id", wkb_to_multipolygon("w").alias("mp"), wkb_stats("w").alias("s"),
                                      wkb_problem("w").alias("problem")).collect()}
    assert [tuple(got[k].s) for k in range(5)] == [(1.0, 2.0, 5.0, 6.0, 16.0), (1.0, 2.0, 5.0, 6.0, 32.0), (9.0, -9.0, 9.0, -9.0, 0.0),
                                                   (0.0, -2.0, 5.0, 1.0, 0.0), (1.0, 1.0, 2.0, 5.0, 0.0)]
    assert got[0].mp == [[ring]] and got[1].mp == [[ring], [ring]] and got[2].mp == [[[[9.0, -9.0]] * 4]]
    assert got[3].mp == [[line + line[-2::-1]]] and all(r.problem is None for r in got.values())


def test_third_numbers_are_left_out_of_written_bytes(spark):
    ring = [[x, y, 9.0] for x, y in square(0.0, 0.0, 2.0)]
    df = spark.createDataFrame([(1, [[ring]]), (2, []), (3, None), (4, [[ring], [ring, ring]])], f"id int, mp {MP}").repartition(1)
    back = {r.id: r.again for r in df.select("id", wkb_to_multipolygon(multipolygon_to_wkb("mp")).alias("again")).collect()}
    flat = square(0.0, 0.0, 2.0)
    assert back == {1: [[flat]], 2: [], 3: None, 4: [[flat], [flat, flat]]}


def test_bad_rows_are_told_apart(spark):
    bad = [wkb(SHAPES[0])[:-5], b"\x01\x07\x00\x00\x00" + b"\x00" * 4, b"\x01", wkb(SHAPES[1])]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)] + [(9, None)], "id int, w binary").repartition(1)
    problems = {r.id: r.p for r in df.select("id", wkb_problem("w").alias("p")).collect()}
    assert problems[3] is None and problems[9] is None and all(problems[k] for k in (0, 1, 2))
    with pytest.raises(Exception, match="WKB|supported"):
        df.select(wkb_to_multipolygon("w")).collect()


def test_boxes_of_a_covering_reach_the_scan(spark, lots, tmp_path):
    path = str(tmp_path / "covered")
    box = F.struct(*[F.col(c).alias(n) for c, n in zip(P.PREPARED, P.COVERING)])
    (P.prepare_footprints(lots).select("id", "bf_source", multipolygon_to_wkb("geometry").alias("geometry"), box.alias("bbox"))
     .write.parquet(path))
    df = P.prepare_footprints(spark.read.parquet(path)).where(F.col("minx") > WEST + 2.0 ** -7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bbox.xmin" in plan and plan.count("ArrowEvalPython") == 1
    assert df.count() == 15 and df.agg(F.sum("area_deg2")).first()[0] == 15 * LOT_WIDTH * LOT_DEPTH


def test_footprints_are_measured_once(spark, lots):
    wkb_lots = lots.withColumn("geometry", multipolygon_to_wkb("geometry"))
    kept = P.prepare_footprints(wkb_lots).where("minx > -50.5 AND maxy < 0 AND area_deg2 > 0").select("id", "area_deg2")
    assert kept._jdf.queryExecution().executedPlan().toString().count("wkb_stats") == 1


# --- sinks -----------------------------------------------------------------------------------------------------------
def test_geojson(spark, lots, tmp_path):
    path = str(tmp_path / "out")
    K.write_geojson(lots, path, "geometry", ["bf_source"])
    features = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(features) == 24 and all(f["geometry"]["type"] == "Polygon" for f in features)
    assert all(set(f["properties"]) == {"bf_source"} for f in features)
    assert K.read_geojson(spark, path).where(F.size("mp") == 1).count() == 24


@pytest.mark.parametrize("batch", [2, 10_000])
def test_every_layer_file_is_one_document(spark, lots, tmp_path, batch):
    path = tmp_path / "layers"
    layers = lots.withColumn("aoi", F.lit("town")).where("id <> 0").withColumnRenamed("geometry", "mp")
    aois = spark.createDataFrame([("town",), ("desert",)], "slug string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        written = {(r.aoi, r.bf_source): (r.parts, r.n) for r in K.write_layers(
            layers, aois, str(path), ("google", "microsoft"), part_features=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert written == {("town", "google"): (3, 15), ("town", "microsoft"): (2, 8), ("desert", "google"): (1, 0), ("desert", "microsoft"): (1, 0)}
    found = {}
    for (aoi, source), (parts, _) in written.items():
        for k in range(parts):
            file, = (path / f"aoi={aoi}" / f"bf_source={source}" / f"part={k}").glob("*.txt")
            document = json.loads(file.read_text())
            assert document["type"] == "FeatureCollection"
            found.setdefault((aoi, source), []).extend(f["properties"]["id"] for f in document["features"])
    assert {k: sorted(v) for k, v in found.items()} == {
        ("town", "google"): [i for i in range(1, 24) if i % 3 != 2], ("town", "microsoft"): [i for i in range(24) if i % 3 == 2],
        ("desert", "google"): [], ("desert", "microsoft"): []} and K.read_geojson(spark, str(path), documents=True).count() == 23


def test_geoparquet_splits_a_country_over_files(spark, lots, tmp_path):
    path = str(tmp_path / "out")
    many = lots.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("country_iso", F.lit("BRA"))
    K.write_geoparquet(many, path, "geometry", ("country_iso",), files=4)
    back = spark.read.parquet(path)
    assert back.count() == 1200 and len(back.inputFiles()) > 1
    assert back.dtypes[back.columns.index("geometry")][1] == "binary"


def test_clip_table_replaces_only_its_areas(spark, tmp_path):
    path = str(tmp_path / "clip")
    K.write_clip(spark.createDataFrame([("a", 1), ("b", 2)], "aoi string, n int"), path)
    K.write_clip(spark.createDataFrame([("a", 9)], "aoi string, n int"), path)
    assert sorted((r.aoi, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
