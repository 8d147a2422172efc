"""GeoParquet written, indexed, and read only where areas need it."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import LOT_DEPTH, LOT_WIDTH, collection, documents, feature, lot_corner, square
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators import spatial_join as J
from rooftally.sources import geoparquet as GP
from rooftally.sources.aois import read_aois
from rooftally.sources.footprints import prepare_footprints

SPOT = feature([square(lot_corner(2)[0], lot_corner(2)[1], 0.003)])


def files(path):
    return sorted(p for p in path.rglob("*.parquet") if not any(q.startswith("_") for q in p.relative_to(path).parts))


def test_key_box_and_rows(spark, lots, tmp_path):
    GP.write_geo(lots, str(tmp_path / "g"), "geometry", files=3)
    boxes, rows = [], 0
    for f in files(tmp_path / "g"):
        footer = pq.ParquetFile(f).metadata
        geo = json.loads(footer.metadata[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert geo["version"] == "1.1.0" and column["encoding"] == "WKB" and column["geometry_types"] == ["Polygon"]
        assert column["crs"]["id"] == {"authority": "EPSG", "code": 4326} and column["covering"]["bbox"]["ymax"] == ["bbox", "ymax"]
        boxes.append(column["bbox"])
        rows += footer.num_rows
    (x0, y0), (x1, y1) = lot_corner(0), lot_corner(23)
    assert rows == 24 and len(boxes) == 3
    assert [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] == [
        x0, y0, x1 + LOT_WIDTH, y1 + LOT_DEPTH]
    back = prepare_footprints(spark.read.parquet(str(tmp_path / "g")))
    want = prepare_footprints(lots).select("id", "minx", "maxy", "area_deg2")
    assert sorted(map(tuple, back.select("id", "minx", "maxy", "area_deg2").collect())) == sorted(map(tuple, want.collect()))
    assert not [p for p in (tmp_path / "g").iterdir() if p.name.startswith("_writing")]


def test_overwrite_append_partitions_and_file_size(spark, lots, tmp_path):
    path = str(tmp_path / "p")
    for _ in range(2):
        GP.write_geo(lots, path, "geometry", partition_by=("bf_source",), files=2)
    assert spark.read.parquet(path).groupBy("bf_source").count().collect() and spark.read.parquet(path).count() == 24
    assert {p.parent.name for p in files(tmp_path / "p")} == {"bf_source=google", "bf_source=microsoft"}
    GP.write_geo(lots.where("id < 5"), path, "geometry", partition_by=("bf_source",), mode="append", rows_per_file=2)
    index = GP.file_index(spark, path)
    assert spark.read.parquet(path).count() == 29 and index.agg(F.sum("n_rows")).first()[0] == 29
    with pytest.raises(ValueError, match="31983"):
        GP.write_geo(lots, path, "geometry", crs="EPSG:31983")


def test_a_failed_write_leaves_the_old_files(spark, lots, tmp_path):
    path = str(tmp_path / "f")
    GP.write_geo(lots, path, "geometry")
    before = [(p, p.stat().st_size) for p in files(tmp_path / "f")]
    broken = prepare_footprints(lots).withColumn("confidence", F.when(F.col("id") == 20, F.raise_error(F.lit("stop")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="stop"):
        GP.write_geo(broken, path, "geometry")
    assert [(p, p.stat().st_size) for p in files(tmp_path / "f")] == before and spark.read.parquet(path).count() == 24


def test_nulls_empty_tables_and_many_parts(spark, tmp_path):
    mp = "array<array<array<array<double>>>>"
    rows = spark.createDataFrame([(1, None), (2, [[square(0.0, 0.0)], [square(1.0, 1.0)]])], f"id int, geometry {mp}")
    GP.write_geo(rows, str(tmp_path / "n"), "geometry", files=1)
    r = GP.file_index(spark, str(tmp_path / "n")).first()
    assert (r.n_rows, r.minx, r.maxx, r.error) == (2, 0.0, 1.001, None) and "MultiPolygon" in r.geo
    GP.write_geo(rows.where("id = 1"), str(tmp_path / "o"), "geometry", files=1)
    assert GP.file_index(spark, str(tmp_path / "o")).first().minx is None
    GP.write_geo(rows.where("id > 5"), str(tmp_path / "e"), "geometry")
    aois = read_aois(documents(spark, a=collection(SPOT)))
    assert GP.read_near(spark, str(tmp_path / "o"), aois).footprints.count() == 1  # a file without a box is always read
    scan = GP.read_near(spark, str(tmp_path / "e"), aois)
    assert (scan.n_files, scan.n_present, scan.footprints.count()) == (0, 0, 0)


def test_only_needed_files_and_both_labels(spark, lots, tmp_path):
    path = str(tmp_path / "m")
    GP.write_geo(lots.where("bf_source = 'google'"), path, "geometry", files=6)
    GP.write_geo(lots.where("bf_source = 'microsoft'"), path, "geometry", files=6, crs=GP.CRS84, mode="append")
    aois = read_aois(documents(spark, spot=collection(SPOT)))
    scan = GP.read_near(spark, path, aois)
    assert 0 < scan.n_files < scan.n_present == len(files(tmp_path / "m"))
    tiles = J.tile_aois(aois)
    whole = J.clip(lots, tiles, ("id",)).select("id", F.round("area_deg2", 12)).collect()
    assert sorted(J.clip(scan.footprints, tiles, ("id",), crs=scan.crs).select("id", F.round("area_deg2", 12)).collect()) == sorted(whole)
    everywhere = read_aois(documents(spark, all=collection(feature([square(-51.0, -16.0, 2.0)]))))
    assert GP.read_near(spark, path, everywhere).crs == ("EPSG:4326", "OGC:CRS84")


def plain_file(path, geo=None, rows=1):
    table = pa.table({"geometry": [b"\x00"] * rows, "bbox": [{"xmin": -50.5, "ymin": -15.25, "xmax": -50.4, "ymax": -15.2}] * rows})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)} if geo else None), path)


def test_labels_come_from_the_files(spark, tmp_path):
    def column(**crs):
        return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": [], **crs}}}

    aois = read_aois(documents(spark, a=collection(feature([square(-50.5, -15.25, 0.1)]))))
    cases = {"none": (column(), ("OGC:CRS84",)), "null": (column(crs=None), ("undefined",)), "other": (column(crs={"id": {"authority": "EPSG", "code": 31983}}), ("EPSG:31983",)),
             "plain": (None, ())}
    for name, (geo, want) in cases.items():
        (tmp_path / name).mkdir()
        plain_file(tmp_path / name / "a.parquet", geo)
        assert GP.read_near(spark, str(tmp_path / name), aois).crs == want, name
    with pytest.raises(ValueError, match="31983"):
        J.check_crs(*GP.read_near(spark, str(tmp_path / "other"), aois).crs)
    with pytest.raises(ValueError, match="undefined"):
        J.check_crs(*GP.read_near(spark, str(tmp_path / "null"), aois).crs)


def test_a_broken_file_is_listed_and_not_read(spark, lots, tmp_path):
    path = tmp_path / "b"
    GP.write_geo(lots, str(path), "geometry", files=1)
    (path / "torn.parquet").write_bytes(b"no parquet at all")
    rows = {r.file.rpartition("/")[2]: r for r in GP.file_index(spark, str(path)).collect()}
    assert rows["torn.parquet"].error and rows["torn.parquet"].n_rows is None and rows["torn.parquet"].n_bytes == 17
    assert sum(r.n_rows or 0 for r in rows.values()) == 24
    with pytest.raises(ValueError, match="torn.parquet"):
        GP.read_near(spark, str(path), read_aois(documents(spark, a=collection(SPOT))))


def test_boxes_from_statistics_of_raw_files(spark, lots, tmp_path):
    """Files of others, with a bbox struct and no key: their row groups' statistics tell the box."""
    raw = lots.select("id", multipolygon_to_wkb("geometry").alias("geometry"), *[F.col(c) for c in ("bf_source",)])
    boxed = prepare_footprints(lots).select("id", *[F.col(b).alias(c) for b, c in zip(("minx", "miny", "maxx", "maxy"), ("xmin", "ymin", "xmax", "ymax"))])
    joined = raw.join(boxed.select("id", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox")), "id")
    joined.repartitionByRange(6, "id").write.parquet(str(tmp_path / "raw"))
    scan = GP.read_near(spark, str(tmp_path / "raw"), read_aois(documents(spark, spot=collection(SPOT))))
    assert 0 < scan.n_files < scan.n_present and scan.crs == ()
