"""Registered queries take whole tables and all steps of their operators, on rows built here."""

import math

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from rooftally.plans import registered as R

NOTCHED = 212


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twenty-four customers, of whose blocks three end in 3, two hundred orders among them, four suppliers; one town.

    Order 212 is a square over the inner corner of the first supplier's area, by half a metre upwards.
    """
    base = tmp_path_factory.mktemp("tables")
    spark.range(1, 25).selectExpr("id AS c_custkey").write.parquet(f"{base}/customer.parquet")
    spark.range(200).union(spark.range(NOTCHED, NOTCHED + 1)).selectExpr(
        "id AS o_orderkey", "1 + id % 24 AS o_custkey", f"if(id = {NOTCHED}, pow(0.003175D * 20D * 111000D, 2), 10000D + id * 90D) AS o_totalprice",
        "if(id % 3 = 0, 'P', 'O') AS o_orderstatus").write.parquet(f"{base}/orders.parquet")
    spark.range(1, 5).selectExpr("id AS s_suppkey", "concat('Supplier ', id) AS s_name", "cast(id % 2 AS int) AS s_nationkey").write.parquet(f"{base}/supplier.parquet")
    spark.range(2).selectExpr("cast(id AS int) AS n_nationkey", "concat('Nation ', id) AS n_name").write.parquet(f"{base}/nation.parquet")
    return str(base)


def by_sql(tables, name, *used):
    con = duckdb.connect()
    for t in used:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    return con.execute(oracle_sql()[name]).fetchall()


def test_blocks_of_all_customers_are_paired(spark, tables):
    got = [tuple(r) for r in queries()["shape_pairs"](spark, tables).select("block", "id", "shared_m2").collect()]
    assert {block for block, _, _ in got} == set(range(1, 25))
    assert sorted(got) == sorted(by_sql(tables, "shape_pairs", "customer", "orders", "supplier", "nation"))


def test_written_layers_have_simplified_outlines_and_whole_areas(spark, tables, monkeypatch):
    write, written = R.K.write_layers, []

    def noted(layers, aois, path, *args, **options):
        written.append(path)
        return write(layers, aois, path, *args, **options)

    monkeypatch.setattr(R.K, "write_layers", noted)
    got = R.write_layers(spark, tables).select("aoi", "bf_source", "n", "area_m2", "n_files")
    assert sorted(map(tuple, got.collect())) == sorted(by_sql(tables, "write_layers", "supplier", "nation", "orders"))
    features = R.K.read_geojson(spark, written[0], documents=True).where("aoi = 'aoi_000000001' AND bf_source = 'google'").collect()
    largest = max(features, key=lambda r: float(r.properties["area_m2"]))
    # the shape is an L of six corners, the notch less deep than the tolerance; its area is the one before
    assert len(largest.mp) == 1 and len(largest.mp[0][0]) < 7
    x, y, factor = 0.02663 - 0.024, 0.003175, 111_000.0 ** 2 * math.cos(math.radians(-21.95 + 0.00017 + 0.007))
    assert float(largest.properties["area_m2"]) == pytest.approx((x * y + (y - x) * (0.00717 - 0.004)) * factor, abs=0.02)
