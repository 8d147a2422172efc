"""Footprints and areas of interest derived from order tables, for the registered queries.

The tables hold no geometry, so every order becomes a footprint and every supplier an area of interest. Towns of
7,500 lots stand side by side, each with 50 areas, so that both grow with the data at constant density. All shapes
are unions of axis-aligned boxes: the engine treats them as general polygons, while plain SQL can check every
overlap by box arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rooftally.functions import geometry as G
from rooftally.functions.plan import compute_once
from rooftally.functions.wkb import multipolygon_to_wkb

LOTS_PER_TOWN = 7500
AOIS_PER_TOWN = 50
# Two areas of each town lie in the sea, far from any footprint.
SEA = "(pmod(s_suppkey, 25L) = 24)"
# Three- and two-letter codes for the nations by number.
NATION_CODES = ("LSO LS, BRA BR, IND IN, PRT PT, EGY EG, DZA DZ, ARG AR, JPN JP, FRA FR, SAU SA, KEN KE, CAN CA, IDN ID, "
                "DEU DE, IRN IR, MOZ MZ, PER PE, VNM VN, ROU RO, JOR JO, NGA NG, USA US, CHN CN, GBR GB, IRQ IQ")
ISO3_TO_ISO2 = dict(pair.split() for pair in NATION_CODES.split(", "))
REGION_TO_ISO3 = {"AFRICA": "LSO", "AMERICA": "BRA", "ASIA": "IND", "EUROPE": "PRT", "MIDDLE EAST": "EGY"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Short rows dealt over the cluster before they grow into shapes; a file of the order tables is one row group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _town_x(town: str) -> str:
    return f"(-45.4D + pmod({town}, 400L) * 0.25D)"


def _town_y(town: str) -> str:
    return f"(-21.95D + pmod(floor({town} / 400), 300L) * 0.2D)"


def _box(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"array(array({x0}, {y0}), array({x1}, {y0}), array({x1}, {y1}), array({x0}, {y1}), array({x0}, {y0}))"


def _corner(x0: str, y0: str, xm: str, ym: str, x1: str, y1: str) -> str:
    """Box without its upper right quarter."""
    return f"""array(array({x0}, {y0}), array({x1}, {y0}), array({x1}, {ym}), array({xm}, {ym}), array({xm}, {y1}),
        array({x0}, {y1}), array({x0}, {y0}))"""


# --- footprints ----------------------------------------------------------------------------------------------
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry, bf_source, confidence, area_in_meters, customer key."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS custkey", "o_totalprice",
        "if(o_orderstatus = 'P', 'microsoft', 'google') AS bf_source")
    town = f"floor(id / {LOTS_PER_TOWN})"
    lot = compute_once(
        dealt(orders, "id"), side=F.expr("sqrt(o_totalprice) / 20D / 111000D"),
        x0=F.expr(f"{_town_x(town)} + pmod(id, 100L) * 0.002D"),
        y0=F.expr(f"{_town_y(town)} + pmod(floor(id / 100), 75L) * 0.002D"))

    def x(part):
        return f"(x0 + side * {part}D)"

    def y(part):
        return f"(y0 + side * {part}D)"

    x1, y1 = "(x0 + side)", "(y0 + side)"
    shape = F.expr(f"""CASE
        WHEN id % 4 = 3 THEN array(array({_corner('x0', 'y0', x(0.5), y(0.5), x1, y1)}))
        WHEN id % 16 = 1 THEN array(array({_box('x0', 'y0', x1, y1)}, {_box(x(0.25), y(0.25), x(0.75), y(0.75))}))
        WHEN id % 16 = 9 THEN array(array({_box('x0', 'y0', x(0.375), y1)}), array({_box(x(0.625), 'y0', x1, y1)}))
        ELSE array(array({_box('x0', 'y0', x1, y1)})) END""")
    return compute_once(lot, geometry=shape).selectExpr(
        "id", "geometry", "bf_source", "0.65D + pmod(id, 36L) * 0.01D AS confidence",
        "side * side * 12321000000D AS area_in_meters", "custkey")


def with_country(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``country_iso`` (three letters) by the customer's nation and region."""
    codes = F.create_map(*[F.lit(v) for pair in REGION_TO_ISO3.items() for v in pair])
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    country = (table(spark, sf_dir, "customer")
               .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
               .select(F.col("c_custkey").alias("custkey"), codes[F.col("r_name")].alias("country_iso")))
    return df.join(country, "custkey")


def with_nation(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add ``country_iso`` by the customer's nation: twenty-five countries."""
    codes = F.array(*map(F.lit, ISO3_TO_ISO2))
    country = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.get(codes, F.col("c_nationkey").cast("int")).alias("country_iso"))
    return df.join(country, "custkey")


def iso2(column: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in ISO3_TO_ISO2.items() for v in pair])[column]


# --- areas of interest -----------------------------------------------------------------------------------------
def _aoi_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    town, seat = f"floor(s_suppkey / {AOIS_PER_TOWN})", f"pmod(s_suppkey, {AOIS_PER_TOWN}L)"
    named = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey").join(
        table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        F.col("s_nationkey") == F.col("n_nationkey"), "left")
    # seat 0 is the whole town
    return compute_once(
        named, key=F.col("s_suppkey"), slug=F.expr("concat('aoi_', lpad(string(s_suppkey), 9, '0'))"),
        x0=F.expr(f"""if({seat} = 0, {_town_x(town)} - 0.00013D,
            {_town_x(town)} + pmod({seat}, 10L) * 0.019D + 0.00013D - if({SEA}, 124.6D, 0D))"""),
        y0=F.expr(f"""if({seat} = 0, {_town_y(town)} - 0.00017D,
            {_town_y(town)} + floor({seat} / 10) * 0.027D + 0.00017D)"""),
        w=F.expr(f"if({seat} = 0, 0.2003D, 0.011D + pmod(s_suppkey, 7L) * 0.004D)"),
        h=F.expr(f"if({seat} = 0, 0.1503D, 0.009D + pmod(s_suppkey, 5L) * 0.005D)"))


def shape_of(key: str) -> Column:
    return F.expr(f"""CASE {key} % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'corner' WHEN 2 THEN 'holed' ELSE 'parts' END""")


def aoi_documents(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """GeoJSON text per supplier: box, L-shape, box with a hole, or two parts. With ``broken``, some break a rule."""
    def x(part):
        return f"(x0 + w * {part}D)"

    def y(part):
        return f"(y0 + h * {part}D)"

    x1, y1 = "(x0 + w)", "(y0 + h)"
    coordinates = f"""CASE key % 4
        WHEN 1 THEN to_json(array({_corner('x0', 'y0', x(0.5), y(0.5), x1, y1)}))
        WHEN 2 THEN to_json(array({_box('x0', 'y0', x1, y1)}, {_box(x(0.25), y(0.25), x(0.75), y(0.75))}))
        WHEN 3 THEN to_json(array(array({_box('x0', 'y0', x(0.375), y1)}), array({_box(x(0.625), 'y0', x1, y1)})))
        ELSE to_json(array({_box('x0', 'y0', x1, y1)})) END"""
    geometry_type, document_type, n_features = "if(key % 4 = 3, 'MultiPolygon', 'Polygon')", "'FeatureCollection'", "1"
    if broken:
        coordinates = f"""CASE key % 20 WHEN 10 THEN to_json(array(x0, y0)) WHEN 11 THEN '[]'
            WHEN 12 THEN to_json(array({_box('(x0 + 300D)', 'y0', f'({x1} + 300D)', y1)}))
            WHEN 13 THEN to_json(array({_box('x0', '(y0 + 200D)', x1, f'({y1} + 200D)')}))
            ELSE {coordinates} END"""
        geometry_type = f"""CASE WHEN key % 20 = 10 THEN 'Point' WHEN key % 20 IN (11, 12, 13) THEN 'Polygon'
            ELSE {geometry_type} END"""
        document_type = f"if(key % 20 = 8, 'Feature', {document_type})"
        n_features = f"CASE key % 20 WHEN 9 THEN 2 WHEN 14 THEN 0 ELSE 1 END"
    properties = f"""to_json(named_struct('nome', s_name, 'uf', if(key % 5 != 4, n_name, NULL),
        'ibge_code', string(3100000 + key), 'area_km2_oficial', if(key % 3 != 0, w * h * 12321D, NULL),
        'tipologia', CASE key % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'corner' WHEN 2 THEN 'holed' ELSE 'parts' END,
        'populacao_2022', key * 7 + 100))"""
    feature = f"""format_string('{{"type":"Feature","properties":%s,"geometry":{{"type":"%s","coordinates":%s}}}}',
        {properties}, {geometry_type}, {coordinates})"""
    document = f"""format_string('{{"type":"%s","name":"%s","features":[%s]}}', {document_type}, slug,
        concat_ws(',', array_repeat({feature}, {n_features})))"""
    if broken:
        document = f"if(key % 20 = 7, concat('<moved>', slug), {document})"
    return compute_once(_aoi_frame(spark, sf_dir), document=F.expr(document)).select("slug", "document")


def large_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: a block for every customer, larger than the tiles of the areas around it; every fourth has a courtyard."""
    town, lot = "floor(c_custkey / 750)", "pmod(c_custkey, 750L)"
    placed = compute_once(
        dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), id=F.col("c_custkey"),
        x0=F.expr(f"{_town_x(town)} + pmod({lot}, 25L) * 0.007D"), y0=F.expr(f"{_town_y(town)} + floor({lot} / 25) * 0.004D"),
        side=F.expr("0.013D + pmod(c_custkey, 9L) * 0.011D"))
    inner = _box("(x0 + side * 0.25D)", "(y0 + side * 0.25D)", "(x0 + side * 0.75D)", "(y0 + side * 0.75D)")
    outer = _box("x0", "y0", "(x0 + side)", "(y0 + side)")
    return compute_once(placed, geometry=F.expr(f"if(id % 4 = 1, array(array({outer}, {inner})), array(array({outer})))")).select("id", "geometry")


def faulty_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: WKB of which some is torn, some has open rings and some has rings of three points."""
    def cut(points: str) -> str:
        return f"transform(geometry, polygon -> transform(polygon, ring -> {points}))"

    rows = footprints(spark, sf_dir).select("id", F.expr(f"""CASE WHEN id % 13 = 0 THEN {cut('slice(ring, 1, size(ring) - 1)')}
        WHEN id % 17 = 0 THEN {cut('concat(slice(ring, 1, 2), slice(ring, 1, 1))')} ELSE geometry END""").alias("mp"))
    wkb = rows.select("id", multipolygon_to_wkb("mp").alias("geometry"))
    return wkb.select("id", F.expr("if(id % 11 = 0, substring(geometry, 1, length(geometry) - 5), geometry)").alias("geometry"))


# --- edge contact --------------------------------------------------------------------------------------------------
def lattice_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on multiples of 1/512 degree, so that shared edges and corners are exact."""
    key = F.col("o_orderkey")
    lot, town = F.pmod(key, F.lit(LOTS_PER_TOWN)), F.floor(key / LOTS_PER_TOWN)
    x0, y0 = _lattice_origin(town)
    size = F.when(key % 3 == 0, 2.0 ** -8).otherwise(2.0 ** -9)
    placed = compute_once(table(spark, sf_dir, "orders"), id=key, size=size,
                          x0=x0 + F.pmod(lot, F.lit(64)) / 256.0, y0=y0 + F.floor(lot / 64) / 256.0)
    ring = G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("size"), F.col("y0") + F.col("size"))
    return compute_once(placed, geometry=F.array(F.array(ring))).select("id", "geometry")


def _lattice_origin(town: Column) -> tuple[Column, Column]:
    return (F.lit(-180.0) + F.pmod(town, F.lit(1440)) * F.lit(0.25),
            F.lit(-90.0) + F.pmod(F.floor(town / 1440), F.lit(360)) * F.lit(0.5))


def lattice_aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with a hole on the same lattice: footprints touch them from outside and from inside the hole."""
    key = F.col("s_suppkey")
    seat, town = F.pmod(key, F.lit(AOIS_PER_TOWN)), F.floor(key / AOIS_PER_TOWN)
    ox, oy = _lattice_origin(town)
    placed = compute_once(table(spark, sf_dir, "supplier"), slug=key.cast("string"),
                          minx=ox + F.pmod(seat, F.lit(10)) * F.lit(0.0234375),
                          miny=oy + F.floor(seat / 10) * F.lit(0.09375))
    placed = compute_once(placed, maxx=F.col("minx") + F.lit(0.03125), maxy=F.col("miny") + F.lit(0.0625))
    outer = G.box(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    inner = G.box(F.col("minx") + 2.0 ** -7, F.col("miny") + 2.0 ** -6, F.col("maxx") - 2.0 ** -7,
                  F.col("maxy") - 2.0 ** -6)
    return compute_once(placed, mp=F.array(F.array(outer, inner))).select("slug", "mp", "minx", "miny", "maxx", "maxy")
