"""The registered queries: every operator over whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rooftally.functions import geometry as G
from rooftally.functions import measures as M
from rooftally.functions.plan import compute_once
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators import layers as L
from rooftally.operators import lifecycle as T
from rooftally.operators import shape_join
from rooftally.operators import summary as S
from rooftally.operators.spatial_join import AoiTiles, bbox_prefilter, clip, tile_aois
from rooftally.plans import sample_world as W
from rooftally.plans.analyze import analyze_country
from rooftally.plans.dashboard import dashboard_payload
from rooftally.sources import aois as A
from rooftally.sources import footprints as P
from rooftally.sources import geoparquet as GP
from rooftally.sources import writers as K
from rooftally.sources.documents import read_documents
from rooftally.sources.quarantine import set_aside
from rooftally.workspace import fresh_path

LATITUDE = -21.88
BRAZIL_BOX = (-74.0, -34.0, -34.0, 5.0)

_tiles: dict[tuple[str, str], AoiTiles] = {}


def world_aois(spark: SparkSession, sf: str) -> DataFrame:
    return A.read_aois(W.aoi_documents(spark, sf))


def world_tiles(spark: SparkSession, sf: str) -> AoiTiles:
    """Tiles of all areas: a written layer, prepared once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tiles:
        _tiles[key] = tile_aois(world_aois(spark, sf))
    return _tiles[key]


def world_clip(spark: SparkSession, sf: str, keep=("bf_source",), with_geometry: bool = False) -> DataFrame:
    return clip(W.footprints(spark, sf), world_tiles(spark, sf), keep, with_geometry=with_geometry)


def _compared(spark, sf):
    return S.compare_aois(world_clip(spark, sf), world_aois(spark, sf))


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources ---------------------------------------------------------------------------------------------------------
def _write_countries(spark, sf) -> str:
    base = fresh_path(spark, "countries")
    world = W.with_country(W.footprints(spark, sf), spark, sf).drop("custkey")
    K.write_geoparquet(world, f"{base}/by_country_s2", "geometry", ("country_iso",))
    return base


def read_country_count(spark, sf):
    return S.count_by_source(P.read_country(spark, _write_countries(spark, sf), "BRA"))


def single_vs_merged(spark, sf):
    """Merged dataset (three-letter codes) against the one without the second source (two-letter codes), all countries."""
    world = W.with_nation(W.footprints(spark, sf), spark, sf).drop("custkey")
    base = fresh_path(spark, "countries")
    K.write_geoparquet(world, f"{base}/by_country_s2", "geometry", ("country_iso",))
    merged = spark.read.parquet(f"{base}/by_country_s2")
    single_path = fresh_path(spark, "single")
    (L.filter_source(merged, "google").withColumn("country_iso", W.iso2(F.col("country_iso"))).drop("bf_source")
     .write.partitionBy("country_iso").parquet(single_path))
    whole = P.read_country_single_source(spark, single_path, *W.ISO3_TO_ISO2.values())
    whole = whole.withColumn("country_iso", P.iso3_of(F.col("country_iso"), W.ISO3_TO_ISO2))
    return S.source_coverage(merged, whole, "country_iso")


def only_in_merged(spark, sf):
    """Footprints that a second dataset, with its own rows and other ids among them, does not have."""
    world = W.footprints(spark, sf).select("id", "bf_source")
    path = fresh_path(spark, "second")
    second = L.filter_source(world, "google").where("id % 5 <> 0").select("id")
    second.union(world.select(F.col("id") + F.lit(1 << 40))).write.parquet(path)
    return S.only_in_first(world, spark.read.parquet(path), ["id"])


def analyze_files(spark, sf):
    """Flagship from files: write a country as WKB Parquet, read it back, clip, summarise."""
    return _rounded(analyze_country(spark, _write_countries(spark, sf), "BRA", W.aoi_documents(spark, sf)))


def read_materialised(spark, sf):
    database = _new_database(spark)
    K.keep_table(world_clip(spark, sf), f"{database}.recorte_all")
    return _rounded(S.aoi_summary(P.read_materialised(spark, f"{database}.recorte_all")))


# --- areas of interest ---------------------------------------------------------------------------------------------
def list_aois(spark, sf):
    path = fresh_path(spark, "aois")
    W.aoi_documents(spark, sf, broken=True).select("document").write.text(path)
    return (A.list_aois(A.read_documents(spark, path, one_per_line=True))
            .select("slug", F.col("properties")["nome"].alias("nome"), F.col("properties")["ibge_code"].alias("code")))


def aoi_violations(spark, sf):
    return (A.check_aois(W.aoi_documents(spark, sf, broken=True))
            .select("slug", F.concat_ws("; ", "violations").alias("violations")))


def aoi_bounds(spark, sf):
    aois = world_aois(spark, sf)
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    return _rounded(aois.select("slug", *box, M.mean_latitude(box[1], box[3]).alias("lat_mean"),
                                M.bbox_area_km2(*box).alias("bbox_km2")), 6)


def aoi_display(spark, sf):
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    return _rounded(world_aois(spark, sf).select(
        "slug", "display_name", M.official_or_bbox_km2(F.col("properties"), *box).alias("official_km2"),
        F.col("properties")["populacao_2022"].try_cast("bigint").alias("population")), 6)


def get_aoi(spark, sf):
    """One area by its slug, among documents of which some break a rule."""
    found = A.get_aoi(W.aoi_documents(spark, sf, broken=True), "aoi_000000001")
    return _rounded(found.select("slug", "display_name", "minx", "miny", "maxx", "maxy"), 6)


def ring_checks(spark, sf):
    return A.ring_checks(world_aois(spark, sf), BRAZIL_BOX)


def aoi_enriched(spark, sf):
    """Boundaries with metadata for two in three areas, half of which bring their own code."""
    key = F.col("key")
    frame = W._aoi_frame(spark, sf)
    boundaries = world_aois(spark, sf).select("slug", "mp").join(
        frame.select("slug", (F.lit(3100000) + key).alias("code")), "slug")
    own = F.create_map(F.lit("nome"), F.col("s_name"), F.lit("ibge_code"), F.lit("9999999"))
    named = F.create_map(F.lit("nome"), F.col("s_name"))
    metadata = (frame.withColumn("metadata", F.when(key % 3 == 1, own).when(key % 3 == 2, named))
                .where(F.col("metadata").isNotNull()).select("slug", "metadata"))
    p = F.col("properties")
    return A.enrich_aois(boundaries, metadata, "code", "official boundaries").select(
        "slug", p["nome"].alias("nome"), p["ibge_code"].alias("code"), p["fonte_poligono"].alias("origin"),
        F.size("mp").cast("bigint").alias("n_parts"))


# --- footprints ----------------------------------------------------------------------------------------------------
def filter_source(spark, sf):
    return L.filter_source(W.footprints(spark, sf), "microsoft").select("id", "bf_source")


def _measured(spark, sf):
    return P.prepare_footprints(W.footprints(spark, sf))


def filter_min_area(spark, sf):
    return L.filter_min_area(_measured(spark, sf), 200.0, M.m2_factor(LATITUDE)).select("id")


def filter_min_area_equatorial(spark, sf):
    return L.filter_min_area(_measured(spark, sf), 200.0).select("id")


def footprint_area_m2(spark, sf):
    df = L.with_area(_measured(spark, sf), M.m2_factor(LATITUDE))
    return df.select("id", "area_m2", "area_ha")


def bbox_centre(spark, sf):
    return _rounded(L.with_centre(_measured(spark, sf)).select("id", "centre_lon", "centre_lat"), 6)


def simplify_vertices(spark, sf):
    """Outlines with a needless vertex in the middle of every edge lose exactly those."""
    def with_midpoints(ring):
        halves = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.array(
            ring[i], F.array((ring[i][0] + ring[i + 1][0]) / 2, (ring[i][1] + ring[i + 1][1]) / 2)))
        return F.concat(F.flatten(halves), F.array(F.element_at(ring, -1)))

    dense = W.footprints(spark, sf).select("id", F.transform("geometry", lambda p: F.transform(p, with_midpoints))
                                           .alias("mp"))
    def n_points(mp):
        return F.size(F.expr(G.points(mp))).cast("bigint")

    kept = L.simplify(dense.withColumn("n_before", n_points("mp")), 1e-6)
    return kept.select("id", "n_before", n_points("mp").alias("n_after"))


def simplify_slanted(spark, sf):
    """Slanted outlines, some with holes or parts, of which every edge has a vertex beside its middle: those within the tolerance go, others stay."""
    off = "if(id % 2 = 0, 5e-8D, 3e-7D)"
    middle = f"""array((r[i][0] + r[i + 1][0]) / 2 + {off} * (r[i + 1][1] - r[i][1]) / hypot(r[i + 1][0] - r[i][0], r[i + 1][1] - r[i][1]),
        (r[i][1] + r[i + 1][1]) / 2 - {off} * (r[i + 1][0] - r[i][0]) / hypot(r[i + 1][0] - r[i][0], r[i + 1][1] - r[i][1]))"""
    dense = f"""transform(geometry, p -> transform(p, r -> concat(flatten(transform(sequence(0, size(r) - 2), i -> array(r[i], {middle}))),
        array(element_at(r, -1)))))"""
    turned = """transform(mp, p -> transform(p, r -> transform(r, v -> array(
        mp[0][0][0][0] + (v[0] - mp[0][0][0][0]) * 0.8D - (v[1] - mp[0][0][0][1]) * 0.6D,
        mp[0][0][0][1] + (v[0] - mp[0][0][0][0]) * 0.6D + (v[1] - mp[0][0][0][1]) * 0.8D))))"""
    shapes = W.footprints(spark, sf).select("id", F.expr(dense).alias("mp"))
    shapes = compute_once(shapes, mp=F.expr(turned)).withColumn("n_before", F.size(F.expr(G.points("mp"))).cast("bigint"))
    return L.simplify(shapes, 1e-7).select("id", "n_before", F.size(F.expr(G.points("mp"))).cast("bigint").alias("n_after"))


# --- joins ---------------------------------------------------------------------------------------------------------
def spatial_join_pairs(spark, sf):
    return world_clip(spark, sf, ("id",)).select("id", F.col("aoi").alias("slug"))


def spatial_join_touch(spark, sf):
    """Contact along edges and at corners counts, and has no area."""
    tiles = tile_aois(W.lattice_aois(spark, sf))
    pairs = clip(W.lattice_footprints(spark, sf), tiles, ("id",))
    return pairs.select("id", F.col("aoi").alias("slug"), (F.col("area_deg2") == 0).alias("touch_only"))


def spatial_join_shuffled(spark, sf):
    """The same pairs by the way taken when the tiles are too big to broadcast."""
    pairs = clip(W.footprints(spark, sf), world_tiles(spark, sf), ("id",), broadcast_bytes=0)
    return pairs.groupBy(F.col("aoi").alias("slug")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


def spatial_join_large(spark, sf):
    """Blocks larger than the areas' tiles, by the shuffled way: cut along the tiles."""
    pairs = clip(W.large_footprints(spark, sf), world_tiles(spark, sf), ("id",), broadcast_bytes=0)
    return _rounded(pairs.select("id", F.col("aoi").alias("slug"), (F.col("area_deg2") * M.M2_PER_DEG2).alias("area_m2")))


def shape_pairs(spark, sf):
    """Blocks and footprints whose shapes share a point, from two tables without common ids."""
    blocks = W.large_footprints(spark, sf).withColumnRenamed("id", "block")
    pairs = shape_join.shape_pairs(blocks, W.footprints(spark, sf), "block", "id")
    return _rounded(pairs.select("block", "id", (F.col("shared_deg2") * M.M2_PER_DEG2).alias("shared_m2")), 3)


def only_in_merged_by_shape(spark, sf):
    """Footprints that a second dataset, slightly moved and with ids of its own, does not cover to more than half."""
    world = W.footprints(spark, sf)
    moved = F.expr("transform(geometry, p -> transform(p, r -> transform(r, v -> array(v[0] + 0.00001D, v[1]))))")
    second = L.filter_source(world, "google").where("id % 5 <> 0").select(moved.alias("geometry"))
    return shape_join.only_in_first_by_shape(world.select("id", "bf_source", "geometry"), second, least_share=0.5).select("id", "bf_source")


def bbox_candidates(spark, sf):
    tiles = world_tiles(spark, sf)
    return S.count_total(bbox_prefilter(_measured(spark, sf), tiles))


def clip_area(spark, sf):
    pairs = world_clip(spark, sf, ("id",))
    return pairs.select("id", F.col("aoi").alias("slug"),
                        M.area_m2(F.col("area_deg2"), F.col("m2_factor")).alias("area_m2"))


def clip_by_shape(spark, sf):
    shapes = W._aoi_frame(spark, sf).select(F.col("slug").alias("aoi"), W.shape_of("key").alias("shape"))
    per_aoi = world_clip(spark, sf).groupBy("aoi").agg(F.count("*").alias("n"), F.sum("area_deg2").alias("a"))
    return _rounded(per_aoi.join(shapes, "aoi").groupBy("shape").agg(
        F.sum("n").alias("n"), (F.sum("a") * M.M2_PER_DEG2).alias("area_m2")))


def clip_geometry(spark, sf):
    """Area, bounds and part count taken from the clipped shapes themselves."""
    shapes = world_clip(spark, sf, ("id",), with_geometry=True).select("id", F.col("aoi").alias("slug"),
                                                                     F.col("mp").alias("geometry"), "m2_factor")
    measured = P.prepare_footprints(shapes)
    return measured.select("id", "slug", F.round(F.col("area_deg2") * F.col("m2_factor"), 2).alias("area_m2"),
                           *[F.round(c, 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


# --- aggregations ----------------------------------------------------------------------------------------------------
def count_total(spark, sf):
    return S.count_total(world_clip(spark, sf))


def count_by_source(spark, sf):
    return S.count_by_source(world_clip(spark, sf))


def area_by_source(spark, sf):
    return _rounded(S.area_by_source(world_clip(spark, sf), LATITUDE))


def mean_area_by_source(spark, sf):
    return _rounded(S.mean_area_by_source(world_clip(spark, sf), LATITUDE))


def distinct_sources(spark, sf):
    return S.distinct_sources(world_clip(spark, sf))


def aoi_summary(spark, sf):
    return _rounded(S.aoi_summary(world_clip(spark, sf)))


def aoi_summary_maps(spark, sf):
    maps = S.summary_maps(S.aoi_summary(world_clip(spark, sf)), world_aois(spark, sf))
    google, microsoft = M.SOURCES
    return _rounded(maps.select(
        "aoi", "display_name", "total", F.coalesce(F.col("n_by_source")[google], F.lit(0)).alias("n_google"),
        F.col("area_m2_by_source")[microsoft].alias("area_microsoft"),
        F.col("mean_m2_by_source")[google].alias("mean_google")))


def compare_aois(spark, sf):
    wide = _compared(spark, sf)
    return _rounded(wide.select("aoi", "total", "n_google", "n_microsoft", "area_m2_google", "area_m2_microsoft",
                                "mean_m2_google", "mean_m2_microsoft", "bbox_km2", "density_bbox"), 3)


def density_official(spark, sf):
    return _rounded(_compared(spark, sf).select("aoi", "official_km2", "density_official"), 3)


def share_by_source(spark, sf):
    return _rounded(S.share_by_source(S.aoi_summary(world_clip(spark, sf))), 6)


def area_histogram(spark, sf):
    return S.area_histogram(world_clip(spark, sf), world_aois(spark, sf))


def comparison_table(spark, sf):
    return _rounded(S.comparison_table(_compared(spark, sf)), 3)


def built_area_gap(spark, sf):
    return _rounded(S.source_comparison(_compared(spark, sf)).select("aoi", "built_m2", "gap_m2", "google_larger"))


def coverage_class(spark, sf):
    return _rounded(S.source_comparison(_compared(spark, sf)).select("aoi", "google_pct", "coverage"), 6)


def aoi_ratio(spark, sf):
    """Every area against its neighbour by number."""
    frame = W._aoi_frame(spark, sf)
    pairs = frame.select(F.col("slug").alias("aoi_a"), F.concat(
        F.lit("aoi_"), F.lpad((F.col("key") + 1).cast("string"), 9, "0")).alias("aoi_b"))
    return _rounded(S.aoi_ratio(_compared(spark, sf), pairs), 4)


# --- layers and sinks ----------------------------------------------------------------------------------------------
def layers(spark, sf):
    thin = L.layers(world_clip(spark, sf, with_geometry=True), min_area_m2=100.0, tolerance=1e-7)
    return _rounded(thin.groupBy("aoi", "bf_source").agg(
        F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"),
        F.sum(F.expr(G.polygon_area("mp")) * 1e9).alias("simplified_area")))


def write_layers(spark, sf):
    """Layers of a few features per part, thinned by size and outline, each file read back as one document; empty layers too."""
    path = fresh_path(spark, "layers")
    thin = L.layers(world_clip(spark, sf, with_geometry=True), min_area_m2=100.0, tolerance=1e-5)
    written = K.write_layers(thin, world_aois(spark, sf), path, M.SOURCES, part_features=500)
    whole = read_documents(written, path).select("aoi", "bf_source", F.from_json(
        "value", "struct<type: string, features: array<struct<properties: struct<area_m2: double>>>>").alias("d"))
    return _rounded(whole.where("d.type = 'FeatureCollection'").groupBy("aoi", "bf_source").agg(
        F.count("*").alias("n_files"), F.sum(F.size("d.features")).alias("n"),
        F.sum(F.aggregate("d.features", F.lit(0.0), lambda a, x: a + x["properties"]["area_m2"])).alias("area_m2")))


def geojson_roundtrip(spark, sf):
    path = fresh_path(spark, "geojson")
    K.write_geojson(W.footprints(spark, sf), path, "geometry", ["id", "bf_source"])
    back = K.read_geojson(spark, path).select(
        F.col("properties")["id"].cast("bigint").alias("id"), F.col("properties")["bf_source"].alias("bf_source"),
        F.map_keys("properties").alias("_keys"), F.col("mp").alias("geometry"))
    return P.prepare_footprints(back).select(
        "id", "bf_source", F.size("_keys").cast("bigint").alias("n_properties"),
        M.area_m2(F.col("area_deg2"), M.m2_factor(LATITUDE)).alias("area_m2"))


def geoparquet_roundtrip(spark, sf):
    """WKB written in map order and read back; the measures are taken from the bytes again."""
    path = fresh_path(spark, "geoparquet")
    K.write_geoparquet(W.footprints(spark, sf).select("id", "bf_source", "geometry"), path, "geometry")
    back = spark.read.parquet(path).select("id", "bf_source", "geometry")
    return P.prepare_footprints(back).select(
        "id", "bf_source", M.area_m2(F.col("area_deg2"), M.m2_factor(LATITUDE)).alias("area_m2"),
        F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


def _write_both_labels(spark, sf, files: int = 16) -> str:
    """One folder of GeoParquet, each source's files with a label of its own."""
    world, path = W.footprints(spark, sf).select("id", "bf_source", "geometry"), fresh_path(spark, "geo")
    GP.write_geo(L.filter_source(world, "google"), path, "geometry", files=files)
    GP.write_geo(L.filter_source(world, "microsoft"), path, "geometry", files=files, crs=GP.CRS84, mode="append")
    return path


def geoparquet_index(spark, sf):
    """What the footers of written files say: rows and box by label of the coordinate system, and the parts of the key."""
    index = GP.file_index(spark, _write_both_labels(spark, sf))
    key = F.from_json("geo", "struct<version: string, primary_column: string, columns: map<string, struct<encoding: string>>>")
    known = index.select("*", key.alias("k"))
    return _rounded(known.groupBy("crs", F.col("k.version").alias("version"), F.col("k.primary_column").alias("primary_column"),
                                  F.col("k.columns")["geometry"]["encoding"].alias("encoding")).agg(
        F.sum("n_rows").alias("n_rows"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy")), 6)


def geoparquet_clip(spark, sf):
    """The summary of one town in five from GeoParquet with mixed labels: only the files near those areas are read."""
    path = _write_both_labels(spark, sf)
    aois = world_aois(spark, sf).where("cast(substring(slug, 5) AS bigint) DIV 50 % 5 = 0 AND minx > -100")
    scan = GP.read_near(spark, path, aois)
    pairs = clip(scan.footprints, tile_aois(aois), ("bf_source",), crs=scan.crs)
    summary = S.aoi_summary(pairs)
    return _rounded(summary.withColumn("labels", F.lit(", ".join(scan.crs))))


def file_pruning(spark, sf):
    """The footprints near the areas of the first town, from the files that the index names and from all files: some are left out, nothing is lost."""
    path = _write_both_labels(spark, sf)
    aois = world_aois(spark, sf).where("cast(substring(slug, 5) AS bigint) < 50 AND minx > -100")
    scan, tiles = GP.read_near(spark, path, aois), tile_aois(aois)
    whole = bbox_prefilter(P.prepare_footprints(spark.read.parquet(path)), tiles).agg(F.count("*").alias("n_all"))
    some = bbox_prefilter(P.prepare_footprints(scan.footprints), tiles).agg(F.count("*").alias("n_candidates"))
    return some.select("n_candidates", F.lit(whole.first().n_all).alias("n_all"), F.lit(scan.n_files < scan.n_present).alias("pruned"))


def sorted_geometries(spark, sf):
    """Torn bytes, open rings and rings of three points are set aside with their problem; the rest goes on."""
    done = set_aside(W.faulty_wkb(spark, sf))
    kinds = done.bad.groupBy("problem").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))
    rest = P.prepare_footprints(done.sound).agg(F.lit("none").alias("problem"), F.count("*").alias("n"), F.sum("id").alias("id_sum"))
    return kinds.unionByName(rest)


def typed_properties(spark, sf):
    """Properties of all kinds, each with the kind that it keeps and its text."""
    key = F.expr("cast(substring(slug, 5) AS bigint)")
    more = F.format_string('"properties":{"checked":%s,"ratio":%s,"tags":[1,%s],"none":null,', (key % 2 == 0).cast("string"),
                           (key / 4).cast("string"), key.cast("string"))
    docs = W.aoi_documents(spark, sf).withColumn("document", F.replace("document", F.lit('"properties":{'), more))
    each = A.typed_properties(docs).select("slug", F.explode("properties").alias("key", "value"))
    return each.select("slug", "key", F.lower(F.expr("schema_of_variant(value)")).alias("kind"),
                       F.expr("try_variant_get(value, '$', 'string')").alias("value"))


def wkb_decode(spark, sf):
    """Vertices and rings of WKB bytes, decoded to nested arrays."""
    encoded = W.footprints(spark, sf).select("id", multipolygon_to_wkb("geometry").alias("geometry"))
    mp = P.as_multipolygon(encoded)
    decoded = encoded.select("id", F.octet_length("geometry").cast("bigint").alias("n_bytes"), mp.alias("mp"))
    return decoded.select("id", "n_bytes", F.size("mp").cast("bigint").alias("n_parts"),
                          F.size(F.flatten("mp")).cast("bigint").alias("n_rings"),
                          F.size(F.expr(G.points("mp"))).cast("bigint").alias("n_points"))


def payload_typed(spark, sf):
    """Payload whose properties keep their types when written as JSON and read back."""
    aois, docs = world_aois(spark, sf), W.aoi_documents(spark, sf)
    records = dashboard_payload(world_clip(spark, sf), aois, typed=A.typed_properties(docs))
    path = fresh_path(spark, "payload")
    K.write_records(records.select("aoi", "total", "properties", "official_km2"), path)
    back = spark.read.schema("aoi string, total long, properties struct<nome: string, populacao_2022: long, area_km2_oficial: double>, "
                             "official_km2 double").json(path)
    return _rounded(back.select("aoi", "total", "properties.nome", F.col("properties.populacao_2022").alias("population"),
                                F.col("properties.area_km2_oficial").alias("stated_km2"), "official_km2"), 4)


def payload(spark, sf):
    """The records name the parts that ``write_layers`` gives the same layers."""
    clipped, aois = world_clip(spark, sf), world_aois(spark, sf)
    parts = K.layer_parts(L.filter_min_area(clipped, 100.0, F.col("m2_factor")), aois, M.SOURCES, part_features=50)
    records = dashboard_payload(clipped, aois, written=parts)
    path = fresh_path(spark, "payload")
    K.write_records(records, path)
    back = spark.read.schema(records.schema).json(path)
    return _rounded(back.select(
        "aoi", "display_name", "total", F.col("bounds_sw")[0].alias("south"), F.col("bounds_ne")[1].alias("east"),
        F.element_at(F.col("files")["google"], -1).alias("google_file"),
        F.coalesce(F.col("n_by_source")["microsoft"], F.lit(0)).alias("n_microsoft"),
        F.col("histogram")["google"][">=500"].alias("big_google"), "official_km2"), 4)


def summary_json(spark, sf):
    """Summaries written as JSON lines and read back."""
    summary, path = S.aoi_summary(world_clip(spark, sf)), fresh_path(spark, "summary")
    K.write_records(summary, path)
    return _rounded(spark.read.schema(summary.schema).json(path))


def write_clip(spark, sf):
    """A clip kept by area, one of its areas written again, and summarised."""
    path = fresh_path(spark, "clip")
    clipped = world_clip(spark, sf)
    K.write_clip(clipped, path)
    K.write_clip(clipped.where("aoi LIKE '%7'"), path)
    return _rounded(S.aoi_summary(K.read_clip(spark, path)))


def read_features(spark, sf):
    features = A.read_features(W.aoi_documents(spark, sf, broken=True))
    return features.select("slug", F.col("feature_no").cast("bigint").alias("feature_no"),
                           F.coalesce(F.size("mp"), F.lit(0)).cast("bigint").alias("n_parts"), F.col("properties")["nome"].alias("nome"))


# --- tables -----------------------------------------------------------------------------------------------------------
def _new_database(spark) -> str:
    path = fresh_path(spark, "db")
    name = "db_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


def _tables(spark, sf) -> str:
    database = _new_database(spark)
    world = W.with_country(W.footprints(spark, sf), spark, sf).select("id", "bf_source", "country_iso")
    path = fresh_path(spark, "world")
    world.write.partitionBy("country_iso").parquet(path)  # one pass over the world; each country then reads its own folder
    world = spark.read.schema(world.schema).parquet(path)
    for iso3 in W.REGION_TO_ISO3.values():
        world.where(F.col("country_iso") == iso3).write.saveAsTable(f"{database}.footprints_{iso3.lower()}")
    world_aois(spark, sf).select("slug", "display_name").write.saveAsTable(f"{database}.aoi_all")
    world_clip(spark, sf).select("aoi", "bf_source").write.saveAsTable(f"{database}.recorte_all")
    return database


def table_stats(spark, sf):
    return T.table_stats(spark, _tables(spark, sf)).select("table_name", "n_rows", "prunable")


def prune_dry_run(spark, sf):
    """The tables that a prune would drop, with their rows; nothing is dropped."""
    database = _tables(spark, sf)
    targets = T.prune_tables(spark, database)
    return T.table_stats(spark, database).where(F.col("table_name").isin(targets)).select("table_name", "n_rows")


def prune_confirmed(spark, sf):
    database = _tables(spark, sf)
    T.prune_tables(spark, database, confirm=True)
    return T.table_stats(spark, database).select("table_name", "n_rows")


def compact_counts(spark, sf):
    """A table of many small files, rewritten, holds the same rows."""
    database = _new_database(spark)
    world_clip(spark, sf).select("aoi", "bf_source").repartition(16).write.saveAsTable(f"{database}.recorte_all")
    T.compact_table(spark, database, "recorte_all", fresh_path(spark, "compacted"), cluster_by=("aoi",), confirm=True)
    return S.count_by_source(spark.table(f"{database}.recorte_all"))


def describe_table(spark, sf):
    """Columns of a kept table, each with its number of non-null values."""
    database = _tables(spark, sf)
    described = T.describe_table(spark, database, "footprints_bra")
    df = spark.table(f"{database}.footprints_bra")
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values"))
                              for c in df.columns]).alias("c")).select(F.inline("c"))
    return described.join(counts, "column_name").select("column_name", "column_type", "n_values")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    read_country_count, single_vs_merged, only_in_merged, analyze_files, read_materialised,
    list_aois, get_aoi, aoi_violations, aoi_bounds, aoi_display, ring_checks, aoi_enriched,
    filter_source, filter_min_area, filter_min_area_equatorial, footprint_area_m2, bbox_centre, simplify_vertices, simplify_slanted,
    spatial_join_pairs, spatial_join_touch, spatial_join_shuffled, spatial_join_large, shape_pairs, only_in_merged_by_shape, bbox_candidates,
    clip_area, clip_by_shape, clip_geometry,
    count_total, count_by_source, area_by_source, mean_area_by_source, distinct_sources,
    aoi_summary, aoi_summary_maps, compare_aois, density_official, share_by_source, area_histogram,
    comparison_table, built_area_gap, coverage_class, aoi_ratio,
    layers, write_layers, summary_json, write_clip, read_features, geojson_roundtrip, geoparquet_roundtrip, geoparquet_index,
    geoparquet_clip, file_pruning, sorted_geometries, typed_properties, wkb_decode, payload, payload_typed,
    table_stats, prune_dry_run, prune_confirmed, compact_counts, describe_table,
)}
QUERIES["dashboard_payload"] = QUERIES.pop("payload")
