"""Sinks: GeoJSON, spatially ordered Parquet, clip tables, documents of areas, JSON records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rooftally.functions.geometry import MULTIPOLYGON
from rooftally.functions.plan import compute_once, row_hash
from rooftally.functions.wkb import multipolygon_to_wkb
from rooftally.operators.grid import z_order
from rooftally.sources.documents import write_documents
from rooftally.sources.footprints import as_multipolygon, prepare_footprints
from rooftally.workspace import write_and_read

PART_FEATURES = 50_000
# Folders of a kept clip; fixed, as a block's number is part of its path.
CLIP_BLOCKS, BLOCK = 256, "_block"

_POLYGON = "array<array<array<double>>>"


def gathered(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bring the rows of a partition value together before writing, so that it gets few files, not one per task.

    Adaptive execution cuts a value that holds most rows into several tasks and merges small ones.
    """
    return df.hint("rebalance", *keys) if keys else df


def geojson_geometry(mp: Column) -> Column:
    """GeoJSON text of a MultiPolygon; one part is written as Polygon."""
    single = F.size(mp) == 1
    return F.format_string('{"type":"%s","coordinates":%s}',
                           F.when(single, "Polygon").otherwise("MultiPolygon"),
                           F.when(single, F.to_json(mp[0])).otherwise(F.to_json(mp)))


def geojson_features(df: DataFrame, geometry: str = "mp", columns: list[str] | None = None,
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON feature per row; ``columns`` (default all others) become its properties."""
    props = [c for c in (columns if columns else df.columns) if c not in (geometry, *keys)]
    df = df.withColumn(geometry, as_multipolygon(df, geometry))
    properties = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    shape = F.coalesce(geojson_geometry(F.col(geometry)), F.lit("null"))
    return df.select(*keys, F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', properties, shape)
                     .alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: str = "mp", columns: list[str] | None = None,
                  partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """Write features, one per line, split by ``partition_by``."""
    features = gathered(geojson_features(df, geometry, columns, partition_by), partition_by)
    features.write.mode(mode).partitionBy(*partition_by).text(path)
    return path


def layer_parts(layers: DataFrame, aois: DataFrame, sources: tuple[str, ...], part_features: int = PART_FEATURES) -> DataFrame:
    """Parts and features of each layer, zero features included: aoi, bf_source, parts, n."""
    sized = layers.groupBy("aoi", "bf_source").agg(F.count("*").alias("n"))
    every = aois.select(F.col("slug").alias("aoi"), F.explode(F.array(*map(F.lit, sources))).alias("bf_source"))
    n = F.coalesce("n", F.lit(0))
    return every.join(sized, ["aoi", "bf_source"], "left").select(
        "aoi", "bf_source", F.greatest(F.lit(1), F.ceil(n / part_features)).cast("int").alias("parts"), n.alias("n"))


def write_layers(layers: DataFrame, aois: DataFrame, path: str, sources: tuple[str, ...], geometry: str = "mp",
                 part_features: int = PART_FEATURES, mode: str = "overwrite") -> DataFrame:
    """Write one FeatureCollection document per area, source and part, also where there is no feature.

    A layer has one part per ``part_features`` features, chosen by content; a part is one file, written line by line by
    one task, and a document by itself. Returns the list of what was written: aoi, bf_source, parts, n.
    """
    keys = ["aoi", "bf_source"]
    features = write_and_read(geojson_features(layers, geometry, keys=tuple(keys)), "features")
    frame = write_and_read(layer_parts(features, aois, sources, part_features), "layers")
    parts = frame.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = parts.select(*keys, "part", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit('{"type":"FeatureCollection","features":[').alias("value")),
        F.struct(F.lit(2).alias("kind"), F.lit("]}").alias("value")))))
    placed = features.join(frame.select(*keys, "parts"), keys).select(
        *keys, F.pmod(F.xxhash64("value"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "value")
    inside = Window.partitionBy(*keys, "part").orderBy("kind", "value")
    lines = ends.unionByName(placed).withColumn("_n", F.row_number().over(inside)).withColumn(
        "value", F.when((F.col("kind") == 1) & (F.col("_n") > 2), F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    # the window leaves each document together and in order; the writer needs no other
    write_documents(lines, path, mode)
    return frame


def read_geojson(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """Features written by ``write_geojson``, or by ``write_layers`` (``documents``): partition columns, properties, geometry."""
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    line = f"struct<type:string,features:array<{feature}>,{feature[7:-1].replace('type:string,', '', 1)}>"
    lines = spark.read.text(path, wholetext=documents)
    keys = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*keys, F.from_json("value", line).alias("_l"))
    alone = F.array(F.struct(F.lit("Feature").alias("type"), F.col("_l.properties").alias("properties"),
                             F.col("_l.geometry").alias("geometry")))
    rows = parsed.select(*keys, F.explode(F.coalesce("_l.features", alone)).alias("_f"))
    shape = F.col("_f.geometry")
    mp = (F.when(shape["type"] == "Polygon", F.array(F.from_json(shape["coordinates"], _POLYGON)))
          .otherwise(F.from_json(shape["coordinates"], MULTIPOLYGON)))
    return rows.select(*keys, F.col("_f.properties").alias("properties"), mp.alias("mp"))


def write_geoparquet(df: DataFrame, path: str, geometry: str = "mp", partition_by: tuple[str, ...] = (),
                     files: int | None = None, mode: str = "overwrite") -> str:
    """WKB with bounding box and area, in map order: neighbours share files and row groups.

    Range partitioning splits a partition value, or a spot, that holds most rows over many files; only exact
    copies stay together (their task sorts with spilling).
    """
    measured = prepare_footprints(df, geometry)
    if dict(measured.dtypes)[geometry] != "binary":
        measured = measured.withColumn(geometry, multipolygon_to_wkb(F.col(geometry)))
    ordered = compute_once(measured, _z=F.expr(z_order("minx", "miny")), _tie=row_hash(measured))
    keys = [*partition_by, "_z", "_tie"]
    ranged = ordered.repartitionByRange(files, *keys) if files else ordered.repartitionByRange(*keys)
    (ranged.sortWithinPartitions(*keys).drop("_z", "_tie").withColumnRenamed(geometry, "geometry")
     .write.mode(mode).partitionBy(*partition_by).parquet(path))
    return path


def keep_table(clip: DataFrame, table: str) -> str:
    """Keep a clip as a table, by area: the rows of an area lie together, so a read of some areas skips row groups.

    The number of files follows the bytes; a folder and a file for each area and task would cost more than the rows.
    """
    gathered(clip, ("aoi",)).sortWithinPartitions("aoi").write.saveAsTable(table)
    return table


def _block() -> Column:
    return F.pmod(F.xxhash64("aoi"), F.lit(CLIP_BLOCKS)).cast("int")


def write_clip(clip: DataFrame, path: str) -> str:
    """Keep a clip, by area; writing again replaces only the areas at hand. One writer at a time.

    Areas are dealt to at most ``CLIP_BLOCKS`` folders, as a folder for each would cost more than its rows. A block that gets areas again is written
    anew with its other areas, which are first copied to the shared folder: a crash while folders are exchanged loses none. ``read_clip`` reads them.
    """
    spark = clip.sparkSession
    rows = clip.withColumn(BLOCK, _block())
    try:
        there = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        rows = write_and_read(rows, "clip")
        areas = rows.select(BLOCK, "aoi").distinct()
        others = there.join(F.broadcast(areas.select(BLOCK).distinct()), BLOCK, "left_semi").join(areas, "aoi", "left_anti")
        rows = rows.unionByName(write_and_read(others, "clip-others"), allowMissingColumns=True)
    (gathered(rows, (BLOCK,)).sortWithinPartitions(BLOCK, "aoi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BLOCK).parquet(path))
    return path


def read_clip(spark: SparkSession, path: str, *areas: str) -> DataFrame:
    """A clip that ``write_clip`` keeps, or some of its areas: only their blocks are read."""
    rows = spark.read.parquet(path)
    if areas:
        blocks = spark.createDataFrame([(a,) for a in areas], "aoi string").select(_block()).distinct().collect()
        rows = rows.where(F.col(BLOCK).isin([r[0] for r in blocks]) & F.col("aoi").isin(*areas))
    return rows.drop(BLOCK)


def write_aois(aois: DataFrame, path: str, overwrite: bool = False) -> str:
    """One FeatureCollection per line, named by its slug; refuses to replace unless asked."""
    feature = F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', F.to_json("properties"),
                              geojson_geometry(F.col("mp")))
    document = F.format_string('{"type":"FeatureCollection","name":%s,"features":[%s]}',
                               F.concat(F.lit('"'), F.col("slug"), F.lit('"')), feature)
    aois.select(document.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
    return path


def write_records(df: DataFrame, path: str) -> str:
    """Summaries or dashboard records as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path
