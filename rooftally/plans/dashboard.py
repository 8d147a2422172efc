"""The dashboard record: everything a comparison page needs to know about each area."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rooftally.functions import measures as M
from rooftally.operators.summary import counted_once, summary_maps
from rooftally.workspace import write_and_read


def dashboard_payload(clip: DataFrame, aois: DataFrame, layers_path: str = "data", written: DataFrame | None = None,
                      typed: DataFrame | None = None) -> DataFrame:
    """One nested record per area; no areas is an error.

    ``files`` lists the folders of each source's layer, one per part; ``written`` is what
    ``write_layers`` returned. ``typed`` has the properties (slug, properties) with values of their own types; without it they are texts.
    """
    if not aois.take(1):
        raise ValueError("give at least one area of interest")
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    counted = write_and_read(counted_once(clip), "counted")  # a row for each area and source; the clip is read once
    summary = summary_maps(counted.drop("buckets"), aois)
    # always the same ten entries per area
    none = F.create_map(*[v for b in M.AREA_BUCKETS for v in (F.lit(b), F.lit(0).cast("long"))])
    known = counted.where(F.col("bf_source").isin(*M.SOURCES)).groupBy("aoi").agg(
        F.map_from_entries(F.collect_list(F.struct("bf_source", "buckets"))).alias("_known"))
    filled = F.create_map(*[v for s in M.SOURCES for v in (F.lit(s), F.coalesce(F.col("_known")[s], none))])
    histogram = aois.select(F.col("slug").alias("aoi")).join(known, "aoi", "left").select("aoi", filled.alias("histogram"))

    def parts(source):
        numbers = F.sequence(F.lit(0), F.coalesce(F.col("_parts")[source], F.lit(1)) - 1)
        return F.transform(numbers, lambda k: F.concat(F.lit(f"{layers_path}/aoi="), "slug", F.lit(f"/bf_source={source}/part="), k))

    if written is not None:
        per_area = written.groupBy(F.col("aoi").alias("slug")).agg(
            F.map_from_entries(F.collect_list(F.struct("bf_source", "parts"))).alias("_parts"))
        aois = aois.join(per_area, "slug", "left")
    else:
        aois = aois.withColumn("_parts", F.create_map().cast("map<string,int>"))
    if typed is not None:
        aois = aois.drop("properties").join(typed.select("slug", F.col("properties").alias("_typed")), "slug", "left")
        official = F.coalesce(F.expr("try_variant_get(_typed['area_km2_oficial'], '$', 'double')"), M.bbox_area_km2(*box))
        aois = aois.withColumn("properties", F.col("_typed"))
    else:
        official = M.official_or_bbox_km2(F.col("properties"), *box)
    files = F.create_map(*[v for s in M.SOURCES for v in (F.lit(s), parts(s))])
    described = aois.select(
        F.col("slug").alias("aoi"), "properties", F.array("miny", "minx").alias("bounds_sw"),
        F.array("maxy", "maxx").alias("bounds_ne"), files.alias("files"),
        official.alias("official_km2"))
    return described.join(summary, "aoi").join(histogram, "aoi")
