"""Footprint sources: partitioned GeoParquet and tables kept from an earlier run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rooftally.functions.plan import compute_once
from rooftally.functions.wkb import multipolygon_stats, wkb_stats, wkb_to_multipolygon

# The dataset's folder names, and country codes by convention of the two datasets.
LAYOUTS = ("by_country", "by_country_s2")
# Other countries' codes are given by the caller.
ISO3_TO_ISO2 = {"BRA": "BR", "LSO": "LS", "AUS": "AU", "IND": "IN", "PRT": "PT", "EGY": "EG"}

PREPARED = ("minx", "miny", "maxx", "maxy", "area_deg2")
COVERING = ("xmin", "ymin", "xmax", "ymax")


def read_country(spark: SparkSession, base: str, country_iso: str, layout: str = "by_country_s2") -> DataFrame:
    """Merged-source footprints of one country; the country filter prunes partitions."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}: {layout!r}")
    if not re.fullmatch(r"[A-Z]{3}", country_iso):
        raise ValueError(f"country code must be three capital letters: {country_iso!r}")
    return spark.read.parquet(f"{base.rstrip('/')}/{layout}").where(F.col("country_iso") == country_iso)


def read_country_single_source(spark: SparkSession, base: str, *country_iso2: str) -> DataFrame:
    """Footprints of some countries from the single-source dataset, which is keyed by two-letter codes; one scan."""
    bad = [c for c in country_iso2 if not re.fullmatch(r"[A-Z]{2}", c)]
    if bad or not country_iso2:
        raise ValueError(f"country codes must be two capital letters: {bad!r}")
    df = spark.read.parquet(base).where(F.col("country_iso").isin(*country_iso2))
    return df if "bf_source" in df.columns else df.withColumn("bf_source", F.lit("google"))


def iso3_of(iso2, codes: dict[str, str] = ISO3_TO_ISO2):
    """Three-letter code of a two-letter code column, so that both datasets can be joined; unknown codes stay as they are."""
    pairs = [F.lit(v) for iso3, two in codes.items() for v in (two, iso3)]
    return F.coalesce(F.create_map(*pairs)[iso2], iso2)


def read_materialised(spark: SparkSession, table: str) -> DataFrame:
    """A table kept by an earlier run, instead of reading the country again."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table!r} does not exist; load and clip first")
    return spark.table(table)


def prepare_footprints(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add bounding box and planar area where the table does not have them yet.

    Both forms of geometry are measured once, in whole Arrow batches; on nested arrays that takes a quarter of the time
    of higher-order functions, which are interpreted. A struct column ``bbox`` (xmin, ymin, xmax, ymax), as files
    with a covering have it, is used as the box: filters on it then reach the scan, before anything is measured.
    """
    if set(PREPARED) <= set(df.columns):
        return df
    stats = wkb_stats if dict(df.dtypes)[geometry] == "binary" else multipolygon_stats
    kept = [c for c in df.columns if c not in PREPARED]
    if _has_covering(df):
        boxed = df.select(*kept, *[F.col("bbox")[c].cast("double").alias(n) for c, n in zip(COVERING, PREPARED)])
        if dict(df.dtypes).get("area_deg2") == "double":  # measured when it was written
            return df.select(*kept, *[F.col("bbox")[c].cast("double").alias(n) for c, n in zip(COVERING, PREPARED)], "area_deg2")
        return boxed.withColumn("area_deg2", stats(F.col(geometry))["area_deg2"])
    # through a generator: a filter on one measure may not bring a second run of the measuring
    measured = compute_once(df.select(*kept), _stats=stats(F.col(geometry)))
    return measured.select(*kept, *[F.col("_stats")[c].alias(c) for c in PREPARED])


def _has_covering(df: DataFrame) -> bool:
    kind = df.schema["bbox"].dataType if "bbox" in df.columns else None
    return isinstance(kind, T.StructType) and set(COVERING) <= set(kind.names)


def as_multipolygon(df: DataFrame, geometry: str = "geometry"):
    """The geometry column as nested arrays, decoding WKB when needed."""
    column = F.col(geometry)
    return wkb_to_multipolygon(column) if dict(df.dtypes)[geometry] == "binary" else column
