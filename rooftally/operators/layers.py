"""Map layers: clipped footprints of one source, thinned by size and outline detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rooftally.functions import measures as M
from rooftally.functions.plan import compute_once
from rooftally.functions.simplify import simplifier


def select_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns) if columns else df


def filter_source(df: DataFrame, source: str) -> DataFrame:
    if source not in M.SOURCES:
        raise ValueError(f"source must be one of {M.SOURCES}: {source!r}")
    return df.where(F.col("bf_source") == source)


def filter_min_area(df: DataFrame, min_area_m2: float, factor=None) -> DataFrame:
    """Keep shapes of at least this size; ``factor`` is m2 per square degree, equatorial when absent.

    The size is the one before any simplification.
    """
    if not min_area_m2 > 0:
        raise ValueError(f"min_area_m2 must be positive: {min_area_m2!r}")
    return df.where(F.col("area_deg2") >= F.lit(float(min_area_m2)) / (M.m2_factor() if factor is None else factor))


def with_area(df: DataFrame, factor) -> DataFrame:
    """Add ``area_m2`` and, for display, ``area_ha``."""
    m2 = M.area_m2(F.col("area_deg2"), factor)
    return df.withColumn("area_m2", m2).withColumn("area_ha", F.col("area_m2") / 10_000)


def with_centre(df: DataFrame) -> DataFrame:
    """Add the centre of the footprint's bounding box."""
    return (df.withColumn("centre_lon", (F.col("minx") + F.col("maxx")) / 2)
            .withColumn("centre_lat", (F.col("miny") + F.col("maxy")) / 2))


def simplify(df: DataFrame, tolerance: float, geometry: str = "mp") -> DataFrame:
    reduced = df.withColumn("_simple", simplifier(tolerance)(F.col(geometry)))
    return compute_once(reduced, **{geometry: F.col("_simple")}).drop("_simple")


def layers(clip: DataFrame, min_area_m2: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Layers of all areas and both sources at once: ``aoi, bf_source, mp, area_m2``.

    ``clip`` carries its shapes (``mp``). Sizes refer to the shape before simplification.
    """
    df = clip.where(F.col("bf_source").isin(*M.SOURCES))
    if min_area_m2 is not None:
        df = filter_min_area(df, min_area_m2, F.col("m2_factor"))
    df = df.select("aoi", "bf_source", "mp", M.area_m2(F.col("area_deg2"), F.col("m2_factor")).alias("area_m2"))
    return df if tolerance is None else simplify(df, tolerance)
