"""Scalar measures over footprints and areas of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Flat-earth degree length, source names, size classes, share thresholds.
KM_PER_DEGREE = 111.0
M2_PER_DEG2 = 111_000.0 * 111_000.0
SOURCES = ("google", "microsoft")
AREA_BUCKETS = ("<50", "50-100", "100-200", "200-500", ">=500")
AREA_BUCKET_EDGES = (50.0, 100.0, 200.0, 500.0)
DOMINANT_SHARE = 90.0
SIGNIFICANT_SHARE = 70.0


def mean_latitude(miny: Column, maxy: Column) -> Column:
    return (miny + maxy) / 2


def m2_factor(latitude: Column | float | None = None) -> Column:
    """Square metres per square degree; without a latitude the equatorial value."""
    if latitude is None:
        return F.lit(M2_PER_DEG2)
    if isinstance(latitude, Column):
        return F.lit(M2_PER_DEG2) * F.cos(F.radians(latitude))
    return F.lit(M2_PER_DEG2 * math.cos(math.radians(latitude)))


def area_m2(area_deg2: Column, factor: Column) -> Column:
    return F.round(area_deg2 * factor, 2)


def bbox_area_km2(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    height = (maxy - miny) * F.lit(KM_PER_DEGREE)
    width = (maxx - minx) * F.lit(KM_PER_DEGREE) * F.cos(F.radians(mean_latitude(miny, maxy)))
    return F.abs(height * width)


def official_or_bbox_km2(properties: Column, minx, miny, maxx, maxy) -> Column:
    return F.coalesce(properties["area_km2_oficial"].try_cast("double"), bbox_area_km2(minx, miny, maxx, maxy))


def density(total: Column, km2: Column) -> Column:
    return F.when(km2 > 0, total / km2).otherwise(F.lit(0.0))


def share(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * n / total).otherwise(F.lit(0.0))


def mean_area(total_m2: Column, n: Column) -> Column:
    return F.when(n > 0, total_m2 / n).otherwise(F.lit(0.0))


def area_bucket(m2: Column) -> Column:
    """Size class of a footprint; an unknown area lands in the open-ended class."""
    bucket = None
    for label, upper in zip(AREA_BUCKETS, AREA_BUCKET_EDGES):
        bucket = F.when(m2 < upper, label) if bucket is None else bucket.when(m2 < upper, label)
    return bucket.otherwise(AREA_BUCKETS[-1])


def coverage_class(google_share: Column) -> Column:
    return (F.when(google_share >= DOMINANT_SHARE, "google dominates")
            .when(google_share >= SIGNIFICANT_SHARE, "significant microsoft")
            .otherwise("prominent microsoft"))


def display_name(properties: Column, slug: Column) -> Column:
    """``name/state``, or the name alone, or the slug; an empty state counts as absent."""
    state = F.when(properties["uf"] != "", properties["uf"])
    return F.concat_ws("/", F.coalesce(properties["nome"], slug), state)
