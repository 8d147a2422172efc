"""Counts, areas, shares and comparisons over clipped footprints.

A clip has one row per footprint and area: ``aoi, bf_source, area_deg2, m2_factor``. Everything here is one
aggregation on short keys with map-side combining, so a source or an area that holds most rows costs no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rooftally.functions import measures as M
from rooftally.workspace import write_and_read

SOURCE = "bf_source"


# --- one table -----------------------------------------------------------------------------------------------
def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def count_by_source(df: DataFrame, source: str = SOURCE) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source)


def area_by_source(df: DataFrame, latitude: float | None = None, source: str = SOURCE) -> DataFrame:
    area = F.coalesce(F.sum("area_deg2"), F.lit(0.0)) * M.m2_factor(latitude)
    return df.groupBy(source).agg(area.alias("area_m2")).orderBy(F.desc("area_m2"), source)


def mean_area_by_source(df: DataFrame, latitude: float | None = None, source: str = SOURCE) -> DataFrame:
    area = F.coalesce(F.sum("area_deg2"), F.lit(0.0)) * M.m2_factor(latitude)
    return (df.groupBy(source).agg(F.count("*").alias("n"), area.alias("area_m2"))
            .withColumn("mean_m2", M.mean_area(F.col("area_m2"), F.col("n"))))


def distinct_sources(df: DataFrame, source: str = SOURCE) -> DataFrame:
    return df.select(source).distinct().orderBy(source)


# --- per area of interest ------------------------------------------------------------------------------------
def aoi_summary(clip: DataFrame) -> DataFrame:
    """Count, area and mean area per area and source, from a single pass."""
    per_source = clip.groupBy("aoi", SOURCE).agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum("area_deg2"), F.lit(0.0)) * F.max("m2_factor")).alias("area_m2"))
    return per_source.withColumn("mean_m2", M.mean_area(F.col("area_m2"), F.col("n")))


def summary_maps(summary: DataFrame, aois: DataFrame | None = None) -> DataFrame:
    """One record per area with maps by source; with ``aois``, areas without footprints are kept."""
    name = F.coalesce(F.col(SOURCE), F.lit("None"))  # a map key cannot be NULL
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), name.alias("s"), "n", "area_m2",
                                                   "mean_m2")))
    grouped = summary.groupBy("aoi").agg(F.sum("n").alias("total"), entries.alias("_e"))
    if aois is not None:
        grouped = aois.select(F.col("slug").alias("aoi"), "display_name").join(grouped, "aoi", "left")

    def by_source(field, kind):
        pairs = F.transform("_e", lambda e: F.struct(e.s.alias("key"), e[field].alias("value")))
        return F.coalesce(F.map_from_entries(pairs), F.create_map().cast(f"map<string,{kind}>"))

    kept = [c for c in grouped.columns if c not in ("total", "_e")]
    return grouped.select(
        *kept, F.coalesce("total", F.lit(0)).alias("total"),
        by_source("n", "bigint").alias("n_by_source"),
        by_source("area_m2", "double").alias("area_m2_by_source"),
        by_source("mean_m2", "double").alias("mean_m2_by_source"))


def compare_aois(clip: DataFrame, aois: DataFrame | None = None) -> DataFrame:
    """One row per area with count, area and mean per source side by side, and both densities.

    ``density_bbox`` divides by the bounding box, ``density_official`` by the official size where there is one.
    Every area of ``aois`` has a row, with zeros if it has no footprints. Without a row in ``aois`` an area has no density.
    """
    figures = [F.count("*").alias("total"), F.max("m2_factor").alias("_f")]
    for s in M.SOURCES:
        is_s = F.col(SOURCE) == s
        figures += [F.count_if(is_s).alias(f"n_{s}"), F.sum(F.when(is_s, F.col("area_deg2"))).alias(f"_a_{s}")]
    wide = clip.groupBy("aoi").agg(*figures)
    for s in M.SOURCES:
        wide = (wide.withColumn(f"area_m2_{s}", F.coalesce(F.col(f"_a_{s}") * F.col("_f"), F.lit(0.0)))
                .withColumn(f"mean_m2_{s}", M.mean_area(F.col(f"area_m2_{s}"), F.col(f"n_{s}")))
                .drop(f"_a_{s}"))
    wide = wide.drop("_f")
    if aois is None:
        return wide
    box = ("minx", "miny", "maxx", "maxy")
    sizes = aois.select(
        F.col("slug").alias("aoi"), "display_name",
        M.bbox_area_km2(*[F.col(c) for c in box]).alias("bbox_km2"),
        M.official_or_bbox_km2(F.col("properties"), *[F.col(c) for c in box]).alias("official_km2"))
    figures = [c for c in wide.columns if c != "aoi"]
    # an area without footprints has zeros
    both = wide.join(sizes, "aoi", "full_outer").fillna(0, figures)
    return (both.withColumn("density_bbox", F.when(F.col("bbox_km2").isNotNull(),
                                                   M.density(F.col("total"), F.col("bbox_km2"))))
            .withColumn("density_official", F.when(F.col("official_km2").isNotNull(),
                                                   M.density(F.col("total"), F.col("official_km2")))))


def share_by_source(summary: DataFrame) -> DataFrame:
    """Percentage of an area's footprints by source (the window runs over aggregated rows only)."""
    total = F.sum("n").over(Window.partitionBy("aoi"))
    return summary.select("aoi", SOURCE, "n", M.share(F.col("n"), total).alias("pct"))


def source_comparison(wide: DataFrame) -> DataFrame:
    """Built area, difference of the mean sizes, and the coverage label, per area."""
    google, microsoft = M.SOURCES
    gap = F.col(f"mean_m2_{google}") - F.col(f"mean_m2_{microsoft}")
    pct = M.share(F.col(f"n_{google}"), F.col("total"))
    return wide.select(
        "aoi", (F.col(f"area_m2_{google}") + F.col(f"area_m2_{microsoft}")).alias("built_m2"),
        F.abs(gap).alias("gap_m2"), (gap > 0).alias("google_larger"), pct.alias("google_pct"),
        M.coverage_class(pct).alias("coverage"))


def comparison_table(wide: DataFrame) -> DataFrame:
    """The side-by-side table: totals, sources, official size and density, by area."""
    return wide.select("aoi", "total", *[f"n_{s}" for s in M.SOURCES], "official_km2", "density_bbox",
                       "density_official").orderBy("aoi")


def aoi_ratio(wide: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many times more buildings, built area and density ``aoi_a`` has than ``aoi_b``, for the given pairs."""
    def side(suffix):
        built = sum((F.col(f"area_m2_{s}") for s in M.SOURCES), F.lit(0.0))
        return wide.select(F.col("aoi").alias(f"aoi_{suffix}"), F.col("total").alias(f"n_{suffix}"),
                           built.alias(f"built_{suffix}"), F.col("official_km2").alias(f"km2_{suffix}"),
                           F.col("density_official").alias(f"density_{suffix}"))

    wide = write_and_read(wide, "compared")  # a row for each area, which both sides read; the clip behind it runs once
    joined = pairs.join(side("a"), "aoi_a").join(side("b"), "aoi_b")
    return joined.select("aoi_a", "aoi_b", *[
        F.try_divide(F.col(f"{c}_a"), F.col(f"{c}_b")).alias(f"{c}_ratio") for c in ("n", "built", "km2", "density")])


def area_histogram(clip: DataFrame, aois: DataFrame | None = None) -> DataFrame:
    """Footprints per area, source and size class; every combination is there, zeros included.

    The classes are counted as columns of one aggregation and then unfolded, so no join fills the gaps. Other
    sources are left out.
    """
    bucket = M.area_bucket(F.col("area_deg2") * F.col("m2_factor"))
    cells = [(s, b) for s in M.SOURCES for b in M.AREA_BUCKETS]
    classed = clip.select("aoi", SOURCE, bucket.alias("_b"))
    counted = classed.groupBy("aoi").agg(*[
        F.count_if((F.col(SOURCE) == s) & (F.col("_b") == b)).alias(f"_{i}") for i, (s, b) in enumerate(cells)])
    if aois is not None:
        counted = aois.select(F.col("slug").alias("aoi")).join(counted, "aoi", "left")
    rows = F.array(*[
        F.struct(F.lit(s).alias(SOURCE), F.lit(b).alias("bucket"), F.coalesce(f"_{i}", F.lit(0)).alias("n"))
        for i, (s, b) in enumerate(cells)])
    return counted.select("aoi", F.inline(rows))


def counted_once(clip: DataFrame) -> DataFrame:
    """Summary and size classes in one pass over a clip: ``aoi_summary`` with a map ``buckets`` of the counts by class, zeros included."""
    bucket = M.area_bucket(F.col("area_deg2") * F.col("m2_factor"))
    classed = clip.select("aoi", SOURCE, "area_deg2", "m2_factor", bucket.alias("_b"))
    per_source = classed.groupBy("aoi", SOURCE).agg(
        F.count("*").alias("n"), (F.coalesce(F.sum("area_deg2"), F.lit(0.0)) * F.max("m2_factor")).alias("area_m2"),
        *[F.count_if(F.col("_b") == b).alias(f"_{i}") for i, b in enumerate(M.AREA_BUCKETS)])
    buckets = F.create_map(*[v for i, b in enumerate(M.AREA_BUCKETS) for v in (F.lit(b), F.col(f"_{i}"))])
    return per_source.select("aoi", SOURCE, "n", "area_m2", M.mean_area(F.col("area_m2"), F.col("n")).alias("mean_m2"), buckets.alias("buckets"))


def source_coverage(merged: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """Footprints with and without the second source per ``key``, and what the merge adds."""
    def counted(df, name):
        return df.groupBy(key).agg(F.count("*").alias(name))

    both = counted(merged, "n_merged").join(counted(single, "n_single"), key, "full_outer")
    n_merged, n_single = (F.coalesce(c, F.lit(0)) for c in ("n_merged", "n_single"))
    return both.select(key, n_merged.alias("n_merged"), n_single.alias("n_single"),
                       (n_merged - n_single).alias("added"))


def only_in_first(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    return first.join(second, on, "left_anti")
