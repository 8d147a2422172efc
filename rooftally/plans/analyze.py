"""The flagship analysis: areas and a country in, figures per area and source out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rooftally.operators.spatial_join import clip, tile_aois
from rooftally.operators.summary import aoi_summary
from rooftally.sources.aois import read_aois
from rooftally.sources.footprints import read_country


def analyze(footprints: DataFrame, aoi_documents: DataFrame) -> DataFrame:
    """Summary per area and source of the footprints clipped to the given areas."""
    return aoi_summary(clip(footprints, tile_aois(read_aois(aoi_documents))))


def analyze_country(spark: SparkSession, base: str, country_iso: str, aoi_documents: DataFrame) -> DataFrame:
    return analyze(read_country(spark, base, country_iso), aoi_documents)
