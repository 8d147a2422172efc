"""Readers: footprints from partitioned Parquet, areas of interest from GeoJSON."""
