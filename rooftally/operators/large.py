"""Clip of footprints that are too large for an area's tiles, in the shuffled way.

Footprints and areas are paired by their boxes. A pair with an area of ordinary size then meets the area's whole boundary, under the area's own
key. With an area of very many edges, footprint and area are both cut along the tiles of the area's finest level: what they share is the sum of what
the pieces share. Inside the area, neighbouring full tiles of a row are taken as one rectangle, of which the footprint's piece counts as it is; in
border tiles a piece meets the edges of that tile only. A pair looks up the rows of tiles that both cover, and a piece travels alone to its tile. So
no task needs more of a long boundary than the tiles that it is dealt, however large the footprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from rooftally.functions import geometry as G
from rooftally.functions.plan import compute_once
from rooftally.operators import grid
from rooftally.operators.box_join import BOX, box_pairs
from rooftally.sources.footprints import as_multipolygon
from rooftally.workspace import write_and_read

_RECT = ("rx0", "ry0", "rx1", "ry1")


def _index(tiles: DataFrame) -> DataFrame:
    """Rows of tiles without edges: per area and row of its finest level, border tiles and runs of full ones (ix to ix_end)."""
    base = tiles.where(F.col("level") == F.col("base")).select("aoi", "base", "iy", "ix", F.col("segs").isNotNull().alias("border"))
    along = Window.partitionBy("aoi", "iy", "border").orderBy("ix")
    numbered = base.withColumn("_run", F.when(~F.col("border"), F.col("ix") - F.row_number().over(along)).otherwise(F.col("ix")))
    return numbered.groupBy("aoi", "base", "iy", "border", "_run").agg(F.min("ix").alias("ix"), F.max("ix").alias("ix_end")).drop("_run")


def _pairs(large: DataFrame, areas: DataFrame) -> DataFrame:
    """Footprints and areas whose boxes meet and of which the one doesn't fit the other's tiles, with what their boxes share."""
    left = large.select("_fid", "_own", *BOX)
    right = areas.select("aoi", "base", "last", "m2_factor", *[F.col(f"a_{c}").alias(c) for c in BOX])
    return box_pairs(left, right).where("l._own > r.last").selectExpr(
        "l._fid", "r.aoi", "r.base", "r.m2_factor", "r.last = r.base AS long", "greatest(l.minx, r.minx) AS x0", "greatest(l.miny, r.miny) AS y0",
        "least(l.maxx, r.maxx) AS x1", "least(l.maxy, r.maxy) AS y1", f"{grid.tile_size('r.base')} AS s")


def _places(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(_fid, aoi, tile, border, rectangle) where a footprint and an area meet."""
    rows = pairs.selectExpr("*", "explode(sequence(bigint(ceil(y0 / s)) - 1, bigint(floor(y1 / s)))) AS iy")
    found = rows.join(index.drop("base"), ["aoi", "iy"]).where("(ix_end + 1) * s >= x0 AND ix * s <= x1")
    return found.select("_fid", "aoi", "m2_factor", "border", F.expr(grid.tile_key("base", "ix", "iy")).alias("tile"),
                        *[F.expr(e).alias(n) for e, n in zip(("ix * s", "iy * s", "(ix_end + 1) * s", "(iy + 1) * s"), _RECT)])


def _pieces(places: DataFrame, large: DataFrame, geometry: str) -> DataFrame:
    """The part of each footprint in each rectangle, with its own box and area; empty ones are left out."""
    joined = places.join(large.select("_fid", geometry), "_fid")
    shaped = joined.withColumn("_mp", as_multipolygon(joined, geometry)).drop(geometry)
    sides = """array(named_struct('x1', rx0, 'y1', ry1, 'x2', rx1, 'y2', ry1, 'w', 1D), named_struct('x1', rx0, 'y1', ry0, 'x2', rx1, 'y2', ry0, 'w', -1D))"""
    cut = compute_once(shaped, _edges=F.expr(G.with_weight(G.edges("_mp"))), _sides=F.expr(sides)).drop("_mp")
    cut = compute_once(cut, **{geometry: F.expr(G.overlap_geometry("_edges", "_sides", "rx0", "rx1"))}).drop("_edges", "_sides", *_RECT)
    points = compute_once(cut.where(F.size(geometry) > 0), _x=F.expr(f"transform({G.points(geometry)}, p -> p[0])"),
                          _y=F.expr(f"transform({G.points(geometry)}, p -> p[1])"))
    return compute_once(points, minx=F.array_min("_x"), miny=F.array_min("_y"), maxx=F.array_max("_x"), maxy=F.array_max("_y"),
                        area_deg2=F.expr(G.polygon_area(geometry))).drop("_x", "_y")


def clip_large(footprints: DataFrame, tiles: DataFrame, areas: DataFrame, largest_fitting: int, keep: tuple[str, ...], geometry: str,
               with_geometry: bool, overlaps: Callable[..., DataFrame], any_long: bool) -> DataFrame:
    """The clip of the footprints whose level is beyond ``largest_fitting`` with the areas whose tiles they don't fit.

    ``overlaps`` is the clip of shapes beside their tiles; the result has the same columns. ``any_long`` tells whether there are areas to cut.
    """
    leveled = compute_once(footprints, _own=F.expr(grid.footprint_level("greatest(maxx - minx, maxy - miny)")))
    large = write_and_read(leveled.where(F.col("_own") > largest_fitting).withColumn("_fid", F.monotonically_increasing_id()), "large")
    pairs = write_and_read(_pairs(large, areas), "large-pairs")
    edges = [F.col("segs").alias("_segs"), F.col("lids").alias("_lids")]
    tops = tiles.where((F.col("level") == grid.TOP) & (F.col("last") > F.col("base"))).select("aoi", *edges)
    columns = [c for c in footprints.columns if c != geometry] + [geometry]
    whole = pairs.where("NOT long").select("_fid", "aoi", "m2_factor").join(large.select("_fid", *columns), "_fid").join(tops.hint("merge"), "aoi")
    found = overlaps(whole.drop("_fid"), keep, columns, geometry, with_geometry)
    if not any_long:
        return found
    places = write_and_read(_places(pairs.where("long"), write_and_read(_index(tiles.where("last = base")), "tile-index")), "places")
    pieces = write_and_read(_pieces(places, large, geometry), "pieces")
    none = [F.lit(None).cast(tiles.schema[c].dataType).alias(f"_{c}") for c in ("segs", "lids")]
    border = tiles.where("level = base AND last = base").select("aoi", "tile", *edges)
    beside = pieces.where("NOT border").select("*", *none).unionByName(pieces.where("border").join(border.hint("merge"), ["aoi", "tile"]))
    parts = overlaps(beside.drop("border", "tile"), ("_fid",), ["_fid", *BOX, "area_deg2", geometry], geometry, with_geometry)
    sums = [F.sum("area_deg2").alias("_shared"), F.max("m2_factor").alias("m2_factor"), F.bool_or("cut").alias("cut")]
    if with_geometry:
        sums.append(F.flatten(F.collect_list("mp")).alias("mp"))
    summed = parts.groupBy("_fid", "aoi").agg(*sums)
    back = summed.join(large.select("_fid", *dict.fromkeys((*keep, "area_deg2"))), "_fid").withColumn("area_deg2", F.least("area_deg2", "_shared"))
    return found.unionByName(back.select("aoi", *keep, "area_deg2", "m2_factor", "cut", *(["mp"] if with_geometry else [])))
