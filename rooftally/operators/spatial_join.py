"""Intersection join and clip of footprints with areas of interest.

``tile_aois`` cuts the areas into grid tiles, as ordinary explodes and aggregates: a tile is *full* (no boundary
near it, everything in it is inside), *border* (it keeps the boundary edges that touch it) or absent. The join is
then an equality on the tile number. Footprints in full tiles are inside as they are; only those in border tiles
are compared edge by edge, with the original coordinates.

The tile table is broadcast when it is measured to be small. Otherwise both sides are shuffled by tile, and tiles
that hold many footprints are salted; footprints too large for an area's tiles are cut along them (``operators.large``), so no
row and no key holds more of a boundary than a tile does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rooftally.functions import geometry as G
from rooftally.functions import measures as M
from rooftally.functions.plan import compute_once, row_hash
from rooftally.operators import grid
from rooftally.operators.box_join import BOX, meeting_any
from rooftally.operators.large import clip_large
from rooftally.sources.footprints import as_multipolygon, prepare_footprints
from rooftally.workspace import fresh_path, write_and_read

# Both label the same system; coordinates are never transformed.
SAME_SYSTEM = ("EPSG:4326", "OGC:CRS84")

# What every tile knows about its area.
ABOUT = ("base", "last", "m2_factor", "minx", "miny", "maxx", "maxy")
CHUNK = 1024  # ring vertices handled per row while tiling
BROADCAST_BYTES = 128 << 20
STRIPS = 16  # the areas' boxes are merged to so many literal ranges
CELL = 4  # level of the cells (1 degree) by which footprints far from all areas are left out before they are shuffled
HOT_TILES = 10_000  # at most so many tiles are salted: those holding more than 1/HOT_TILES of all rows


@dataclass(frozen=True)
class AoiTiles:
    """Tiled areas with the figures that decide how to join them."""

    tiles: DataFrame
    n_aois: int
    n_bytes: int
    kinds: tuple[tuple[int, int], ...]  # finest and coarsest level of the areas, as far as they differ
    n_long: int  # areas with a boundary too long for one row
    bounds: tuple[float, float, float, float] | None
    boxes: tuple[tuple[float, float, float, float], ...]


def check_crs(*labels: str) -> None:
    """Labels of the same system may be mixed; anything else would need a transformation."""
    other = [label for label in labels if label not in SAME_SYSTEM]
    if other:
        raise ValueError(f"coordinates must be WGS84 ({' or '.join(SAME_SYSTEM)}), not {', '.join(other)}")


# --- areas of interest to tiles ----------------------------------------------------------------------------
def _described(aois: DataFrame) -> DataFrame:
    """Areas with their levels and the factor of their latitude."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    many = F.aggregate(F.flatten("mp"), F.lit(0), lambda n, ring: n + F.size(ring)) > grid.MANY_EDGES
    sized = compute_once(aois, _extent=extent, _many=F.coalesce(many, F.lit(False)))
    leveled = compute_once(sized, base=F.expr(f"if(_many, {grid.area_level('_extent', grid.TILES_OF_MANY)}, {grid.area_level('_extent')})"),
                           m2_factor=M.m2_factor(M.mean_latitude(F.col("miny"), F.col("maxy"))))
    return leveled.withColumn("last", F.col("base") + F.when(F.col("_many"), 0).otherwise(grid.COARSER)).drop("_extent", "_many")


def _aoi_edges(aois: DataFrame) -> DataFrame:
    """One row per boundary edge, with its area's attributes; long rings are spread over the cluster."""
    rings = (
        _described(aois).select("aoi", *ABOUT, F.posexplode("mp").alias("polygon_no", "polygon"))
        .select("aoi", *ABOUT, "polygon_no", F.posexplode("polygon").alias("ring_no", "ring"))
        .where(F.size("ring") >= 2)
    )
    chunks = (
        compute_once(rings, side=F.expr(G.ring_side("ring", "ring_no"))).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("ring") - 2, F.lit(CHUNK))))
        .withColumn("ring", F.slice("ring", F.col("start") + 1, CHUNK + 1))
        .repartition(int(aois.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                     "aoi", "polygon_no", "ring_no", "start")
    )
    return chunks.select("aoi", *ABOUT, F.explode(F.expr(G.ring_edges("ring", "side"))).alias("e"))


def _tile_rows(edges: DataFrame) -> DataFrame:
    """Per tile: the edges that touch it, and the steps of the inside/outside state along its upper rim.

    An edge that passes above a tile matters to it only by where it starts and ends: a shape in the tile sees a
    lid over that stretch. Each edge leaves one start and one end per tile column; those of neighbouring edges cancel in the
    sum, mostly before the shuffle, and a running sum down the column gives the lids of its tiles.
    """
    top = f"level = {grid.TOP}"
    reach = 1 + grid.OVERHANG
    slack = "1e-9D"  # in tiles; only ever adds an edge to a tile it nearly touches

    def first_tile(v):
        return f"ceil({v} / s - {reach}D - {slack})"

    def last_tile(v):
        return f"floor({v} / s + {slack})"

    def y_at(x):
        return f"(e.y1 + (greatest(e.x1, least({x}, e.x2)) - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1))"

    leveled = edges.selectExpr("*", f"""explode(concat(filter(sequence(base, last), j -> j < {grid.TOP}),
        if(last > base, array({grid.TOP}), array()))) AS level""").selectExpr("*", f"{grid.tile_size('level')} AS s")
    columns = leveled.selectExpr("*", f"""explode(if({top}, array(0L),
        sequence({first_tile('e.x1')}, {last_tile('e.x2')}))) AS ix""")
    columns = columns.selectExpr("*", "ix * s AS wx0", f"(ix + {reach}D) * s AS wx1")
    columns = compute_once(columns, xa=F.expr("greatest(wx0, least(e.x1, wx1))"),
                           xb=F.expr("greatest(wx0, least(e.x2, wx1))"))
    spans = compute_once(columns, ya=F.expr(f"if(e.x1 = e.x2, e.y1, {y_at('xa')})"),
                         yb=F.expr(f"if(e.x1 = e.x2, e.y2, {y_at('xb')})"))
    spans = compute_once(spans, row_lo=F.expr(f"if({top}, 0L, {first_tile('least(ya, yb)')})"),
                         row_hi=F.expr(f"if({top}, 0L, {last_tile('greatest(ya, yb)')})"),
                         lowest=F.expr(f"if({top}, 0L, {first_tile('miny')})"))

    def row(iy, real, x1, y1, x2, y2, w):
        return f"""named_struct('iy', {iy}, 'real', {real}, 'x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2}, 'w', {w})"""

    def step(x, w):
        return row("row_lo", "false", x, "0D", "wx1", "0D", w)

    touching = f"""transform(sequence(row_lo, row_hi), iy -> {row("iy", "true", "e.x1", "e.y1", "e.x2", "e.y2", "e.w")})"""
    steps = f"filter(array({step('xa', 'e.w')}, {step('xb', '-e.w')}), r -> r.x1 < wx1)"
    rows = spans.selectExpr("aoi", *ABOUT, "level", "ix", f"""inline(
        CASE WHEN e.w != 0 AND row_lo > lowest THEN concat({touching}, {steps}) ELSE {touching} END)""")
    # all that follows goes by tile column, so that edges are shuffled once
    rows = rows.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "aoi", "level", "ix")
    rows = (rows.groupBy("aoi", "level", "ix", *ABOUT, "iy", "real", "x1", "y1", "x2", "y2")
            .agg(F.sum("w").alias("w")).where("real OR w != 0"))

    # from step to step downwards the state at one x stays the same: only stretches with a state become rows
    down = Window.partitionBy("aoi", "level", "ix", "real", "x1").orderBy(F.desc("iy"))
    state = (rows.withColumn("s", F.expr(grid.tile_size("level")))
             .withColumn("until", F.when(~F.col("real"), F.coalesce(F.lead("iy").over(down), F.expr(f"bigint({first_tile('miny')})"))))
             .withColumn("w", F.when(F.col("real"), F.col("w")).otherwise(F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, 0)))).where("real OR w != 0"))
    lid = f"named_struct('iy', j, 'y1', (j + {reach}D) * s, 'y2', (j + {reach}D) * s)"
    placed = state.selectExpr("aoi", *ABOUT, "level", "ix", "real", "x1", "x2", "w", f"""inline(if(real, array(named_struct('iy', iy, 'y1', y1, 'y2', y2)),
        if(until > iy - 1, array(), transform(sequence(until, iy - 1), j -> {lid}))))""")
    return placed.select("aoi", *ABOUT, "level", "ix", "iy", "real", "x1", "y1", "x2", "y2", "w")


def tile_aois(aois: DataFrame, slug: str = "slug") -> AoiTiles:
    """Cut areas (slug, mp, minx, miny, maxx, maxy) into tiles, keep them as a table, and measure it."""
    aois = aois.withColumnRenamed(slug, "aoi")
    rows = _tile_rows(_aoi_edges(aois))
    side = F.struct("x1", "y1", "x2", "y2", "w")
    grouped = rows.groupBy("aoi", "level", "ix", *ABOUT, "iy").agg(
        F.collect_list(F.when(F.col("real"), side)).alias("segs"),
        F.collect_list(F.when(~F.col("real"), side)).alias("lids"))
    border = F.size("segs") > 0
    inside = F.aggregate("lids", F.lit(0.0), lambda acc, s: acc + s.w) != 0
    tiles = grouped.where(border | inside).select(
        *_about_tile(),
        F.when(border, F.col("segs")).alias("segs"),
        F.when(border, F.col("lids")).alias("lids"),
    )
    path = fresh_path(aois.sparkSession, "aoi-tiles")
    tiles.write.parquet(path)
    written = aois.sparkSession.read.schema(tiles.schema).parquet(path)
    # every area has one TOP row; that of a long boundary holds none of it
    long = written.where("last = base").select("aoi", "base", "last", "m2_factor", *[f"a_{c}" for c in ("minx", "miny", "maxx", "maxy")]).distinct()
    if long.head(1):
        top = {"level": F.lit(grid.TOP), "ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long"), "tile": F.expr(grid.tile_key(str(grid.TOP), "0L", "0L")),
               **{c: F.lit(None).cast(tiles.schema[c].dataType) for c in ("segs", "lids")}}
        long.withColumns(top).select(*tiles.columns).write.mode("append").parquet(path)
    return measure_tiles(aois.sparkSession.read.schema(tiles.schema).parquet(path))


def _about_tile() -> list[Column]:
    return [*map(F.col, ("aoi", "base", "last", "level", "ix", "iy")), F.expr(grid.tile_key("level", "ix", "iy")).alias("tile"),
            F.col("m2_factor"), *[F.col(c).alias(f"a_{c}") for c in ("minx", "miny", "maxx", "maxy")]]


def measure_tiles(tiles: DataFrame) -> AoiTiles:
    """Size, levels and bounds of a tile table (also of one written by an earlier run)."""
    held = F.coalesce(F.size("segs"), F.lit(0)) + F.coalesce(F.size("lids"), F.lit(0))
    # every area has exactly one TOP tile
    r = tiles.agg(
        F.count_if(F.col("level") == grid.TOP).alias("n_aois"),
        F.coalesce(F.sum(held.cast("bigint") * 56 + 144), F.lit(0)).alias("n_bytes"),
        F.collect_set(F.struct("base", "last")).alias("kinds"),
        F.count_if((F.col("level") == grid.TOP) & (F.col("last") == F.col("base"))).alias("n_long"),
        F.min("a_minx").alias("minx"), F.min("a_miny").alias("miny"),
        F.max("a_maxx").alias("maxx"), F.max("a_maxy").alias("maxy"),
    ).first()
    boxes = []
    if r.n_aois:
        width = max(r.maxx - r.minx, 1e-9)
        strip = F.least(F.floor((F.col("a_minx") - r.minx) / width * STRIPS), F.lit(STRIPS - 1))
        boxes = (tiles.where(F.col("level") == grid.TOP).groupBy(strip.alias("strip"))
                 .agg(*[f("a_" + c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])
                 .orderBy("strip").select("minx", "miny", "maxx", "maxy").collect())
    return AoiTiles(tiles, r.n_aois, r.n_bytes, tuple(sorted(map(tuple, r.kinds))), r.n_long,
                    None if r.minx is None else (r.minx, r.miny, r.maxx, r.maxy), tuple(tuple(b) for b in boxes))


# --- the join ------------------------------------------------------------------------------------------------
def near_ranges(footprints: DataFrame, tiles: AoiTiles) -> DataFrame:
    """Keep footprints in the ranges that hold all areas, as literal comparisons that reach the Parquet row groups."""
    if not tiles.boxes:
        return footprints.where(F.lit(False))

    def near(b):
        return ((F.col("maxx") >= b[0]) & (F.col("minx") <= b[2])
                & (F.col("maxy") >= b[1]) & (F.col("miny") <= b[3]))

    return footprints.where(reduce(Column.__or__, [near(b) for b in tiles.boxes]))


def bbox_prefilter(footprints: DataFrame, tiles: AoiTiles) -> DataFrame:
    """Keep the footprints whose box meets the box of at least one area, however many areas there are and however large a footprint is."""
    boxes = registry(tiles).select(*[F.col(f"a_{c}").alias(c) for c in BOX])
    return meeting_any(near_ranges(footprints, tiles), boxes)


def registry(tiles: AoiTiles) -> DataFrame:
    """One row for each area, without its boundary."""
    return tiles.tiles.where(F.col("level") == grid.TOP).drop("segs", "lids", "level", "ix", "iy", "tile")


def _with_tile(footprints: DataFrame, kinds: tuple[tuple[int, int], ...]) -> DataFrame:
    """Add the footprint's tile per level in use (one row when all areas share a level)."""
    leveled = compute_once(footprints, _own=F.expr(grid.footprint_level("greatest(maxx - minx, maxy - miny)")))
    wanted = f"array({', '.join(grid.match_level('_own', str(base), str(last)) for base, last in kinds)})"
    return (leveled.withColumn("_level", F.explode(F.expr(wanted if len(kinds) == 1 else f"array_distinct({wanted})")))
            .withColumn("_tile", F.expr(grid.key_of_corner("_level", "minx", "miny"))))


def _candidates(footprints: DataFrame, tiles: AoiTiles, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """Footprints beside the tile that they lie in; and whether there are others, too large for the tiles of some area."""
    placed = _with_tile(near_ranges(footprints, tiles), tiles.kinds)
    areas = tiles.tiles.select("aoi", F.col("base").alias("_base"), F.col("last").alias("_last"), F.col("tile").alias("_tile"), "m2_factor",
                               "a_minx", "a_miny", "a_maxx", "a_maxy",
                               F.col("segs").alias("_segs"), F.col("lids").alias("_lids"))
    on, any_large = ["_tile"], False
    if tiles.n_bytes <= broadcast_bytes and not tiles.n_long:
        areas = F.broadcast(areas)
    else:
        # neither side may be sent whole to every executor; footprints are shuffled once, and only those in a cell with an area
        placed = _near_cells(placed, tiles)
        placed, areas, any_large = _salt(placed, areas.hint("merge"), footprints.columns)
        on.append("_salt")
    # an area further off than the tile is wide is dropped here, before any edge work
    return (placed.join(areas, on)
            .where(f"""_level = {grid.match_level("_own", "_base", "_last")} AND maxx >= a_minx AND minx <= a_maxx
                       AND maxy >= a_miny AND miny <= a_maxy""")
            .drop("_tile", "_salt", "_own", "_level", "_base", "_last", "a_minx", "a_miny", "a_maxx", "a_maxy")), any_large


def _near_cells(placed: DataFrame, tiles: AoiTiles) -> DataFrame:
    """The footprints whose tile lies in a cell that holds a tile of an area; there are never more cells than ``CELL`` leaves the globe, so they are broadcast."""
    # TOP tiles are no place of their own: all their rows stay
    part, half = f"shiftright(_tile, 40) = {grid.TOP}", 1 << 19
    level = max(CELL, *(min(last, grid.TOP - 1) for _, last in tiles.kinds))
    shift = f"(2 * ({level} - cast(shiftright(_tile, 40) AS int)))"
    ix, iy = f"((shiftright(_tile, 20) & {(1 << 20) - 1}L) - {half}L)", f"((_tile & {(1 << 20) - 1}L) - {half}L)"
    cell = F.expr(f"if({part}, NULL, shiftright({ix}, {shift}) * {1 << 20}L + shiftright({iy}, {shift}))")
    cells = tiles.tiles.select(F.col("tile").alias("_tile")).select(cell.alias("_cell")).where("_cell IS NOT NULL").distinct()
    rows = placed.withColumn("_cell", cell)
    return rows.join(F.broadcast(cells.withColumn("_has", F.lit(True))), "_cell", "left").where(f"_has OR {part}").drop("_cell", "_has")


def _salt(placed: DataFrame, areas: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Split tiles that hold a large share of the footprints; their areas are repeated once per split.

    TOP tiles are left out on both sides; the last result tells whether any footprint would have needed them.
    The list of such tiles cannot be longer than HOT_TILES, whatever the data, so it is safe to broadcast. Rows
    that agree in every column stay together; adaptive skew handling splits those by map output.
    """
    # of all rows that are sent, also those in tiles without an area: the tiles of the areas aren't read and shuffled for a count
    per_tile = write_and_read(placed.groupBy("_tile").agg(F.count("*").alias("n")), "tile-counts")
    below = F.col("_tile") < F.expr(grid.tile_key(str(grid.TOP), "0L", "0L"))  # the level comes first in the number
    any_large = bool(per_tile.where(~below).head(1))
    per_tile, placed, areas = per_tile.where(below), placed.where(below), areas.where(below)
    threshold = max(1, int((per_tile.agg(F.sum("n")).first()[0] or 0) / HOT_TILES))
    hot = F.broadcast(per_tile.where(F.col("n") > threshold)
                      .select("_tile", F.ceil(F.col("n") / threshold).cast("int").alias("_splits")))
    splits = F.coalesce("_splits", F.lit(1))
    salted = (placed.withColumn("_row", row_hash(placed.select(*columns))).join(hot, "_tile", "left")
              .withColumn("_salt", F.pmod("_row", splits).cast("int")).drop("_splits", "_row"))
    repeated = (areas.join(hot, "_tile", "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_splits"))
    return salted, repeated, any_large


def clip(
    footprints: DataFrame,
    tiles: AoiTiles,
    keep: tuple[str, ...] = ("bf_source",),
    geometry: str = "geometry",
    with_geometry: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    crs: tuple[str, ...] = (),
) -> DataFrame:
    """Intersection join and clip: one row per (footprint, area) that share at least a point.

    Columns: ``aoi``, the kept footprint columns, ``area_deg2`` of the clipped shape, ``m2_factor`` of the area,
    ``cut`` (does the boundary come near), and ``mp`` (the clipped shape) when asked for. A footprint that
    only touches an area is a match with area 0 and an empty shape. ``crs`` may give the labels of both sides' systems.
    """
    check_crs(*crs)
    if not tiles.kinds:
        raise ValueError("no valid area of interest to clip with")
    # the measured columns of the clip go before those of the same name
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("aoi", "area_deg2", "m2_factor", "cut", "mp"))
    columns = [c for c in dict.fromkeys((*keep, *BOX, "area_deg2")) if c != geometry] + [geometry]
    prepared = prepare_footprints(footprints, geometry).select(*columns)
    pairs, any_large = _candidates(prepared, tiles, broadcast_bytes)
    matched = overlaps(pairs, keep, columns, geometry, with_geometry)
    if not any_large:
        return matched
    return matched.unionByName(clip_large(near_ranges(prepared, tiles), tiles.tiles, registry(tiles), min(last for _, last in tiles.kinds), keep, geometry,
                                          with_geometry, overlaps, tiles.n_long > 0))


def overlaps(pairs: DataFrame, keep: tuple[str, ...], columns: list[str], geometry: str, with_geometry: bool) -> DataFrame:
    """The clip from footprints beside a tile: ``_segs`` and ``_lids`` are its boundary edges and lids, NULL in a full tile.

    The last of ``columns`` is the geometry.
    """
    # Where no boundary edge comes near the footprint's box, the box is wholly inside or wholly outside. Only rows
    # that still need work take their shapes along.
    state = f"""CASE WHEN _segs IS NULL THEN 'inside'
        WHEN {G.any_edge_in_box("_segs", "minx", "miny", "maxx", "maxy")} THEN 'crossed'
        WHEN {G.winding("_segs", "minx", "miny")} + {G.winding("_lids", "minx", "miny")} != 0 THEN 'inside' END"""
    shape = geometry if with_geometry else f"if(st = 'crossed', {geometry}, NULL)"
    if not with_geometry:
        pairs = pairs.withColumn(geometry, F.when(F.col("_segs").isNotNull(), F.col(geometry)))
    pairs = pairs.select("aoi", *columns[:-1], "m2_factor", F.expr(f"""inline(transform(
        filter(array({state}), st -> st IS NOT NULL), st -> named_struct('_crossed', st = 'crossed',
            '_shape', {shape}, '_s', if(st = 'crossed', _segs, NULL), '_l', if(st = 'crossed', _lids, NULL))))"""))

    # The crossed ones are compared with the boundary edge by edge.
    crossed = F.col("_crossed")
    pairs = pairs.withColumn("_mp", as_multipolygon(pairs, "_shape")).drop("_shape")
    near = G.with_weight(f"concat({G.edges_near('_s', 'minx', 'miny', 'maxx')}, _l)")
    pairs = compute_once(pairs, _edges=F.when(crossed, F.expr(G.edges("_mp"))), _sides=F.when(crossed, F.expr(near)))
    pairs = compute_once(pairs, _overlap=F.when(crossed, F.expr(G.overlap_area("_edges", "_sides", "miny"))))

    has_area = F.col("_overlap") > F.col("area_deg2") * G.AREA_NOISE
    touches = F.expr(f"""{G.edges_meet("_edges", "_s")}
        OR {G.winding("_sides", "_edges[0].x1", "_edges[0].y1")} != 0
        OR exists(_s, v -> {G.winding(G.with_weight("_edges"), "v.x1", "v.y1")} != 0)""")
    matches = ~crossed | has_area | touches
    clipped = F.least("area_deg2", F.when(has_area, F.col("_overlap")).otherwise(0.0))
    out = ["aoi", *keep, F.when(crossed, clipped).otherwise(F.col("area_deg2")).alias("area_deg2"),
           "m2_factor", crossed.alias("cut")]
    matched = pairs.where(matches)
    if with_geometry:
        shape = F.expr(G.overlap_geometry(G.with_weight("_edges"), "_sides", "minx", "maxx"))
        matched = compute_once(matched, mp=F.when(crossed, shape).otherwise(F.col("_mp")))
        out.append("mp")
    return matched.select(*out)
