"""Join of two polygon tables by shape, for datasets that share no ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rooftally.functions import geometry as G
from rooftally.functions.plan import compute_once
from rooftally.operators.box_join import BOX, box_pairs
from rooftally.sources.footprints import as_multipolygon, prepare_footprints
from rooftally.workspace import write_and_read


def _shaped(df: DataFrame, geometry: str, row: str) -> DataFrame:
    """Box, area and edges of each row, with its number."""
    measured = prepare_footprints(df.select(row, F.col(geometry).alias("geometry")), "geometry").where("minx IS NOT NULL")
    decoded = measured.withColumn("_mp", as_multipolygon(measured, "geometry"))
    return compute_once(decoded.drop("geometry"), edges=F.expr(G.edges("_mp"))).select(row, *BOX, "area_deg2", "edges")


def shape_pairs(left: DataFrame, right: DataFrame, left_id: str = "l_id", right_id: str = "r_id", geometry: str = "geometry") -> DataFrame:
    """(left_id, right_id, shared_deg2): all pairs of rows whose shapes share at least a point, each once.

    Candidates are pairs of boxes, found by size class in equality joins; the shapes of a pair are compared edge by edge in the one row that reports it.
    Shapes that merely touch share an area of 0. NULL and empty geometries meet nothing.
    """
    placed = _placed(box_pairs(_shaped(left, geometry, left_id), _shaped(right, geometry, right_id)), left_id, right_id)
    crossed = F.col("_state") == "crossed"
    shared = compute_once(placed, _area=F.when(crossed, F.expr(G.overlap_area(G.with_weight("_edges_l"), G.with_weight("_edges_r"), "_low"))))
    smaller = F.least("_area_l", "_area_r")
    real = F.col("_area") > smaller * G.AREA_NOISE
    touches = F.expr(f"""{G.edges_meet("_edges_l", "_edges_r")}
        OR exists(_edges_l, e -> {G.winding(G.with_weight("_edges_r"), "e.x1", "e.y1")} != 0)
        OR exists(_edges_r, e -> {G.winding(G.with_weight("_edges_l"), "e.x1", "e.y1")} != 0)""")
    return shared.where(~crossed | real | touches).select(
        left_id, right_id, F.when(F.col("_state") == "l", F.col("_area_l")).when(F.col("_state") == "r", F.col("_area_r"))
        .when(real, F.least("_area", smaller)).otherwise(0.0).alias("shared_deg2"))


def _placed(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs with the shape that lies in the other (``l``, ``r``), or ``crossed``; those that lie apart are left out.

    Where no edge of one shape comes near the other's box, that box is wholly inside or wholly outside. Only crossed pairs take their edges along.
    """
    def state(outer: str, inner: str, then: str) -> str:
        near = G.any_edge_in_box(f"{outer}.edges", *[f"{inner}.{c}" for c in BOX])
        inside = f"""size({inner}.edges) > 0 AND {G.winding(f"{outer}.edges", f"{inner}.minx", f"{inner}.miny")} != 0"""
        return f"CASE WHEN {near} THEN {then} WHEN {inside} THEN '{inner}' END"

    known = compute_once(pairs, _state=F.expr(state("l", "r", state("r", "l", "'crossed'")))).where("_state IS NOT NULL")
    crossed = F.col("_state") == "crossed"
    return known.select(F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id), "_state",
                        F.col("l.area_deg2").alias("_area_l"), F.col("r.area_deg2").alias("_area_r"), F.least("l.miny", "r.miny").alias("_low"),
                        F.when(crossed, F.col("l.edges")).alias("_edges_l"), F.when(crossed, F.col("r.edges")).alias("_edges_r"))


def only_in_first_by_shape(first: DataFrame, second: DataFrame, geometry: str = "geometry", least_share: float = 0.0) -> DataFrame:
    """Rows of ``first`` that no row of ``second`` covers to more than ``least_share`` of their area.

    With 0 a row counts as covered as soon as any area is shared; contact alone is not enough. Rows without a geometry are kept: nothing covers them.
    """
    numbered = write_and_read(first.withColumn("_l", F.monotonically_increasing_id()), "first")
    other = second.select(F.col(geometry).alias(geometry), F.monotonically_increasing_id().alias("_r"))
    pairs = shape_pairs(numbered, other, "_l", "_r", geometry)
    areas = prepare_footprints(numbered.select("_l", F.col(geometry).alias("geometry"))).select("_l", "area_deg2")
    covered = pairs.join(areas, "_l").where(F.col("shared_deg2") > F.col("area_deg2") * F.lit(float(least_share))).select("_l").distinct()
    return numbered.join(covered, "_l", "left_anti").drop("_l")
