"""Joins of bounding boxes by size class.

A box belongs to the finest grid level whose tiles are as large as it, so it covers at most two by two tiles there, and on every coarser
level. Two boxes are looked up on the level of the larger one: a single huge box adds a few rows of its own and leaves
the cells of all others as they are. Joins are equalities on (level, column, row), followed by the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rooftally.operators import grid

BOX = ("minx", "miny", "maxx", "maxy")


def size_class(minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> str:
    """SQL text of a box's level."""
    extent = f"greatest({maxx} - {minx}, {maxy} - {miny})"
    return " + ".join(f"int({extent} > {grid.FINEST * grid.STEP ** j}D)" for j in grid.LEVELS)


def classes_in_use(df: DataFrame) -> list[int]:
    """The levels that the boxes of a table belong to; there are ten at most."""
    return sorted(r[0] for r in df.select(F.expr(size_class()).alias("c")).where("c IS NOT NULL").distinct().collect())


def _cells(df: DataFrame, level: str, prefix: str) -> DataFrame:
    """One row for each tile of ``level`` (SQL text) that the box covers."""
    s = grid.tile_size(level)
    spans = [f"sequence(bigint(floor({low} / {s})), bigint(floor({high} / {s})))" for low, high in (("minx", "maxx"), ("miny", "maxy"))]
    return (df.withColumn(prefix + "x", F.explode(F.expr(spans[0]))).withColumn(prefix + "y", F.explode(F.expr(spans[1]))))


def meet(a: str, b: str) -> Column:
    """Do two boxes (structs) share a point?"""
    return F.expr(f"{a}.maxx >= {b}.minx AND {a}.minx <= {b}.maxx AND {a}.maxy >= {b}.miny AND {a}.miny <= {b}.maxy")


def _registered(df: DataFrame, name: str, others: list[int]) -> DataFrame:
    """Rows as a struct ``name`` on the tiles of the coarser levels that the other side's boxes have, and of their own if that side has any as small."""
    boxed = df.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX))
    whole = boxed.select(*BOX, F.struct("*").alias(name), F.expr(size_class()).alias("_own"))
    known = f"cast(array({', '.join(map(str, others))}) AS array<int>)"
    levels = f"concat(if(exists({known}, j -> j <= _own), array(_own), cast(array() AS array<int>)), filter({known}, j -> j > _own))"
    placed = _cells(whole.withColumn("_level", F.explode(F.expr(levels))), "_level", "_c")
    return placed.select(name, F.col("_own").alias(f"_own_{name}"), "_level", "_cx", "_cy")


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs (``l``, ``r``) of rows whose boxes share a point, each once; both tables have ``BOX``.

    A pair is found on the level of its larger box, in each tile that both cover, and reported by the tile that holds the lower left corner of
    what they share. Rows with a NULL in their box meet nothing. Large tiles are split by adaptive skew handling.
    """
    a = _registered(left, "l", classes_in_use(right))
    b = _registered(right, "r", classes_in_use(left)).hint("merge")
    s = grid.tile_size("_level")
    here = F.expr(f"floor(greatest(l.minx, r.minx) / {s}) = _cx AND floor(greatest(l.miny, r.miny) / {s}) = _cy")
    larger = F.expr("_level = greatest(_own_l, _own_r)")
    return a.join(b, ["_level", "_cx", "_cy"]).where(larger & meet("l", "r") & here).select("l", "r")


def meeting_any(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose box meets a box of ``boxes``, as they are: no row is repeated, whatever its size or theirs.

    There is one lookup for each size class of ``boxes``: on that class's level, or on the row's own if that is coarser, where a row is
    looked up by its lower left corner. The boxes reach one tile further to the left and below, as far as such a row can extend.
    """
    classes = classes_in_use(boxes)
    if not classes:
        return df.where(F.lit(False))
    own = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX)).select(*[F.col(c).alias(f"_b_{c}") for c in BOX], F.expr(size_class()).alias("_class")).distinct()
    looked, views, found = df.select("*", F.expr(size_class()).alias("_own_class")), {}, []
    for c in classes:
        levels = own.where(F.col("_class") == c).withColumn("_level", F.explode(F.sequence(F.lit(c), F.lit(max(grid.LEVELS) + 1))))
        s = grid.tile_size("_level")
        spans = [f"sequence(bigint(floor({low} / {s})) - 1, bigint(floor({high} / {s})))" for low, high in (("_b_minx", "_b_maxx"), ("_b_miny", "_b_maxy"))]
        views[f"c{c}"] = levels.withColumn("_bx", F.explode(F.expr(spans[0]))).withColumn("_by", F.explode(F.expr(spans[1])))
        level = f"greatest(_own_class, {c})"
        t = grid.tile_size(level)
        looked = looked.selectExpr("*", f"{level} AS _l{c}", f"bigint(floor(minx / {t})) AS _x{c}", f"bigint(floor(miny / {t})) AS _y{c}")
        found.append(f"""EXISTS (SELECT 1 FROM {{c{c}}} b WHERE b._level = f._l{c} AND b._bx = f._x{c} AND b._by = f._y{c}
            AND b._b_maxx >= f.minx AND b._b_minx <= f.maxx AND b._b_maxy >= f.miny AND b._b_miny <= f.maxy)""")
    kept = df.sparkSession.sql(f"SELECT * FROM {{looked}} f WHERE {' OR '.join(found)}", looked=looked, **views)
    return kept.select(*df.columns)
