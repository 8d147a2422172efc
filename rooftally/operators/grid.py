"""The tile grid behind the spatial join.

Level ``j`` has square tiles of ``2**-8 * 4**j`` degrees, so tile numbers are exact divisions by powers of two.
A tile serves the footprints whose lower-left corner lies in it; it looks a quarter of its size beyond its upper
and right edges, so every footprint no larger than that quarter belongs to exactly one tile. Larger footprints
move to a coarser level. A footprint is therefore matched in one place per area of interest: no de-duplication and no regrouping
after the join. The few that are too large for an area's coarsest level meet its whole boundary where all tiles are broadcast (``TOP``),
and are cut along its tiles where they are not, so that no key ever holds a long boundary.

As in ``functions.geometry``, the functions take and return SQL text.
"""

from __future__ import annotations

FINEST = 2.0 ** -8
STEP = 4.0
LEVELS = range(9)
TOP = 9
OVERHANG = 0.25
# An area is tiled at its own level and this many coarser ones before TOP.
COARSER = 1
# Areas with more boundary edges are tiled finer, at one level only, and have no TOP tile.
MANY_EDGES = 1 << 16
TILES_PER_SIDE, TILES_OF_MANY = 64, 256


def tile_size(level: str) -> str:
    return f"({FINEST}D * pow({STEP}D, {level}))"


def footprint_level(extent: str) -> str:
    """Finest level whose overhang holds a footprint of this extent."""
    return " + ".join(f"int({extent} > {FINEST * STEP ** j * OVERHANG}D)" for j in LEVELS)


def area_level(extent: str, tiles_per_side: int = TILES_PER_SIDE) -> str:
    """Finest level at which the area spans at most so many tiles."""
    return " + ".join(f"int({extent} / {1.0 * tiles_per_side}D > {FINEST * STEP ** j}D)" for j in LEVELS[:-1])


def match_level(own: str, base: str, last: str) -> str:
    """Level at which a footprint of level ``own`` meets an area tiled from ``base`` to ``last``."""
    level = f"greatest({own}, {base})"
    return f"if({level} > {last} OR {level} >= {TOP}, {TOP}, {level})"


def tile_key(level: str, ix: str, iy: str) -> str:
    """One BIGINT per tile: level, then column, then row."""
    half = 1 << 19
    return f"({level} * {1 << 40}L + ({ix} + {half}L) * {1 << 20}L + ({iy} + {half}L))"


def key_of_corner(level: str, minx: str, miny: str) -> str:
    cell = tile_key(level, f"floor({minx} / {tile_size(level)})", f"floor({miny} / {tile_size(level)})")
    return f"if({level} = {TOP}, {tile_key(str(TOP), '0L', '0L')}, {cell})"


def z_order(minx: str, miny: str) -> str:
    """Bit-interleaved finest tile number: neighbours on the map are mostly neighbours in the order."""

    def spread(v: str) -> str:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = f"transform({v}, v -> (v | shiftleft(v, {shift})) & {mask}L)"
        return v

    ix, iy = f"array(floor(({minx} + 180D) / {FINEST}D))", f"array(floor(({miny} + 90D) / {FINEST}D))"
    return f"{spread(ix)}[0] | shiftleft({spread(iy)}[0], 1)"
