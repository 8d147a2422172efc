"""Planar polygon maths as Spark SQL expressions.

A geometry is a MultiPolygon ``ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>``: polygons, rings (the first one is the
shell, the others are holes), closed point lists, ``[x, y]``. Rings may run either way round.

Overlaps are computed from *signed edges*. Every non-vertical edge spans ``x1 < x2`` and has a weight ``w``:
+1 when the polygon lies just below it, -1 when it lies just above. The polygon is then the weighted sum of the
regions under its edges, so for two polygons ``A`` and ``B``

    area(A & B) = sum over edge pairs of  wA * wB * integral of min(yA(x), yB(x)) dx

which holds for concave shapes, holes and several parts alike, and needs no clipping of vertex lists.

The functions take column names (or other SQL text) and return SQL text for ``F.expr``: one call to the session
per expression instead of one per arithmetic step. A one-element array with ``transform`` binds a value that is
used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MULTIPOLYGON = "array<array<array<array<double>>>>"
MULTIPOLYGON_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
_NO_EDGES = "cast(array() AS array<struct<x1:double,y1:double,x2:double,y2:double,w:double>>)"

# An overlap below this share of the footprint is rounding noise, not area.
AREA_NOISE = 1e-9
# Computed corners closer than this (in degrees; a micrometre) are one point.
SAME_POINT = "1e-11D"


# --- rings and polygons ------------------------------------------------------------------------------------
def ring_signed_area(ring: str) -> str:
    """Shoelace area of a closed ring, positive when counter-clockwise, shifted to the first vertex."""
    r = ring
    return f"""(aggregate(
        CASE WHEN size({r}) > 3 THEN sequence(1, size({r}) - 3) ELSE cast(array() AS array<int>) END, 0D,
        (s, k) -> s + (({r}[k][0] - {r}[0][0]) * ({r}[k + 1][1] - {r}[0][1])
                       - ({r}[k + 1][0] - {r}[0][0]) * ({r}[k][1] - {r}[0][1]))) / 2D)"""


def polygon_area(mp: str) -> str:
    """Planar area in squared coordinate units: shells minus holes."""
    return f"""aggregate({mp}, 0D, (total, polygon) -> total + aggregate(
        transform(polygon, (ring, n) -> if(n = 0, 1D, -1D) * abs({ring_signed_area("ring")})), 0D,
        (part, a) -> part + a))"""


def points(mp: str) -> str:
    return f"flatten(flatten({mp}))"


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed ring of an axis-aligned box."""
    return F.array(F.array(minx, miny), F.array(maxx, miny), F.array(maxx, maxy), F.array(minx, maxy),
                   F.array(minx, miny))


# --- signed edges ------------------------------------------------------------------------------------------
def ring_side(ring: str, ring_number: str) -> str:
    """+1 when the polygon is on the left of the ring as written (shells counter-clockwise, holes clockwise)."""
    return f"(if({ring_number} = 0, 1D, -1D) * signum({ring_signed_area(ring)}))"


def ring_edges(ring: str, side: str) -> str:
    """Edges of one closed ring; ``side`` (a cheap expression) is +1 with the polygon on the left, else -1."""
    r = ring
    return f"""CASE WHEN size({r}) > 1 THEN transform(sequence(0, size({r}) - 2), i -> CASE
        WHEN {r}[i][0] > {r}[i + 1][0]
        THEN named_struct('x1', {r}[i + 1][0], 'y1', {r}[i + 1][1], 'x2', {r}[i][0], 'y2', {r}[i][1],
                          'w', {side})
        ELSE named_struct('x1', {r}[i][0], 'y1', {r}[i][1], 'x2', {r}[i + 1][0], 'y2', {r}[i + 1][1],
                          'w', if({r}[i][0] = {r}[i + 1][0], 0D, -{side})) END)
        ELSE {_NO_EDGES} END"""


def edges(mp: str) -> str:
    """All edges of a MultiPolygon with their weights."""
    bound = f"array(named_struct('ring', ring, 'side', {ring_side('ring', 'n')}))"
    return f"""flatten(transform({mp}, polygon -> flatten(transform(polygon, (ring, n) ->
        transform({bound}, b -> {ring_edges("b.ring", "b.side")})[0]))))"""


def edges_near(segs: str, minx: str, miny: str, maxx: str) -> str:
    """Edges that can matter to a shape in the given box: they share its x range and are not wholly below it."""
    return f"filter({segs}, s -> s.x2 >= {minx} AND s.x1 <= {maxx} AND greatest(s.y1, s.y2) >= {miny})"


def any_edge_in_box(segs: str, minx: str, miny: str, maxx: str, maxy: str) -> str:
    """Does the box of any edge meet the given box?"""
    return f"""exists({segs}, s -> s.x2 >= {minx} AND s.x1 <= {maxx}
        AND greatest(s.y1, s.y2) >= {miny} AND least(s.y1, s.y2) <= {maxy})"""


def with_weight(segs: str) -> str:
    return f"filter({segs}, s -> s.w != 0)"


def _height(edge: str, x: str, origin: str = "0D") -> str:
    e = edge
    return f"(({e}.y1 - {origin}) + ({x} - {e}.x1) * ({e}.y2 - {e}.y1) / ({e}.x2 - {e}.x1))"


# --- overlap of two edge sets --------------------------------------------------------------------------------
def overlap_area(a: str, b: str, oy: str) -> str:
    """Overlap area of two polygons given as signed edges (without vertical ones in ``b``).

    ``oy`` is a nearby height: measuring from there keeps the precision of small shapes far from the origin.
    """
    spans = f"""transform(filter({b}, f -> f.x2 > e.x1 AND f.x1 < e.x2),
        f -> named_struct('l', greatest(e.x1, f.x1), 'r', least(e.x2, f.x2), 'f', f))"""
    heights = f"""transform({spans}, t -> named_struct('k', e.w * t.f.w * (t.r - t.l),
        'el', {_height('e', 't.l', oy)}, 'er', {_height('e', 't.r', oy)},
        'fl', {_height('t.f', 't.l', oy)}, 'fr', {_height('t.f', 't.r', oy)}))"""
    gaps = f"""transform({heights}, t -> named_struct('k', t.k, 'mean', (t.el + t.er + t.fl + t.fr) / 4D,
        'dl', t.el - t.fl, 'dr', t.er - t.fr))"""
    # integral of the smaller height = mean height less half the mean distance
    return f"""aggregate({with_weight(a)}, 0D, (total, e) -> total + aggregate({gaps}, 0D, (part, t) ->
        part + t.k * (t.mean - CASE WHEN t.dl * t.dr >= 0 THEN (abs(t.dl) + abs(t.dr)) / 4D
            ELSE (t.dl * t.dl + t.dr * t.dr) / ((abs(t.dl) + abs(t.dr)) * 4D) END)))"""


def _turn(line: str, px: str, py: str) -> str:
    s = line
    return f"signum(({s}.x2 - {s}.x1) * ({py} - {s}.y1) - ({s}.y2 - {s}.y1) * ({px} - {s}.x1))"


def edges_meet(a: str, b: str) -> str:
    """True when any two edges share a point (closed segments, so touching counts)."""
    return f"""exists({a}, e -> exists({b}, f -> e.x1 <= f.x2 AND f.x1 <= e.x2
        AND least(e.y1, e.y2) <= greatest(f.y1, f.y2) AND least(f.y1, f.y2) <= greatest(e.y1, e.y2)
        AND {_turn('f', 'e.x1', 'e.y1')} * {_turn('f', 'e.x2', 'e.y2')} <= 0
        AND {_turn('e', 'f.x1', 'f.y1')} * {_turn('e', 'f.x2', 'f.y2')} <= 0))"""


def winding(segs: str, px: str, py: str) -> str:
    """Weights of the edges above a point, 0 outside the polygon (boundary points are left to ``edges_meet``)."""
    above = f"filter({segs}, s -> s.x1 <= {px} AND {px} < s.x2 AND {_height('s', px)} > {py})"
    return f"aggregate({above}, 0D, (total, s) -> total + s.w)"


# --- overlap as a geometry -----------------------------------------------------------------------------------
_SLICES = "array<struct<xl:double,xr:double,tl:double,tr:double,bl:double,br:double>>"


def _cut_positions(a: str, b: str, minx: str, maxx: str) -> str:
    """x of every vertex and every crossing: between two of them no edges start, end or cross."""
    gap = f"""named_struct('lo', g.lo, 'hi', g.hi, 'gl', {_height('e', 'g.lo')} - {_height('f', 'g.lo')},
        'gr', {_height('e', 'g.hi')} - {_height('f', 'g.hi')})"""
    crossings = f"""flatten(transform({a}, e -> flatten(transform(
        filter({b}, f -> f.x2 > e.x1 AND f.x1 < e.x2), f -> transform(filter(transform(
            array(named_struct('lo', greatest(e.x1, f.x1), 'hi', least(e.x2, f.x2))), g -> {gap}),
            g -> g.gl * g.gr < 0), g -> g.lo + (g.hi - g.lo) * g.gl / (g.gl - g.gr))))))"""
    ends = f"flatten(transform(concat({a}, {b}), s -> array(s.x1, s.x2)))"
    return f"array_sort(array_distinct(filter(concat({ends}, {crossings}), x -> x >= {minx} AND x <= {maxx})))"


def _slices(a: str, b: str, xs: str) -> str:
    """Overlap between neighbouring cut positions, as an array of trapezoid arrays (one per gap)."""

    def over(segs, in_a, in_b):
        def y(x):
            return f"if({x} = s.x2, s.y2, {_height('s', x)})"

        return f"""transform(filter({segs}, s -> s.x1 <= c.l AND s.x2 >= c.r), s -> named_struct(
            'ym', {y('((c.l + c.r) / 2D)')}, 'yl', {y('c.l')}, 'yr', {y('c.r')}, 'a', {in_a}, 'b', {in_b}))"""

    was_in, is_in = "(m.a > 0 AND m.b > 0)", "(m.a + e.a > 0 AND m.b + e.b > 0)"
    piece = """array(named_struct('xl', c.l, 'xr', c.r, 'tl', m.tl, 'tr', m.tr, 'bl', e.yl, 'br', e.yr))"""
    walk = f"""named_struct('a', m.a + e.a, 'b', m.b + e.b,
        'tl', if({is_in} AND NOT {was_in}, e.yl, m.tl), 'tr', if({is_in} AND NOT {was_in}, e.yr, m.tr),
        'out', if({was_in} AND NOT {is_in} AND (m.tl > e.yl OR m.tr > e.yr), concat(m.out, {piece}), m.out))"""
    downwards = f"reverse(array_sort(concat({over(a, 's.w', '0D')}, {over(b, '0D', 's.w')})))"
    between = f"""aggregate({downwards}, named_struct('a', 0D, 'b', 0D, 'tl', 0D, 'tr', 0D,
        'out', cast(array() AS {_SLICES})), (m, e) -> {walk}, m -> m.out)"""
    return f"""CASE WHEN size({xs}) > 1 THEN transform(sequence(0, size({xs}) - 2), i ->
        transform(array(named_struct('l', {xs}[i], 'r', {xs}[i + 1])), c -> {between})[0])
        ELSE cast(array() AS array<{_SLICES}>) END"""


def _closed(pts: str) -> str:
    """Ring of a point list without its repeated and collinear points."""
    previous = "raw[pmod(j + size(raw) - 1, size(raw))]"
    distinct = f"""transform(array({pts}), raw -> filter(raw, (p, j) ->
        abs(p[0] - {previous}[0]) > {SAME_POINT} OR abs(p[1] - {previous}[1]) > {SAME_POINT}))[0]"""
    before, after = "open[pmod(j + size(open) - 1, size(open))]", "open[pmod(j + 1, size(open))]"
    near = f"""array(named_struct('q', {before}, 'r', {after}, 'p', p))"""
    reach = """greatest(abs(v.r[0] - v.q[0]), abs(v.r[1] - v.q[1]), abs(v.p[0] - v.q[0]), abs(v.p[1] - v.q[1]))"""
    is_corner = f"""exists({near}, v -> abs((v.r[0] - v.q[0]) * (v.p[1] - v.q[1])
        - (v.r[1] - v.q[1]) * (v.p[0] - v.q[0])) > {reach} * {reach} * 1e-9D)"""
    corners = f"transform(array({distinct}), open -> filter(open, (p, j) -> {is_corner}))[0]"
    return f"transform(array({corners}), open -> concat(open, array(get(open, 0))))[0]"


def _outline(parts: str) -> str:
    """Ring around neighbouring slices: along their lower sides, back along their upper sides."""
    lower = f"flatten(transform({parts}, t -> array(array(t.xl, t.bl), array(t.xr, t.br))))"
    upper = f"flatten(transform(reverse({parts}), t -> array(array(t.xr, t.tr), array(t.xl, t.tl))))"
    return _closed(f"concat({lower}, {upper})")


def overlap_geometry(a: str, b: str, minx: str, maxx: str) -> str:
    """Overlap of two edge sets (without vertical edges) as a MultiPolygon.

    One ring when the overlap is a single run of slices; otherwise one polygon per slice (adjacent polygons that
    cover the same points). A mere touch gives an empty MultiPolygon.
    """
    gaps = f"transform(array({_cut_positions(a, b, minx, maxx)}), xs -> {_slices(a, b, 'xs')})[0]"
    joined = """forall(sequence(0, greatest(size(d.parts) - 2, 0)), k -> size(d.parts) < 2 OR (
        d.parts[k].xr = d.parts[k + 1].xl
        AND greatest(d.parts[k].br, d.parts[k + 1].bl) < least(d.parts[k].tr, d.parts[k + 1].tl)))"""
    shape = f"""CASE WHEN size(d.parts) = 0 THEN cast(array() AS {MULTIPOLYGON})
        WHEN d.simple AND {joined} THEN array(array({_outline("d.parts")}))
        ELSE transform(d.parts, u -> array({_outline("array(u)")})) END"""
    described = f"""transform(array({gaps}), g -> named_struct('parts', flatten(g),
        'simple', forall(g, h -> size(h) <= 1)))"""
    return f"filter(transform({described}, d -> {shape})[0], polygon -> size(polygon[0]) >= 4)"
