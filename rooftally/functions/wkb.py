"""WKB columns to and from MultiPolygon arrays, and the measures of both, in whole Arrow batches.

The bytes of all geometries in a batch are walked together: one step reads the next ring header of every
geometry that still has one, then all vertices of the batch are gathered at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from rooftally.functions.geometry import MULTIPOLYGON_TYPE

# Fixed values of the format: kinds, the flags of its extended form, and what the other form adds to a kind for Z and M.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI = 1, 2, 3, 4, 5, 6
EWKB_Z_FLAG, EWKB_M_FLAG, EWKB_SRID_FLAG = 0x80000000, 0x40000000, 0x20000000
ISO_STEP = 1000

STATS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy", "area_deg2")])


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in counts, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class _Cursor:
    """Read position inside every geometry of one batch.

    A geometry that can't be read ends the reading; with ``lenient`` its first problem is noted and the others are read on.
    """

    def __init__(self, column: pa.Array, lenient: bool = False):
        column = column.cast(pa.large_binary())
        self.valid = np.asarray(column.is_valid())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.at = offsets[:-1].copy()
        self.end = offsets[1:]
        self.little = np.ones(len(column), bool)
        self.lenient, self.sound, self.problems = lenient, np.ones(len(column), bool), np.full(len(column), None)

    def fail(self, rows, problem):
        if len(rows) and not self.lenient:
            raise ValueError(problem)
        first = rows[self.sound[rows]]
        self.problems[first], self.sound[first] = problem, False

    def _take(self, rows, width):
        over = self.at[rows] + width > self.end[rows]
        self.fail(rows[over], "truncated WKB geometry")
        out, rest = np.zeros((len(rows), width), np.uint8), rows[~over]
        out[~over] = self.data[self.at[rest][:, None] + np.arange(width)]
        self.at[rest] += width
        return out

    def order(self, rows):
        self.little[rows] = self._take(rows, 1)[:, 0] == 1

    def uint(self, rows):
        raw = self._take(rows, 4)
        raw = np.where(self.little[rows][:, None], raw, raw[:, ::-1])
        return np.ascontiguousarray(raw).view("<u4")[:, 0].astype(np.int64)

    def points(self, rows, counts, widths):
        """Skip ``counts`` points of ``widths`` numbers per row; return their start offsets."""
        start = self.at[rows].copy()
        self.at[rows] += counts * widths * 8
        self.fail(rows[self.at[rows] > self.end[rows]], "truncated WKB geometry")
        return start


def _header(cur: _Cursor, rows):
    """Kind and numbers per point of the next geometry of each row; both ways of marking Z and M are known."""
    cur.order(rows)
    raw = cur.uint(rows)
    srid = rows[(raw & EWKB_SRID_FLAG) != 0]
    if len(srid):
        cur.uint(srid)
    step = (raw & 0x0FFFFFFF) // ISO_STEP  # 1: Z, 2: M, 3: both
    has_z = ((raw & EWKB_Z_FLAG) != 0) | (step == 1) | (step == 3)
    has_m = ((raw & EWKB_M_FLAG) != 0) | (step == 2) | (step == 3)
    cur.fail(rows[step > 3], "unknown WKB geometry")
    return (raw & 0x0FFFFFFF) % ISO_STEP, 2 + has_z.astype(np.int64) + has_m


def _walk(cur: _Cursor):
    """Number of parts and single kind of every geometry, and the places of all rings, ring number by ring number."""
    n = len(cur.at)
    rows = np.flatnonzero(cur.valid)
    kind, width = np.zeros(n, np.int64), np.full(n, 2)
    kind[rows], width[rows] = _header(cur, rows)
    cur.fail(rows[(kind[rows] < POINT) | (kind[rows] > MULTI)], "only points, lines and polygons are supported")
    is_multi = kind >= MULTI_POINT
    parts = np.zeros(n, np.int64)
    parts[rows] = 1
    multi = np.flatnonzero(is_multi & cur.sound)
    parts[multi] = cur.uint(multi)
    single = np.where(is_multi, kind - 3, kind)

    found = []  # (geometry, polygon, ring, start, count, little, bytes of a point)
    polygon = 0
    while len(rows := np.flatnonzero((parts > polygon) & cur.sound)):
        inner = rows[is_multi[rows]]
        if len(inner):
            own, width[inner] = _header(cur, inner)
            cur.fail(inner[own != single[inner]], "mixed kinds in a WKB geometry")
            rows = rows[cur.sound[rows]]
        n_rings = np.zeros(n, np.int64)
        n_rings[rows] = 1
        shells = rows[single[rows] == POLYGON]
        n_rings[shells] = cur.uint(shells)
        ring = 0
        while len(here := np.flatnonzero((n_rings > ring) & cur.sound)):
            count = np.ones(len(here), np.int64)
            listed = single[here] != POINT
            count[listed] = cur.uint(here[listed])
            start = cur.points(here, count, width[here])
            found.append((here, np.full(len(here), polygon), np.full(len(here), ring), start, count, cur.little[here],
                          8 * width[here]))
            ring += 1
        polygon += 1
    return parts, single, found


def _rings(column: pa.Array):
    """All rings of a batch in order: geometry, polygon and ring number, whether it bounds an area, and the vertices.

    Only x and y are read of points with more numbers. A line is a ring there and back, a point a ring that stays where it is;
    neither bounds an area.
    """
    cur = _Cursor(column)
    parts, single, found = _walk(cur)
    if not found:
        empty = np.zeros(0, np.int64)
        return parts, empty, empty, empty, empty.astype(bool), empty, np.zeros(0), np.zeros(0)
    geom, poly, ring, start, count, little, size = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ring, poly, geom))
    geom, poly, ring, start, count, little, size = (c[order] for c in (geom, poly, ring, start, count, little, size))
    bounds = single[geom] == POLYGON
    # lines there and back, points four times
    longer = np.where(bounds, count, np.where(single[geom] == POINT, 4, np.maximum(2 * count - 1, 0)))
    step, last = _ranges(longer), np.repeat(count - 1, longer)
    step = np.where(np.repeat(single[geom] == POINT, longer), 0, np.where(step > last, 2 * last - step, step))
    at = np.repeat(start, longer) + np.repeat(size, longer) * step
    raw = cur.data[at[:, None] + np.arange(16)]
    big = ~np.repeat(little, longer)
    if big.any():
        raw[big] = np.concatenate([raw[big, 7::-1], raw[big, 15:7:-1]], axis=1)
    xy = np.ascontiguousarray(raw).view("<f8")
    return parts, geom, poly, ring, bounds, longer, xy[:, 0], xy[:, 1]


def _offsets(counts):
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


@F.arrow_udf(MULTIPOLYGON_TYPE)
def wkb_to_multipolygon(column: pa.Array) -> pa.Array:
    parts, geom, poly, ring, _, count, x, y = _rings(column)
    flat = pa.array(np.column_stack([x, y]).ravel())
    pts = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(x) + 1, 2), pa.int32()), flat)
    rings = pa.ListArray.from_arrays(_offsets(count), pts)
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    per_polygon = np.bincount(first[geom] + poly, minlength=int(parts.sum()))
    polygons = pa.ListArray.from_arrays(_offsets(per_polygon), rings)
    return pa.ListArray.from_arrays(_offsets(parts), polygons, mask=column.is_null())


@F.arrow_udf(STATS)
def wkb_stats(column: pa.Array) -> pa.Array:
    """Bounding box and planar area straight from the bytes, without building vertex lists; points and lines have none."""
    _, geom, _, ring, bounds, count, x, y = _rings(column)
    return _measure(len(column), geom, ring, count, x, y, bounds)


@F.arrow_udf(T.StringType())
def wkb_problem(column: pa.Array) -> pa.Array:
    """Why a geometry can't be read, NULL if it can: to count and set aside bad rows before they end a job."""
    cur = _Cursor(column, lenient=True)
    _walk(cur)
    return pa.array(cur.problems.tolist(), pa.string())


@F.arrow_udf(STATS)
def multipolygon_stats(column: pa.Array) -> pa.Array:
    """The same from nested arrays."""
    polygons = column.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    start = points.offsets.to_numpy()[:-1]  # a point may have more than two numbers
    numbers = points.values.to_numpy(zero_copy_only=False)

    def sizes(lists):
        return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)

    parts, per_polygon, count = sizes(column), sizes(polygons), sizes(rings)
    geom = np.repeat(np.repeat(np.arange(len(column)), parts), per_polygon)
    return _measure(len(column), geom, _ranges(per_polygon), count, numbers[start], numbers[start + 1])


def _measure(n, geom, ring, count, x, y, bounds=None) -> pa.Array:
    box = [np.full(n, v) for v in (np.inf, np.inf, -np.inf, -np.inf)]
    area = np.zeros(n)
    keep = count > 0
    sign = np.where(ring == 0, 0.5, -0.5)[keep] if bounds is None else np.where(bounds, np.where(ring == 0, 0.5, -0.5), 0.0)[keep]
    geom, count = geom[keep], count[keep]
    if len(count):
        start = np.cumsum(count) - count
        np.minimum.at(box[0], geom, np.minimum.reduceat(x, start))
        np.minimum.at(box[1], geom, np.minimum.reduceat(y, start))
        np.maximum.at(box[2], geom, np.maximum.reduceat(x, start))
        np.maximum.at(box[3], geom, np.maximum.reduceat(y, start))
        dx, dy = x - np.repeat(x[start], count), y - np.repeat(y[start], count)
        nxt = np.arange(len(x)) + 1
        nxt[start + count - 1] = start
        cross = np.add.reduceat(dx * dy[nxt] - dx[nxt] * dy, start)
        np.add.at(area, geom, sign * np.abs(cross))
    empty = ~np.isfinite(box[0])
    return pa.StructArray.from_arrays(
        [pa.array(v, mask=empty) for v in (*box, area)], ["minx", "miny", "maxx", "maxy", "area_deg2"])


@F.arrow_udf(T.BinaryType())
def multipolygon_to_wkb(column: pa.Array) -> pa.Array:
    """Little-endian WKB; a single polygon is written as Polygon, anything else as MultiPolygon.

    The headers and vertices of the whole batch are scattered into one buffer. Of a point only x and y are written.
    """
    polygons = column.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    at = points.offsets.to_numpy()[:-1]
    numbers = points.values.to_numpy(zero_copy_only=False)
    xy = np.stack([numbers[at], numbers[at + 1]], axis=1).astype("<f8") if len(at) else np.zeros((0, 2), "<f8")

    def sizes(lists):
        return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)

    parts, n_rings, count = sizes(column), sizes(polygons), sizes(rings)
    valid = np.asarray(column.is_valid())
    multi = valid & (parts != 1)
    geom_of_poly = np.repeat(np.arange(len(column)), parts)
    poly_of_ring = np.repeat(np.arange(len(polygons)), n_rings)
    ring_bytes = 4 + 16 * count
    headers = 9 * np.cumsum(multi)  # of multi geometries up to and with each geometry
    ring_at = np.cumsum(ring_bytes) - ring_bytes + 9 * (poly_of_ring + 1) + headers[geom_of_poly[poly_of_ring]]
    poly_bytes = 9 + np.bincount(poly_of_ring, ring_bytes, len(polygons)).astype(np.int64)
    poly_at = np.cumsum(poly_bytes) - poly_bytes + headers[geom_of_poly]
    geom_bytes = 9 * multi + np.bincount(geom_of_poly, poly_bytes, len(column)).astype(np.int64)
    ends = np.cumsum(geom_bytes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)

    def put(where, values):
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(where), -1)
        out[where[:, None] + np.arange(raw.shape[1])] = raw

    for where, kind, n in ((poly_at, POLYGON, n_rings), ((ends - geom_bytes)[multi], MULTI, parts[multi])):
        if len(where):
            out[where] = 1
            put(where + 1, np.full(len(where), kind, "<u4"))
            put(where + 5, n.astype("<u4"))
    if len(ring_at):
        put(ring_at, count.astype("<u4"))
    if len(xy):
        put(np.repeat(ring_at + 4, count) + 16 * _ranges(count), xy)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [
        None if valid.all() else pa.array(valid).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(out)])
    return flat.cast(pa.binary())
