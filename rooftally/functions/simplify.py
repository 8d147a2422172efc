"""Vertex reduction of footprint outlines (Douglas-Peucker), in whole Arrow batches.

All rings of a batch are refined together: each round measures every open section of every ring at once and
splits the ones that stray further than the tolerance. A ring keeps its first vertex and at least four points,
and a polygon whose reduced rings would cross themselves or each other is left as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from rooftally.functions.geometry import MULTIPOLYGON_TYPE

CELLS = 8  # cells of the grid that an edge covers on average, at most
SMALL, PAIRS = 48, 1 << 18  # polygons of so few edges are compared together, so many pairs of edges at a time


def _distance(px, py, ax, ay, bx, by):
    """Distance from points to segments."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = np.divide((px - ax) * dx + (py - ay) * dy, length2, out=np.zeros_like(length2), where=length2 > 0)
    t = np.clip(t, 0.0, 1.0)
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def kept_vertices(x, y, sizes, tolerance) -> np.ndarray:
    """Mask of the vertices that stay, for closed rings laid end to end."""
    keep = np.zeros(len(x), bool)
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    keep[first] = keep[last] = True
    lo, hi = first, last
    depth = 0
    while True:
        open_ = hi - lo > 1
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            return keep
        inner = hi - lo - 1
        start = np.cumsum(inner) - inner
        at = np.arange(inner.sum()) - np.repeat(start, inner) + np.repeat(lo + 1, inner)
        a, b = np.repeat(lo, inner), np.repeat(hi, inner)
        dist = _distance(x[at], y[at], x[a], y[a], x[b], y[b])
        far = np.maximum.reduceat(dist, start)
        is_far = np.flatnonzero(dist == np.repeat(far, inner))
        section = np.repeat(np.arange(len(lo)), inner)[is_far]
        _, pick = np.unique(section, return_index=True)
        split_at = at[is_far[pick]]
        # the first two rounds always split, so that a ring cannot fall below a triangle
        split = (far > tolerance) | (depth < 2)
        keep[split_at[split]] = True
        lo, hi = (np.concatenate([lo[split], split_at[split]]), np.concatenate([split_at[split], hi[split]]))
        depth += 1


def _near_pairs(lowx, highx, lowy, highy) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes that share a cell of a grid: every pair that meets is among them, some more than once.

    The cells are about as large as the boxes, so the outlines of a map make a few pairs for each edge, however long and however they run.
    """
    n = len(lowx)
    size = max(2 * float(np.mean(highx - lowx + highy - lowy)), 1e-300)
    while True:
        left, right, bottom, top = (np.floor((v - base) / size).astype(np.int64) for v, base in (
            (lowx, lowx.min()), (highx, lowx.min()), (lowy, lowy.min()), (highy, lowy.min())))
        across, up = right - left + 1, top - bottom + 1
        if (across.astype(float) * up).sum() <= CELLS * n or size > 1e300:
            break
        size *= 2  # a few long edges would cover too many cells
    held = across * up
    box = np.repeat(np.arange(n), held)
    step = np.arange(len(box)) - np.repeat(np.cumsum(held) - held, held)
    cell = (left[box] + step % across[box]) * (int(top.max()) + 1) + bottom[box] + step // across[box]
    order = np.argsort(cell, kind="stable")
    cell, box = cell[order], box[order]
    at = np.arange(len(cell))
    for k in range(1, len(cell)):
        at = at[at + k < len(cell)]
        at = at[cell[at] == cell[at + k]]
        if not len(at):
            return
        for some in range(0, len(at), PAIRS):
            yield box[at[some:some + PAIRS]], box[at[some:some + PAIRS] + k]


def _crosses(x, y, ring) -> bool:
    """Do edges of a polygon's closed rings, laid end to end, meet that are no neighbours?

    Between rings only proper crossings count: a hole may touch its shell. Only edges of a common grid cell are compared.
    """
    edge = np.flatnonzero(ring[1:] == ring[:-1])
    if not len(edge):
        return False
    first = np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]]))
    closing = np.append(first[1:], len(x)) - 2  # the last edge of each ring
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    boxes = [f(v[edge], v[edge + 1]) for v in (x, y) for f in (np.minimum, np.maximum)]

    def side(a, b, p):
        return np.sign((x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a]))

    for i, j in _near_pairs(*boxes):
        i, j = edge[i], edge[j]
        one, two = side(i, i + 1, j) * side(i, i + 1, j + 1), side(j, j + 1, i) * side(j, j + 1, i + 1)
        same = ring[i] == ring[j]
        a, b = np.minimum(i, j), np.maximum(i, j)
        neighbours = same & ((b == a + 1) | ((a == first[number[a]]) & (b == closing[number[b]])))
        if np.any(np.where(same, (one <= 0) & (two <= 0) & ~neighbours, (one < 0) & (two < 0))):
            return True
    return False


def _crossing_polygons(x, y, ring, polygon) -> np.ndarray:
    """Numbers of the polygons whose rings cross; vertices of closed rings laid end to end, by polygon.

    Polygons of the same, small number of edges are compared together; the others one by one.
    """
    edge = np.flatnonzero(ring[1:] == ring[:-1])
    opens = np.concatenate([[True], ring[edge][1:] != ring[edge][:-1]])
    ring_start = np.flatnonzero(opens)
    ring_size = np.diff(np.append(ring_start, len(edge)))
    place = np.arange(len(edge)) - np.repeat(ring_start, ring_size)
    last = np.repeat(ring_size, ring_size) - 1
    numbers, start, size = np.unique(polygon[edge], return_index=True, return_counts=True)
    found = []
    for m in np.unique(size):
        own = np.flatnonzero(size == m)
        if m > SMALL:
            for p in own:
                part = polygon == numbers[p]
                if _crosses(x[part], y[part], ring[part]):
                    found.append(numbers[p:p + 1])
            continue
        i, j = np.triu_indices(m, 1)
        for at in range(0, len(own), max(1, PAIRS // max(1, len(i)))):
            some = own[at:at + max(1, PAIRS // max(1, len(i)))]
            a, b = edge[start[some][:, None] + i], edge[start[some][:, None] + j]
            ea, eb = start[some][:, None] + i, start[some][:, None] + j

            def side(u, v, q):
                return np.sign((x[v] - x[u]) * (y[q] - y[u]) - (y[v] - y[u]) * (x[q] - x[u]))

            one, two = side(a, a + 1, b) * side(a, a + 1, b + 1), side(b, b + 1, a) * side(b, b + 1, a + 1)
            same = ring[a] == ring[b]
            neighbours = same & ((place[eb] == place[ea] + 1) | ((place[ea] == 0) & (place[eb] == last[eb])))
            hit = np.where(same, (one <= 0) & (two <= 0) & ~neighbours, (one < 0) & (two < 0)).any(axis=1)
            found.append(numbers[some[hit]])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def simplifier(tolerance: float) -> Callable[[Column], Column]:
    """UDF that simplifies a MultiPolygon column with the given tolerance (in coordinate units)."""
    if not tolerance > 0:
        raise ValueError(f"tolerance must be positive: {tolerance!r}")

    @F.arrow_udf(MULTIPOLYGON_TYPE)
    def simplify(column: pa.Array) -> pa.Array:
        polygons = column.flatten()
        rings = polygons.flatten()
        points = rings.flatten()
        at, numbers = points.offsets.to_numpy()[:-1], points.values.to_numpy(zero_copy_only=False)
        xy = np.stack([numbers[at], numbers[at + 1]], axis=1) if len(at) else np.zeros((0, 2))
        x, y = xy[:, 0], xy[:, 1]
        sizes = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            return column
        keep = np.ones(len(x), bool)
        if (sizes > 0).all():
            keep = kept_vertices(x, y, sizes, tolerance)
        start = np.cumsum(sizes) - sizes
        short = np.flatnonzero(np.add.reduceat(keep.astype(np.int64), start) < 4)
        for r in short:
            keep[start[r]:start[r] + sizes[r]] = True
        # rings of a polygon lie end to end
        counts = polygons.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.append(start, len(x))[np.cumsum(np.nan_to_num(counts).astype(np.int64))]
        begins = np.append(0, ends[:-1])
        changed = np.append(0, np.cumsum(~keep))
        touched = np.flatnonzero(changed[ends] > changed[begins])
        if len(touched):
            polygon = np.repeat(np.arange(len(ends)), ends - begins)
            ring = np.repeat(np.arange(len(sizes)), sizes)
            part = np.zeros(len(ends), bool)
            part[touched] = True
            seen = keep & part[polygon]
            for p in _crossing_polygons(x[seen], y[seen], ring[seen], polygon[seen]):
                keep[begins[p]:ends[p]] = True
        left = np.add.reduceat(keep.astype(np.int64), start)
        pts = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * int(keep.sum()) + 1, 2), pa.int32()),
                                       pa.array(xy[keep].ravel()))

        def nest(lengths, values, mask=None):
            counts = np.nan_to_num(lengths.to_numpy(zero_copy_only=False)).astype(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                            values, mask=mask)

        out_rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), pts)
        return nest(column.value_lengths(), nest(polygons.value_lengths(), out_rings), column.is_null())

    return simplify
