"""Exact overlap of small polygons with rational numbers, as a check on the engine's arithmetic."""

from fractions import Fraction


def rings_of(mp):
    return [[(Fraction(x), Fraction(y)) for x, y in ring] for polygon in mp for ring in polygon]


def segments(mp):
    return [(a, b) for ring in rings_of(mp) for a, b in zip(ring, ring[1:]) if a != b]


def _turn(a, b, p):
    v = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return (v > 0) - (v < 0)


def segments_meet(s, t):
    (a, b), (c, d) = s, t
    if (max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0])
            or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1])):
        return False
    return _turn(a, b, c) * _turn(a, b, d) <= 0 and _turn(c, d, a) * _turn(c, d, b) <= 0


def inside_spans(mp, x):
    """Heights between which the vertical line at x is inside (x is no vertex)."""
    ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
                for a, b in segments(mp) if min(a[0], b[0]) < x < max(a[0], b[0]))
    return list(zip(ys[::2], ys[1::2]))


def contains(mp, p):
    hits = 0
    for a, b in segments(mp):
        if (a[0] <= p[0]) != (b[0] <= p[0]) and a[1] + (p[0] - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) > p[1]:
            hits += 1
    return hits % 2 == 1


def overlap_area(p, q):
    xs = {v[0] for mp in (p, q) for ring in rings_of(mp) for v in ring}
    for a, b in segments(p):
        for c, d in segments(q):
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                if 0 <= t <= 1:
                    xs.add(a[0] + t * (b[0] - a[0]))
    xs = sorted(xs)
    total = Fraction(0)
    for l, r in zip(xs, xs[1:]):
        x = (l + r) / 2
        for lo, hi in inside_spans(p, x):
            for lo2, hi2 in inside_spans(q, x):
                total += max(Fraction(0), min(hi, hi2) - max(lo, lo2)) * (r - l)
    return total


def intersects(p, q):
    sp, sq = segments(p), segments(q)
    return (any(segments_meet(s, t) for s in sp for t in sq)
            or contains(q, sp[0][0]) or contains(p, sq[0][0])
            or any(contains(p, ring[0]) for ring in rings_of(q)) or any(contains(q, ring[0]) for ring in rings_of(p)))
