"""Problems of a batch of WKB geometries: one walk over all of them."""

import struct

import numpy as np
import pyarrow as pa

from rooftally.functions import wkb as W


def polygon(*sizes, kind=3, order=1):
    mark = "<" if order else ">"
    rings = b"".join(struct.pack(f"{mark}I{2 * n}d", n, *range(2 * n)) for n in sizes)
    return struct.pack(f"{mark}BII", order, kind, len(sizes)) + rings


def multi(*parts, n=None):
    return struct.pack("<BII", 1, 6, len(parts) if n is None else n) + b"".join(parts)


def batch():
    whole = [polygon(5), polygon(5, 4), multi(polygon(5), polygon(6)), multi(), polygon(4, order=0), None, struct.pack("<BI2d", 1, 1, 3.0, 4.0)]
    broken = [polygon(5, kind=9), polygon(5, kind=7003), multi(polygon(5), struct.pack("<BI2d", 1, 1, 3.0, 4.0)), multi(polygon(5), n=2 ** 32 - 1), b"", b"\x01"]
    rng = np.random.default_rng(1)
    for good in whole:
        broken += [good[:int(k)] for k in rng.integers(0, len(good), 12)] if good else []
        broken += [bytes(b ^ (1 << int(rng.integers(0, 8))) if k == at else b for k, b in enumerate(good)) for at in range(9)] if good else []
    rows = whole * 3 + broken
    return [rows[k] for k in rng.permutation(len(rows))]


def alone(value):
    try:
        W._rings(pa.array([value], pa.binary()))
    except ValueError as e:
        return str(e)


def test_a_batch_has_the_problems_of_its_rows_in_one_walk(monkeypatch):
    rows, walks = batch(), []
    want = [alone(r) for r in rows]
    assert len(set(want)) == 5
    walk, start = W._Cursor.__init__, lambda self, *a, **k: walks.append(1) or walk(self, *a, **k)
    monkeypatch.setattr(W._Cursor, "__init__", start)
    for column in (pa.array(rows, pa.binary()), pa.array([b"x", *rows], pa.binary()).slice(1)):
        assert W.wkb_problem.func(column).to_pylist() == want
    assert len(walks) == 2
