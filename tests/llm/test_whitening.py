import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rooftally.llm import whitening as W
from rooftally.llm.bidiagonal import bidiagonalise, leading_directions, squared_values

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def brute(rows):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), by the covariance's eigenvectors."""
    sound = [(i, [float(c) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in sound]
    fit = sorted({tuple(v) for _, v in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, v in xs:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for k in range(min(4, len(e))):
            if e[-1 - k] > 1e-20 * e[-1]:
                out[i, k + 1] = (n, dev, abs((np.array(v) - np.array(sums) / n) @ vectors[:, -1 - k]) / e[-1 - k] ** 0.5, e[-1 - k] / e.sum())
    return out


def check(found, expected):
    assert {(r.vec_id, r.component) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        n, dev, white, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.whitened) == pytest.approx(white, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_query_matches_brute_force(spark):
    from rooftally.llm.queries import op11_whitening

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op11_whitening(spark, sf).collect(), brute(rows))


def test_rows_that_take_no_part_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(c) for c in rng.normal(size=5)], "x", k) for k in range(40)]
    rows += [(100, rows[0][1], None, 1), (101, rows[0][1], None, 1), (102, [-0.0, 0.0, -1e-9, 0.5, 0.25], "", 0)]
    odd = [(200, None, "", 0), (201, [], "", 0), (202, [1.0, None, 0.0, 0.0, 0.0], "", 0), (203, [float("nan")] * 5, "", 0),
           (204, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", 0), (205, [1.0, 2.0], "", 0)]
    found = W.whitened_components(spark.createDataFrame(rows + odd, SCHEMA).repartition(3)).collect()
    check(found, brute(rows))
    first = {r.vec_id: r.whitened for r in found if r.component == 1}
    assert first[0] == first[100] == first[101]


def test_no_rows_one_row_and_constant_rows(spark):
    for rows in ([], [(1, [0.5, 0.25], "", 0)], [(k, [0.5, 0.25], "", 0) for k in range(5)], [(1, None, "", 0)]):
        found = W.whitened_components(spark.createDataFrame(rows, SCHEMA))
        assert found.collect() == [] and found.columns[:3] == ["vec_id", "component", "n"]


def test_null_ids_and_fewer_directions_than_asked_for(spark):
    rows = [(None, [0.1, 0.0, 0.0], "", 0), (2, [0.9, 0.0, 0.0], "", 0), (3, [0.4, 0.0, 0.0], "", 0)]
    found = W.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    check(found, brute(rows))
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def test_large_entries_are_exact_or_null(spark):
    rows = [(k, [1e15 * (k + 1), float(k % 3)], "", 0) for k in range(5)]
    found = W.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int")).collect()
    expected = brute(rows)
    assert all(r.deviation == (expected[r.vec_id, 1][1] if expected[r.vec_id, 1][1] < 2 ** 63 else None) for r in found)
    huge = W.whitened_components(spark.createDataFrame([(1, [3e38, 1.0], "", 0), (2, [-3e38, 2.0], "", 0)], SCHEMA)).collect()
    assert len(huge) == 2 and abs(huge[0].whitened) == pytest.approx(1)


def test_equal_variances(spark):
    rows = [(2 * k + s, [(0.5 if s else -0.5) if j == k else 0.0 for j in range(6)], "", 0) for k in range(6) for s in (0, 1)]
    found = W.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 48 and all(r.explained == pytest.approx(1 / 6) and r.identity_error < 1e-9 for r in found)


def test_many_blocks_fold_to_one_triangle():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((7000, 9))
    blocks = np.array_split(rows, 13)
    one = np.zeros((0, 9))
    for b in blocks:
        one = W.fold(one, W.fold(np.zeros((0, 9)), b))
    assert np.allclose(one.T @ one, rows.T @ rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 20), st.integers(0, 10 ** 6), st.sampled_from(["plain", "graded", "rank", "clusters", "whole"]))
def test_solver_on_any_triangle(d, n, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, d))
    if kind == "graded":
        a *= np.logspace(0, -8, d)
    elif kind == "rank":
        a = np.outer(a[:, 0], a[0])
    elif kind == "clusters":
        a = np.linalg.qr(rng.standard_normal((d, d)))[0] * (1 + 1e-9 * rng.standard_normal(d))
    elif kind == "whole":
        a = np.round(a)
    r = np.linalg.qr(a, mode="r")
    square = np.concatenate([r, np.zeros((d - len(r), d))])
    exact = np.linalg.svd(square, compute_uv=False) ** 2
    b, f, p = bidiagonalise(square)
    assert np.allclose(p @ p.T, np.eye(d)) and np.allclose(squared_values(b, f), exact, atol=1e-13 * max(exact[0], 1e-300))
    squares, v = leading_directions(r, 4)
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-9) and len(v) <= 4
    assert np.allclose(v @ (a.T @ a), squares[:, None] * v, atol=1e-10 * max(exact[0], 1e-300))
    assert len(v) >= min(4, int((exact > 1e-20 * exact[0]).sum())) if exact[0] > 0 else len(v) == 0
