"""Leading singular values and right vectors of a triangle: Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Sweeps per value before the iteration counts as stuck.
SWEEPS = 200
#: Relative distance of squares below which vectors are made orthogonal by force.
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, f, p): r = U B p' with upper bidiagonal B of diagonal b and superdiagonal f, and orthogonal p."""
    a = np.array(r, float)
    d = a.shape[1]
    p = np.eye(d)

    def reflector(v: np.ndarray) -> np.ndarray:
        u = v.copy()
        u[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(u)
        return u / size if size > 0 else u

    for k in range(d):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], list[float]] | None:
    """One transformation of the qd array shifted by tau; None where the shift exceeds the smallest value."""
    top, side, seen = [], [], []
    d = q[0] - tau
    for k, low in enumerate(e):
        if d < 0:
            return None
        seen.append(d)
        here = d + low
        t = q[k + 1] / here if here > 0 else 0.0
        top.append(here)
        side.append(low * t)
        d = (d * t if here > 0 else q[k + 1]) - tau
    if d < 0:
        return None
    seen.append(d)
    top.append(d)
    return top, side, seen


def squared_values(b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an upper bidiagonal matrix, falling, by differential quotient-difference with shifts.

    All quantities stay positive, so that small values come out as accurately as large ones. The shift is Newton's lower bound, taken
    from an unshifted sweep, or the smaller value of the last two rows where that is no bound but still admissible.
    """
    scale = max(np.abs(b).max(initial=0.0), np.abs(f).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(b))
    out: list[float] = []
    work = [(((b / scale) ** 2).tolist(), ((f / scale) ** 2).tolist(), 0.0)]
    while work:
        q, e, base = work.pop()
        if q[0] < q[-1]:  # the iteration finds the smallest at the end
            q, e = q[::-1], e[::-1]
        left = SWEEPS * len(q)
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (base + q[k]) or e[k] <= EPS * EPS * (base + q[k + 1])), None)
            if n == 1 or cut == n - 2:
                out.append(base + q.pop())
                if n > 1:
                    e.pop()
                continue
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            left -= 1
            if left < 0:
                raise ArithmeticError("the quotient-difference iteration does not converge")
            q, e, seen = _sweep(q, e, 0.0)
            low = 0.0 if min(seen) <= 0 else 1 / sum(1 / d for d in seen)
            x, y, z = q[-2], e[-1], q[-1]
            half = (x + y + z) / 2
            guess = x * z / (half + np.sqrt(max(half * half - x * z, 0.0))) if half > 0 else 0.0
            for tau in (guess * (1 - 4 * EPS), low * (1 - 16 * n * EPS)):
                moved = _sweep(q, e, tau) if tau > 0 else None
                if moved:
                    q, e, _ = moved
                    base += tau
                    break
    return np.sort(np.array(out))[::-1] * scale * scale


def twisted_vector(b: np.ndarray, f: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for an accurate eigenvalue, from the twisted factorisation with the smallest pivot."""
    n = len(b)
    tiny = EPS * EPS * max(value, np.finfo(float).tiny)
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + b[k] * b[k]
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[k] = b[k] * f[k] / pivot
        s[k + 1] = f[k] * f[k] * (s[k] / pivot) - value
    p[n - 1] = b[n - 1] * b[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = f[k] * f[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[k] = b[k] * f[k] / pivot
        p[k] = p[k + 1] * (b[k] * b[k] / pivot) - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _apart(b: np.ndarray, f: np.ndarray, value: float, others: np.ndarray, seed: int) -> np.ndarray:
    """A unit eigenvector orthogonal to ``others``, for values too close to tell the vectors apart: inverse iteration."""
    t = np.diag(b * b + np.concatenate([[0.0], f * f])) + np.diag(b[:-1] * f, 1) + np.diag(b[:-1] * f, -1)
    z = np.random.default_rng(seed).standard_normal(len(b))
    shifted = t - value * (1 + 8 * EPS) * np.eye(len(b))
    shifted[np.diag_indices(len(b))] += EPS * value
    for _ in range(4):
        for _ in range(2):
            z = z - others.T @ (others @ z)
        z = np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=None)[0] if np.linalg.matrix_rank(shifted) < len(b) else np.linalg.solve(shifted, z / np.linalg.norm(z))
        z /= np.linalg.norm(z)
    for _ in range(2):
        z = z - others.T @ (others @ z)
        z /= np.linalg.norm(z)
    return z


def leading_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares, rows of right singular vectors) of at most ``most`` values that are not zero to rounding, falling."""
    d = r.shape[1]
    if len(r) < d:
        r = np.concatenate([r, np.zeros((d - len(r), d))])
    b, f, p = bidiagonalise(r)
    squares = squared_values(b, f)
    squares = squares[:most][squares[:most] > (d * EPS) ** 2 * squares[0]] if len(squares) else squares
    found = np.zeros((len(squares), d))
    for k, value in enumerate(squares):
        z = twisted_vector(b, f, value)
        near = found[:k][np.abs(squares[:k] - value) <= CLUSTER * squares[0]]
        if len(near):
            rest = z - near.T @ (near @ z)
            size = np.linalg.norm(rest)
            if size > 0.9:
                z = rest / size
                z -= near.T @ (near @ z)
                z /= np.linalg.norm(z)
            else:
                z = _apart(b, f, value, near, k)
        found[k] = z
    return squares, found @ p.T
