"""Singular values and right singular vectors of a small matrix by qd transforms.

Householder reflections make the matrix bidiagonal. The dqds iteration finds its
singular values with high relative accuracy: differential quotient-difference
steps with shifts below the smallest value left. For each value a twisted
factorisation of the tridiagonal ``B^T B - s I``, one half by the stationary and
one by the progressive transform, gives the vector; values too close together
for that have their vectors made orthogonal in order, by inverse iteration where
too little is left of the first.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: Values of a relative distance below this have their vectors made orthogonal.
CLOSE = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)`` of a square matrix: ``r = u B v^T``, B with diagonal a and b above it."""
    m = np.array(r, float)
    n = len(m)
    v = np.eye(n)

    def reflector(x):
        w = x.copy()
        size = np.linalg.norm(x)
        w[0] += np.copysign(size, x[0])
        length = np.linalg.norm(w)
        return w / length if length else None

    for k in range(n):
        w = reflector(m[k:, k])
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k + 2 < n:
            w = reflector(m[k, k + 1 :])
            if w is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float):
    """One transform ``(q', e', smallest, last)`` of its differences; a negative one means too large a shift."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    smallest = d
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if new_q[k] == 0.0:
            new_e[k], d = 0.0, q[k + 1] - shift
        else:
            t = q[k + 1] / new_q[k]
            new_e[k] = e[k] * t
            d = d * t - shift
        smallest = min(smallest, d)
    new_q[n - 1] = d
    return new_q, new_e, smallest, d


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, ascending in the order found."""
    found: list[float] = []
    # parts of the matrix still to do, each with the shifts taken from it so far
    parts = [([x * x for x in a.tolist()], [x * x for x in b.tolist()], 0.0)]
    limit = (10 * EPS) ** 2
    while parts:
        q, e, taken = parts.pop()
        rounds = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + taken)
                break
            if e[n - 2] <= limit * (taken + q[n - 1]) or (taken == 0.0 and q[n - 1] == 0.0 and e[n - 2] == 0.0):
                found.append(q.pop() + taken)
                e.pop()
                rounds = 0
                continue
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= limit * taken or e[k] <= EPS * EPS * min(q[k], q[k + 1])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], taken))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[n - 1] / 4:
                q, e = q[::-1], e[::-1]  # the same values from the other end
            rounds += 1
            # smallest value of the last two rows and columns, a good guess from below in time
            x, y, z = q[n - 2] + (e[n - 3] if n > 2 else 0.0), e[n - 2], q[n - 1]
            total, product = x + y + z, x * z
            root = np.sqrt(max(0.0, total * total / 4 - product))
            shift = product / (total / 2 + root) if total > 0 else 0.0
            shift *= 1 - 4 * EPS
            for attempt in range(60):
                new_q, new_e, smallest, last = _dqds_step(q, e, shift)
                if smallest >= 0 or shift == 0.0:
                    break
                # a failure in the last place alone tells by how much the shift is too large
                late = shift + last if attempt == 0 and last == smallest else 0.0
                shift = max(late * (1 - 4 * EPS), shift / 2 if attempt < 58 else 0.0)
            q, e, taken = [max(x, 0.0) for x in new_q], new_e, taken + shift
            if rounds > 1000:
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.maximum(found, 0.0))


def _twisted(d: np.ndarray, low: np.ndarray, value: float):
    """Both factorisations of ``L D L^T - value``: ``(up, down, gamma)``, multipliers and twist elements."""
    n = len(d)
    guard = max(EPS * EPS * abs(value), TINY)
    s, p = np.empty(n), np.empty(n)
    up, down = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        pivot = d[k] + s[k]
        pivot = pivot if abs(pivot) > guard else -guard
        up[k] = d[k] * low[k] / pivot
        s[k + 1] = up[k] * low[k] * s[k] - value
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > guard else -guard
        t = d[k] / pivot
        down[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    return up, down, s + p + value


def _vector(up: np.ndarray, down: np.ndarray, twist: int) -> np.ndarray:
    n = len(up) + 1
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -down[k] * z[k]
    return z / np.linalg.norm(z)


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``B^T B`` for ascending ``values``, as columns; no entry of a or b is zero."""
    n = len(a)
    if n == 1:
        return np.ones((1, len(values)))
    d, low = a * a, b / a[:-1]
    size = (np.abs(a).max() + np.abs(b).max()) ** 2
    drawn = np.random.default_rng(n)
    out = np.zeros((n, len(values)))

    def made_orthogonal(z, others):
        left = 1.0
        for _ in range(3):
            z = z - others @ (others.T @ z)
            length = np.linalg.norm(z)
            z, left = z / max(length, TINY), left * length
        return z, left

    def error(z, value):
        rows = a * z
        rows[:-1] += b * z[1:]
        image = a * rows
        image[1:] += b * rows[:-1]
        return np.linalg.norm(image - value * z) / size

    first = 0
    for k, value in enumerate(values):
        if k and value - values[k - 1] > CLOSE * value and value > n * EPS * values[-1]:
            first = k
        up, down, gamma = _twisted(d, low, value)
        others = out[:, first:k]
        z, length = made_orthogonal(_vector(up, down, int(np.argmin(np.abs(gamma)))), others)
        best = (error(z, value) if length > 0.1 else np.inf, z)
        for _ in range(5):
            if best[0] < 8 * n * EPS:
                break
            shifted = np.diag(d + np.r_[0.0, b * b] - value) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            z = drawn.standard_normal(n)
            for _ in range(3):
                z = made_orthogonal(z, others)[0]
                z = np.linalg.solve(shifted + 4 * EPS * size * np.eye(n), z)
                z = made_orthogonal(z / np.linalg.norm(z), others)[0]
            best = min(best, (error(z, value), z), key=lambda x: x[0])
        out[:, k] = best[1]
    return out


def _zeros_apart(a: np.ndarray, b: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same matrix with each diagonal entry of at most ``least`` made zero and rotated apart from the others."""
    zeros = np.flatnonzero(np.abs(a) <= least)
    if not zeros.size:
        return a, b, v
    m, v = np.diag(a) + np.diag(b, 1), v.copy()
    for k in zeros.tolist():
        if abs(m[k, k]) > least:  # an earlier zero changed it
            continue
        m[k, k] = 0.0
        for j in range(k + 1, len(a)):  # the rest of the row, into the rows below
            size = np.hypot(m[j, j], m[k, j])
            if m[k, j] == 0.0:
                break
            c, s = m[j, j] / size, m[k, j] / size
            m[j], m[k] = c * m[j] + s * m[k], c * m[k] - s * m[j]
            m[k, j] = 0.0
        for j in range(k - 1, -1, -1):  # the rest of the column, into the columns before
            size = np.hypot(m[j, j], m[j, k])
            if m[j, k] == 0.0:
                break
            c, s = m[j, j] / size, m[j, k] / size
            for x in (m, v):
                x[:, j], x[:, k] = c * x[:, j] + s * x[:, k], c * x[:, k] - s * x[:, j]
            m[j, k] = 0.0
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def right_vectors(r: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(squares, vectors)``: squared singular values, falling, and their right vectors as columns.

    Values that are zero beside the largest get any vectors that complete the others.
    """
    n = r.shape[1]
    count = n if count is None else min(count, n)
    scale = float(np.abs(r).max()) if r.size else 0.0
    if not scale:
        return np.zeros(count), np.eye(n)[:, :count]
    a, b, v = bidiagonal(r / scale)
    least = EPS * (np.abs(a).max() + (np.abs(b).max() if n > 1 else 0.0))
    a, b, v = _zeros_apart(a, b, v, least)
    cuts = np.flatnonzero(np.abs(b) <= least) + 1
    edges = [0, *cuts.tolist(), n]
    every, columns = [], []
    for low, high in zip(edges, edges[1:]):
        values = squares(a[low:high], b[low : high - 1])
        vectors = np.zeros((n, high - low))
        vectors[low:high] = _block_vectors(a[low:high], b[low : high - 1], values)
        every.append(values)
        columns.append(vectors)
    values, vectors = np.concatenate(every), np.concatenate(columns, axis=1)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order] * scale * scale, v @ vectors[:, order]
