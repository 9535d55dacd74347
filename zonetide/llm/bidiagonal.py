"""Singular values and right singular vectors of a small square matrix.

Householder reflections make it upper bidiagonal. dqds (differential quotient-difference with shifts) finds the squares of
the bidiagonal's singular values, small ones to the same relative accuracy as large ones. Twisted factorisations of
B'B - s I, from a factorisation from the top and one from the bottom, give each vector: they meet where they leave the
least remainder, and from there the vector is read off upwards and downwards.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: Squared singular values closer than this, relative to the larger, count as a cluster.
CLUSTER = 1e-3


def bidiagonalised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of a square ``a`` = U B V'."""
    a = np.array(a, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
            return np.zeros_like(x), x[0] if len(x) else 0.0
        x = x / scale
        norm = math.copysign(float(np.linalg.norm(x)), x[0])
        w = x.copy()
        w[0] += norm
        return w / np.linalg.norm(w), -norm * scale

    for k in range(n):
        w, head = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        a[k, k] = head
        a[k + 1:, k] = 0
        if k + 2 <= n:
            w, head = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            a[k, k + 1] = head
            a[k, k + 2:] = 0
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step; None where the shift was beyond the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > TINY else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if new_q[k] > TINY else q[k + 1] - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, max(least, 0.0)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling. The matrix is taken apart where an off-diagonal entry
    no longer counts; shifts come from a lower bound of the smallest value left and are halved if they were too large."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    # (q, e, sum of the shifts so far)
    pending = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in upper / scale], 0.0)]
    while pending:
        q, e, moved = pending.pop()
        guess = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            cut = next((k for k in range(n - 2, -1, -1)
                        if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1])) or e[k] <= TINY), None)
            if cut is not None:
                if cut == n - 2:
                    found.append(q[-1] + moved)
                    q, e, guess = q[:-1], e[:-1], 0.0
                else:
                    pending.append((q[:cut + 1], e[:cut], moved))
                    q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
                continue
            # The last two rows' own smaller value is near the smallest one of all.
            total, product = q[-2] + q[-1] + e[-1], q[-2] * q[-1]
            root = math.sqrt((q[-2] - q[-1]) ** 2 + e[-1] * (e[-1] + 2 * (q[-2] + q[-1])))
            corner = 2 * product / (total + root)
            shift = min(corner * (1 - 1e-3), guess) if guess > 0 else corner * 0.5
            step = None
            while step is None:
                step = _transformed(q, e, shift)
                if step is None:
                    shift = shift / 4 if shift > EPS * EPS * (moved + corner) else 0.0
            q, e, least = step
            moved += shift
            guess = least if least > 0 else 0.0
            if q[-1] < q[0] * 1e-3 or q[0] >= q[-1]:
                continue
            # The smallest values are found at the lower end; a matrix graded the other way is turned round.
            q, e = _turned(q, e)
    return np.sort(np.array(found) * scale * scale)[::-1]


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same matrix with rows and columns in reverse order."""
    n = len(q)
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    # B B' of the reversed matrix is B'B read from the bottom: an upper factor turned into a lower one.
    d = q[-1]
    for k in range(n - 1, 0, -1):
        i = n - 1 - k
        out_q[i] = d + e[k - 1]
        ratio = q[k - 1] / out_q[i] if out_q[i] > TINY else 0.0
        out_e[i] = e[k - 1] * ratio
        d = d * ratio if out_q[i] > TINY else q[k - 1]
    out_q[-1] = d
    return out_q, out_e


def _twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, choice: int) -> np.ndarray:
    """The eigenvector of B'B for ``value`` from the twisted factorisation with the ``choice``-th least remainder."""
    n = len(diagonal)
    tiny = EPS * EPS * max(value, EPS * EPS)  # pivots that vanish; the matrix is scaled to about 1
    # B'B = L D L' with D = diagonal^2 and L = upper / diagonal, written without divisions by the diagonal.
    off = diagonal[:-1] * upper
    down, up = np.zeros(n), np.zeros(n)
    s = -value
    stationary = np.zeros(n)
    for k in range(n):
        stationary[k] = s
        down[k] = diagonal[k] ** 2 + s
        if abs(down[k]) < tiny:
            down[k] = -tiny
        if k < n - 1:
            s = s / down[k] * upper[k] ** 2 - value
    p = diagonal[-1] ** 2 - value
    progressive = np.zeros(n)
    for k in range(n - 1, -1, -1):
        progressive[k] = p
        if k == 0:
            break
        up[k] = upper[k - 1] ** 2 + p
        if abs(up[k]) < tiny:
            up[k] = -tiny
        p = p / up[k] * diagonal[k - 1] ** 2 - value
    remainder = np.abs(stationary + progressive + value)
    at = int(np.argsort(remainder, kind="stable")[min(choice, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -off[k] / down[k] * z[k + 1]
    for k in range(at + 1, n):
        z[k] = -off[k - 1] / up[k] * z[k - 1]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def right_singular(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values falling, right singular vectors as columns) of a square matrix.

    Vectors of clustered values are made orthogonal to those before them; where nothing is left of one, the next twist is
    taken, so that equal values get an orthogonal basis of their space.
    """
    n = len(a)
    diagonal, upper, v = bidiagonalised(a)
    values = dqds(diagonal, upper)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0)) or 1.0
    vectors = np.zeros((n, n))
    for number, value in enumerate(values):
        first = number
        while first and values[first - 1] - values[first] <= CLUSTER * values[first - 1]:
            first -= 1
        near = vectors[:, first:number]
        for choice in range(n + 1):
            if choice < n:
                z = _twisted(diagonal / scale, upper / scale, value / scale ** 2, choice)
            else:  # nothing but rounding was left: any direction not taken yet
                z = np.eye(n)[np.argmin((vectors[:, :number] ** 2).sum(axis=1))]
                near = vectors[:, :number]
            left = z - near @ (near.T @ z)
            left -= near @ (near.T @ left)
            size = float(np.linalg.norm(left))
            if size > 0.1:
                vectors[:, number] = left / size
                break
    return values, v @ vectors
