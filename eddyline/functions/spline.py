"""Global splines of odd degree through an axis' nodes, in numpy, for tasks.

Knots leave out the nodes next to the ends (not-a-knot), so n nodes have n coefficients. The basis at the nodes is a
banded matrix that is totally positive: elimination without pivoting is stable and touches the band only.
"""

from __future__ import annotations

import numpy as np

DEGREES = {"cubic": 3, "quintic": 5}


def knots(x: np.ndarray, degree: int) -> np.ndarray:
    if len(x) <= degree:
        raise ValueError(f"{len(x)} nodes are too few for degree {degree}")
    cut = (degree + 1) // 2
    return np.concatenate([[x[0]] * (degree + 1), x[cut:-cut], [x[-1]] * (degree + 1)])


def basis(x: np.ndarray, degree: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of the degree + 1 coefficients that each q needs, their weights (degree + 1, n)); q within the nodes."""
    t = knots(x, degree)
    at = np.clip(np.searchsorted(t, q, "right") - 1, degree, len(x) - 1)
    w = np.zeros((degree + 1, len(q)))
    w[0] = 1
    for d in range(1, degree + 1):
        carried = np.zeros(len(q))
        for r in range(d):
            right, left = t[at + r + 1], t[at + r + 1 - d]
            part = w[r] / (right - left)
            w[r] = carried + (right - q) * part
            carried = (q - left) * part
        w[d] = carried
    return at - degree, w


def coefficients(x: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """Of the spline through ``values`` (n, ...) at the nodes ``x`` along the first axis, all lines at once."""
    n, (first, w) = len(x), basis(x, degree, x)
    band = np.zeros((n, 2 * degree + 1))  # entry (i, i + d) lies at (i, degree + d)
    for r in range(degree + 1):
        band[np.arange(n), first + r - np.arange(n) + degree] = w[r]
    out = np.array(values, float)
    for i in range(n):
        for below in range(i + 1, min(i + degree + 1, n)):
            factor = band[below, degree + i - below] / band[i, degree]
            if factor:
                reach = min(degree, n - 1 - i)
                band[below, degree + i - below : degree + i - below + reach + 1] -= factor * band[i, degree : degree + reach + 1]
                out[below] -= factor * out[i]
    for i in range(n - 1, -1, -1):
        for right in range(i + 1, min(i + degree + 1, n)):
            out[i] -= band[i, degree + right - i] * out[right]
        out[i] /= band[i, degree]
    return out
