"""Interpolation on a few nodes, as Column expressions and as numpy twins that share their names.

The monotone cubic takes four nodes: derivatives at the middle two are weighted harmonic means of the secants
beside them, 0 where those change sign, and the Hermite cubic between them is evaluated. A NaN anywhere in
the stencil is a NaN.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _slope(sa: Column, sb: Column, ha: Column, hb: Column) -> Column:
    same = sa * sb > 0
    one = F.lit(1.0)
    return F.when(same, 3 * (ha + hb) / ((2 * hb + ha) / F.when(same, sa).otherwise(one) + (hb + 2 * ha) / F.when(same, sb).otherwise(one))).otherwise(F.lit(0.0))


def pchip4(x: list[Column], v: list[Column], q: Column) -> Column:
    """Value at ``q`` between the second and third of four nodes; nodes rise strictly."""
    h = [x[i + 1] - x[i] for i in range(3)]
    s = [(v[i + 1] - v[i]) / h[i] for i in range(3)]
    d1, d2 = _slope(s[0], s[1], h[0], h[1]), _slope(s[1], s[2], h[1], h[2])
    a = (q - x[1]) / h[1]
    b = 1 - a
    value = v[1] * (1 + 2 * a) * b * b + v[2] * (3 - 2 * a) * a * a + h[1] * (d1 * a * b * b - d2 * a * a * b)
    bad = F.isnan(v[0]) | F.isnan(v[1]) | F.isnan(v[2]) | F.isnan(v[3])
    return F.when(bad, F.lit(float("nan"))).otherwise(value)


def pchip4_np(x: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for arrays: nodes (4, ...) and values (4, ...)."""
    h, s = np.diff(x, axis=0), np.diff(v, axis=0) / np.diff(x, axis=0)

    def slope(sa, sb, ha, hb):
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 3 * (ha + hb) / ((2 * hb + ha) / sa + (hb + 2 * ha) / sb)
        return np.where(sa * sb > 0, d, 0.0)

    d1, d2 = slope(s[0], s[1], h[0], h[1]), slope(s[1], s[2], h[1], h[2])
    return np.where(np.isnan(v).any(0), np.nan, hermite(x[1], h[1], v[1], v[2], d1, d2, q))


def hermite(x1: np.ndarray, h: np.ndarray, v1: np.ndarray, v2: np.ndarray, d1: np.ndarray, d2: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cubic of two values and slopes, ``h`` apart."""
    a = (q - x1) / h
    b = 1 - a
    return v1 * (1 + 2 * a) * b * b + v2 * (3 - 2 * a) * a * a + h * (d1 * a * b * b - d2 * a * a * b)


def end_slope(h0: np.ndarray, h1: np.ndarray, m0: np.ndarray, m1: np.ndarray) -> np.ndarray:
    """One-sided derivative at an axis' end, by the three-point rule that keeps the shape."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    d = np.where(np.sign(d) != np.sign(m0), 0.0, d)
    return np.where((np.sign(m0) != np.sign(m1)) & (np.abs(d) > 3 * np.abs(m0)), 3 * m0, d)


def midpoint_weights(t: list[float]) -> list[float]:
    """Lagrange weights of four times for the middle of the second and third; (-1, 9, 9, -1) / 16 if even."""
    q = (t[1] + t[2]) / 2
    out = []
    for i in range(4):
        w = 1.0
        for j in range(4):
            if j != i:
                w *= (q - t[j]) / (t[i] - t[j])
        out.append(w)
    return out


def midpoint_weight_columns(t: list[Column]) -> list[Column]:
    q, out = (t[1] + t[2]) / 2, []
    for i in range(4):
        w = F.lit(1.0)
        for j in range(4):
            if j != i:
                w = w * (q - t[j]) / (t[i] - t[j])
        out.append(w)
    return out


def linear(x0: Column, v0: Column, x1: Column, v1: Column, q: Column) -> Column:
    """Between two nodes; the first value where they coincide."""
    width = x1 - x0
    return F.when(width == 0, v0).otherwise(v0 + (v1 - v0) * (q - x0) / F.when(width != 0, width))


def searchsorted(edges: Column, v: Column) -> Column:
    """How many of the sorted ``edges`` are not above ``v``."""
    return F.size(F.filter(edges, lambda e: e <= v))
