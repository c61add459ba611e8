"""A snapshot's grid and the interpolation of values on a part of it, in numpy, for tasks.

A grid has three axes of nodes. Spherical ones are radius (perhaps transformed), polar angle or its cosine, and
azimuth: beyond a pole the mirror row half a turn around continues the field, beyond the seam its other side.
Cartesian ones end at their first and last nodes. A block holds a field's values on a box of the grid, ghosts
included; ``Block.at`` says for each point its value, NaN outside the grid, and whether the box was too small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from eddyline.functions.spline import DEGREES, basis
from eddyline.functions.stencil import end_slope, hermite, pchip4_np

METHODS = ("pchip", "linear", "slinear", "nearest", "regular_pchip", *DEGREES)
#: Nodes that a stencil takes below and above a cell's lower node.
BELOW, ABOVE = 1, 2
GHOSTS = 3


@dataclass(frozen=True)
class Grid:
    """Axes as tuples of node positions; the first of a spherical grid is the radius as it is."""

    axes: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]
    spherical: bool = True
    polar: str = "theta"
    node_centred: bool = False
    transform: str | None = None
    scale: float | None = None

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(map(len, self.axes))

    def ghosts(self, axis: int) -> int:
        return GHOSTS if self.spherical and axis else 0

    def transformed(self, r: np.ndarray) -> np.ndarray:
        if self.transform in (None, "none"):
            return r
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(r > 0, np.log10(np.where(r > 0, r, 1)), np.nan) if self.transform == "log" else np.arcsinh(r / self.scale)

    def nodes(self, axis: int) -> np.ndarray:
        """Positions with ghosts, evenly spaced beyond the ends."""
        x = np.array(self.axes[axis], float)
        if axis == 0 and self.spherical:
            x = self.transformed(x)
        g = self.ghosts(axis)
        step = np.arange(1, g + 1) * (x[1] - x[0]) if g else np.zeros(0)
        return np.concatenate([x[0] - step[::-1], x, x[-1] + step])

    def coordinates(self, p: np.ndarray) -> np.ndarray:
        """Grid coordinates (3, n) of Cartesian positions (3, n)."""
        if not self.spherical:
            return p
        r = np.sqrt((p * p).sum(0))
        mu = np.clip(p[2] / np.where(r == 0, 1, r), -1, 1)
        phi = np.mod(np.arctan2(p[1], p[0]), 2 * np.pi)
        return np.stack([self.transformed(r), mu if self.polar == "mu" else np.arccos(mu), phi])

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the node below each point on each axis, ghosts counted from below 0; whether it is on the grid)."""
        index, inside = np.zeros(q.shape, np.int64), np.ones(q.shape[1], bool)
        for a in range(3):
            x, g = self.nodes(a), self.ghosts(a)
            ok = np.isfinite(q[a]) & (q[a] >= x[0]) & (q[a] <= x[-1])
            at = np.searchsorted(x, np.where(ok, q[a], x[0]), "right") - 1
            index[a] = np.clip(at, 0, len(x) - 2) - g
            inside &= ok
        return index, inside


def column_cubic(x: np.ndarray, v: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The monotone cubic of a whole axis between the second and third of four nodes; where the axis begins with the
    second (``first``) or ends with the third (``last``) the slope there is the one-sided one."""
    h, s = np.diff(x, axis=0), np.diff(v, axis=0) / np.diff(x, axis=0)

    def inner(sa, sb, ha, hb):
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 3 * (ha + hb) / ((2 * hb + ha) / sa + (hb + 2 * ha) / sb)
        return np.where(sa * sb > 0, d, 0.0)

    both = first & last
    d1 = np.where(both, s[1], np.where(first, end_slope(h[1], h[2], s[1], s[2]), inner(s[0], s[1], h[0], h[1])))
    d2 = np.where(both, s[1], np.where(last, end_slope(h[1], h[0], s[1], s[0]), inner(s[1], s[2], h[1], h[2])))
    out = hermite(x[1], h[1], v[1], v[2], d1, d2, q)
    bad = np.isnan(v[1]) | np.isnan(v[2]) | (np.isnan(v[0]) & ~first) | (np.isnan(v[3]) & ~last)
    return np.where(bad, np.nan, out)


@dataclass
class Block:
    """Values (keys, i, j, k) of a box that begins at ``origin`` (ghosts below 0)."""

    grid: Grid
    origin: tuple[int, int, int]
    values: np.ndarray

    def at(self, q: np.ndarray, method: str = "pchip") -> tuple[np.ndarray, np.ndarray]:
        """(values (keys, n) at grid coordinates (3, n), which points are on the grid but need cells beyond the box). The
        block holds values or, for splines, coefficients."""
        if method in DEGREES:
            return self._spline(q, DEGREES[method])
        grid, n = self.grid, q.shape[1]
        cell, inside = grid.cells(q)
        out, stray = np.full((len(self.values), n), np.nan), np.zeros(n, bool)
        axes = [grid.nodes(a) for a in range(3)]
        if method == "nearest":
            for a in range(3):
                lower = axes[a][cell[a] + grid.ghosts(a)]
                cell[a] += np.where(q[a] - lower > axes[a][cell[a] + grid.ghosts(a) + 1] - q[a], 1, 0)
        low, high = {"pchip": (BELOW, ABOVE), "regular_pchip": (BELOW, ABOVE), "nearest": (0, 0)}.get(method, (0, 1))
        take, edge = [], []
        for a in range(3):
            full, g, size = len(axes[a]), grid.ghosts(a), self.values.shape[a + 1]
            want = cell[a] + np.arange(-low, high + 1)[:, None]  # nodes, ghosts below 0
            begins, ends = cell[a] == -g, cell[a] + 1 == full - g - 1
            if low:
                soft = a == 0 or method == "regular_pchip"  # an end slope stands in for the node that lacks
                if not soft:
                    inside &= ~(begins | ends)
                want = np.clip(want, -g, full - g - 1)
            local = want - self.origin[a]
            stray |= inside & ((local < 0) | (local >= size)).any(0)
            take.append((want, np.clip(local, 0, size - 1)))
            edge.append((begins, ends))
        ok = np.flatnonzero(inside & ~stray)
        if not len(ok):
            return out, stray
        (wi, li), (wj, lj), (wk, lk) = ((w[:, ok], m[:, ok]) for w, m in take)
        v = self.values[:, li[:, None, None], lj[None, :, None], lk[None, None, :]]  # keys, i, j, k, n
        if method == "nearest":
            out[:, ok] = v[:, 0, 0, 0]
            return out, stray
        v = np.moveaxis(v, 0, 3)  # i, j, k, keys, n
        for a, w in enumerate((wi, wj, wk)):
            x = axes[a][w + grid.ghosts(a)]
            if low:
                first, last = (e[ok] for e in edge[a])
                x = x.copy()  # the node that lacks: any place beyond
                x[0], x[3] = np.where(first, x[1] - 1, x[0]), np.where(last, x[2] + 1, x[3])
            x = x.reshape(len(x), *[1] * (v.ndim - 2), -1)
            if not low:
                part = (q[a, ok] - x[0]) / (x[1] - x[0])
                v = np.where(part == 0, v[0], np.where(part == 1, v[1], v[0] + (v[1] - v[0]) * part))
            elif first.any() or last.any():
                v = column_cubic(x, v, q[a, ok], first, last)
            else:
                v = pchip4_np(np.broadcast_to(x, v.shape), v, q[a, ok])
        out[:, ok] = v
        return out, stray

    def _spline(self, q: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        grid, n = self.grid, q.shape[1]
        _, inside = grid.cells(q)
        out, stray = np.full((len(self.values), n), np.nan), np.zeros(n, bool)
        take, weight = [], []
        for a in range(3):
            nodes = grid.nodes(a)
            first, w = basis(nodes, degree, np.where(inside, q[a], nodes[0]))
            local = first - grid.ghosts(a) - self.origin[a] + np.arange(degree + 1)[:, None]
            size = self.values.shape[a + 1]
            stray |= inside & ((local < 0) | (local >= size)).any(0)
            take.append(np.clip(local, 0, size - 1))
            weight.append(w)
        ok = np.flatnonzero(inside & ~stray)
        if len(ok):
            li, lj, lk = (t[:, ok] for t in take)
            v = self.values[:, li[:, None, None], lj[None, :, None], lk[None, None, :]]  # keys, i, j, k, n
            for w in weight:
                v = (v * w[:, ok].reshape(1, degree + 1, *[1] * (v.ndim - 3), -1)).sum(1)
            out[:, ok] = v
        return out, stray
