"""Coordinates, velocities and field clean-up as Column expressions; nothing here leaves the JVM.

Out of domain is NaN, never null or an error: a tracer at the origin, or a logarithm of a radius of 0, must
not end a job. Coordinates: Cartesian x, y, z; spherical r, polar angle theta (or its cosine mu) and phi in
[0, 2 pi).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
NAN = float("nan")
#: Greatest sane magnitude of mean energies; other fields have no bound.
ENERGY_LIMIT = 1e4


def nan() -> Column:
    return F.lit(NAN)


def transformed(c: Column, kind: str | None, scale: float | None = None) -> Column:
    """A radial coordinate as it is interpolated: as it is, ``log`` (base 10) or ``asinh`` of c / scale."""
    if kind in (None, "none"):
        return c
    if kind == "log":
        return F.when(c > 0, F.log10(c)).otherwise(nan())
    if kind == "asinh":
        if not scale:
            raise ValueError("asinh needs a scale")
        return F.asinh(c / scale)
    raise ValueError(f"unknown transform {kind!r}")


def radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def azimuth(x: Column, y: Column) -> Column:
    return F.pmod(F.atan2(y, x) + TWO_PI, F.lit(TWO_PI))


def polar(x: Column, y: Column, z: Column, kind: str = "theta") -> Column:
    """theta = acos(z / r), or mu = z / r; at the origin as if r were 1."""
    r = radius(x, y, z)
    mu = z / F.when(r == 0, F.lit(1.0)).otherwise(r)
    return mu if kind == "mu" else F.acos(mu)


def unwrapped(angle: Column, tracer: str, order: list[str]) -> Column:
    """A tracer's angle in radians without jumps by 2 pi along its history."""
    w = Window.partitionBy(tracer).orderBy(*order)
    step = angle - F.lag(angle).over(w)
    turns = F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)
    return angle + TWO_PI * F.sum(turns).over(w.rowsBetween(Window.unboundedPreceding, 0))


def is_sane(v: Column, limit: float | None = None) -> Column:
    ok = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok & (F.abs(v) <= limit) if limit is not None else ok


def sanitised(v: Column, limit: float | None = None, fill: float = 0.0) -> Column:
    return F.when(is_sane(v, limit), v).otherwise(F.lit(fill))


def summed_flux(a: Column, b: Column) -> Column:
    """The number flux of two heavy species together."""
    return a + b


def mean_energy(wa: Column, va: Column, wb: Column, vb: Column) -> Column:
    """Their mean energy, weighted by fluxes; 0 where nothing flows."""
    total = wa + wb
    return F.when(total > 0, (wa * va + wb * vb) / F.when(total > 0, total).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def moment_energy(j: Column, n: Column) -> Column:
    """Energy a particle, from energy and number densities."""
    return F.when(n != 0, j / F.when(n != 0, n)).otherwise(nan())


def moment_density(n: Column, root_metric: Column) -> Column:
    return F.when(root_metric != 0, n / F.when(root_metric != 0, root_metric)).otherwise(nan())


def transport_velocity(u1: Column, u2: Column, u3: Column, r: Column, theta: Column, phi: Column, mass: float) -> tuple[Column, Column, Column]:
    """Cartesian transport velocity from normal-observer velocities around a mass; NaN inside its horizon."""
    lapse2 = F.when(r > 0, 1 - 2 * mass / F.when(r > 0, r)).otherwise(nan())
    sin, cos = F.sin(theta), F.cos(theta)
    safe = F.when(lapse2 != 0, lapse2)
    lorentz = F.sqrt(1 + u1 * u1 / safe + (r * u2) * (r * u2) + (r * sin * u3) * (r * sin * u3))
    factor = F.when(lapse2 > 0, F.sqrt(F.when(lapse2 > 0, lapse2)) / lorentz).otherwise(nan())
    vr, vt, vp = factor * u1, factor * r * u2, factor * r * sin * u3
    return vr * sin * F.cos(phi) + vt * cos * F.cos(phi) - vp * F.sin(phi), vr * sin * F.sin(phi) + vt * cos * F.sin(phi) + vp * F.cos(phi), vr * cos - vt * sin


def asymptotic_velocity(w: Column) -> Column:
    """Speed at infinity from -u_t (geodesic) or -h u_t (Bernoulli); NaN for what is bound."""
    return F.when(w > 1, F.sqrt(1 - 1 / F.when(w > 1, w * w).otherwise(F.lit(1.0)))).otherwise(nan())


def grid_index(offset: Column, n_r: int, n_theta: int, flip: bool = False) -> tuple[Column, Column, Column]:
    """(i, j, k) of a value's place in a block that is stored with r fastest."""
    j = F.floor(offset / n_r) % n_theta
    return offset % n_r, (n_theta - 1 - j) if flip else j, F.floor(offset / (n_r * n_theta))


def ghost_cell(j: Column, k: Column, n_theta: int, n_phi: int, node_centred: bool = False) -> tuple[Column, Column]:
    """The stored cell that a stencil index beyond a pole or the seam means: over a pole it is the mirror row,
    half a turn around. Nothing is copied."""
    shift = 0 if node_centred else 1
    low, high = j < 0, j > n_theta - 1
    row = F.when(low, -j - shift).when(high, 2 * (n_theta - 1) + shift - j).otherwise(j)
    turn = F.when(low | high, F.lit(n_phi // 2)).otherwise(F.lit(0))
    return row, F.pmod(k + turn, F.lit(n_phi))


def root_faces(low: float, high: float, ratio: float, n: int) -> Column:
    """The n + 1 faces of a geometric axis, as an array."""
    i = F.sequence(F.lit(0), F.lit(n))
    if abs(ratio - 1) < 1e-12:
        return F.transform(i, lambda x: low + (high - low) * x / n)
    first = (high - low) * (ratio - 1) / (ratio**n - 1)
    return F.transform(i, lambda x: low + first * (F.pow(F.lit(float(ratio)), x) - 1) / (ratio - 1))


def mirrored_nodes(nodes: Column, faces: Column, ghosts: int, n: int) -> Column:
    """Polar node positions of a block whose ghost rows come back over a pole: those below the first face
    and above the last become their mirror images; others stay."""
    first, last = F.element_at(faces, ghosts + 1), F.element_at(faces, n - ghosts + 1)

    def at(x: Column, i: Column) -> Column:
        below, above = (i < ghosts) & (x > first), (i >= n - ghosts) & (x < last)
        return F.when(below, 2 * first - x).when(above, 2 * last - x).otherwise(x)

    return F.transform(nodes, at)
