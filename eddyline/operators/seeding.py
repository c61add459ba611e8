"""Seeds with quadrature masses, generated from a table of specifications.

A specification row is a shell (r_min, r_max) or a sphere (radius) to be cut in n_r x n_theta x n_phi cells between
angle limits in degrees. Cells are exploded from sequences row by row, so many specifications are many independent
rows; Gauss-Legendre nodes are literal arrays of a fixed order. Densities and fluxes are a function of Columns or, with
the nodes as points, values gathered from a FIELD (`volume_nodes`, `surface_nodes`, `summed`).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.grid import Grid
from eddyline.functions.octree import Octree
from eddyline.operators import blockstep, tiles as tiling

WHOLE = (0.0, 180.0, 0.0, 360.0)


def _legendre(n: int) -> Column:
    x, w = np.polynomial.legendre.leggauss(n)
    return F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w, strict=True)))


def _exploded(df: DataFrame, **sizes: int) -> DataFrame:
    for name, n in sizes.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df


def _angles(df: DataFrame, n_theta: int, n_phi: int, limits: tuple[float, float, float, float]) -> DataFrame:
    """th0, th1 (even in the cosine, mu0 and mu1) and ph0, ph1 of cells ith, iph within the limits (theta, then phi)."""
    th_min, th_max, ph_min, ph_max = limits
    if not (0 <= th_min < th_max <= 180 and ph_min < ph_max <= ph_min + 360):
        raise ValueError("limits: 0 <= theta_min < theta_max <= 180, phi_min < phi_max <= phi_min + 360")
    top, bottom = math.cos(math.radians(th_min)), math.cos(math.radians(th_max))
    top, bottom = (round(x) if abs(x - round(x)) < 1e-15 else x for x in (top, bottom))
    a, b = math.radians(ph_min), math.radians(ph_max)
    mu = lambda i: top - (top - bottom) * i / n_theta
    ph = lambda i: a + (b - a) * i / n_phi
    out = df.withColumn("mu0", mu(F.col("ith"))).withColumn("mu1", mu(F.col("ith") + 1))
    out = out.withColumn("th0", F.acos(F.least("mu0", F.lit(1.0)))).withColumn("th1", F.acos(F.greatest("mu1", F.lit(-1.0))))
    return out.withColumn("ph0", ph(F.col("iph"))).withColumn("ph1", ph(F.col("iph") + 1))


def uniform(key: Column, seed: int, salt: int) -> Column:
    """A number from 0 to below 1 by a hash of the key: the same in every rerun."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def _placed(df: DataFrame, r: Column, th: Column, ph: Column) -> DataFrame:
    return df.withColumns({"x": r * F.sin(th) * F.cos(ph), "y": r * F.sin(th) * F.sin(ph), "z": r * F.cos(th)})


def _between(low: str, high: str, seed: int | None, salt: int) -> Column:
    part = F.lit(0.5) if seed is None else uniform(F.col("tracer_id"), seed, salt)
    return F.col(low) + (F.col(high) - F.col(low)) * part


def volume_cells(specs: DataFrame, n_r: int, n_theta: int, n_phi: int, limits: tuple[float, float, float, float] = WHOLE, jitter: int | None = None) -> DataFrame:
    """``specs`` (spec_id, r_min, r_max) cut in cells: ir, ith, iph, tracer_id (r slowest, phi fastest), edges
    r0, r1 (geometric), th0, th1 (even in the cosine), ph0, ph1, a seed x, y, z and dV. Seeds are in the middle of
    their cells in r, theta and phi or, with a ``jitter`` seed, anywhere in them, uniformly in r, theta and phi."""
    out = _angles(_exploded(specs, ir=n_r, ith=n_theta, iph=n_phi), n_theta, n_phi, limits)
    ratio = F.col("r_max") / F.col("r_min")
    edge = lambda i: F.col("r_min") * F.pow(ratio, i / n_r)
    out = out.withColumn("r0", edge(F.col("ir"))).withColumn("r1", edge(F.col("ir") + 1))
    number = (F.col("ir") * n_theta + F.col("ith")) * n_phi + F.col("iph")
    out = out.withColumn("tracer_id", (F.col("spec_id") * (n_r * n_theta * n_phi) + number).cast("long"))
    r, th = (F.col("r0") + F.col("r1")) / 2, (F.col("th0") + F.col("th1")) / 2
    out = out.withColumn("dV", r * r * F.sin(th) * (F.col("r1") - F.col("r0")) * (F.col("th1") - F.col("th0")) * (F.col("ph1") - F.col("ph0")))
    return _placed(out, *(_between(a, b, jitter, n) for n, (a, b) in enumerate((("r0", "r1"), ("th0", "th1"), ("ph0", "ph1")))))


def _volume_quadrature(cells: DataFrame, n_quad: int) -> tuple[DataFrame, Column, Column, Column, Column]:
    nodes = _legendre(n_quad)
    out = cells.select("tracer_id", "r0", "r1", "th0", "th1", "ph0", "ph1")
    for a in "abc":
        out = out.withColumn(a, F.explode(nodes))
    half = lambda lo, hi: (F.col(hi) - F.col(lo)) / 2
    at = lambda lo, hi, n: (F.col(hi) + F.col(lo)) / 2 + half(lo, hi) * F.col(f"{n}.x")
    r, th, ph = at("r0", "r1", "a"), at("th0", "th1", "b"), at("ph0", "ph1", "c")
    w = F.col("a.w") * F.col("b.w") * F.col("c.w") * half("r0", "r1") * half("th0", "th1") * half("ph0", "ph1")
    return out, r, th, ph, w * r * r * F.sin(th)


def volume_masses(cells: DataFrame, density, n_quad: int = 2) -> DataFrame:
    """tracer_id, mass: ``density`` (a function of Columns r, theta, phi) over each cell by n_quad^3 nodes."""
    out, r, th, ph, w = _volume_quadrature(cells, n_quad)
    return out.groupBy("tracer_id").agg(F.sum(w * density(r, th, ph)).alias("mass"))


def volume_nodes(cells: DataFrame, n_quad: int = 2) -> DataFrame:
    """tracer_id, x, y, z, w: the quadrature nodes of each cell."""
    out, r, th, ph, w = _volume_quadrature(cells, n_quad)
    return _placed(out.withColumn("w", w), r, th, ph).select("tracer_id", "x", "y", "z", "w")


def surface_cells(specs: DataFrame, n_theta: int, n_phi: int, limits: tuple[float, float, float, float] = WHOLE) -> DataFrame:
    """``specs`` (spec_id, radius) cut in cells of a sphere, even in the cosine and in phi."""
    out = _angles(_exploded(specs, ith=n_theta, iph=n_phi), n_theta, n_phi, limits)
    return out.withColumn("tracer_id", (F.col("spec_id") * (n_theta * n_phi) + F.col("ith") * n_phi + F.col("iph")).cast("long"))


def _surface_quadrature(cells: DataFrame, n_quad: int) -> tuple[DataFrame, Column, Column, Column]:
    nodes = _legendre(n_quad)
    out = cells.withColumn("a", F.explode(nodes)).withColumn("b", F.explode(nodes))
    mu = (F.col("mu0") + F.col("mu1")) / 2 + (F.col("mu0") - F.col("mu1")) / 2 * F.col("a.x")
    ph = (F.col("ph0") + F.col("ph1")) / 2 + (F.col("ph1") - F.col("ph0")) / 2 * F.col("b.x")
    w = F.col("a.w") * F.col("b.w") * (F.col("mu0") - F.col("mu1")) / 2 * (F.col("ph1") - F.col("ph0")) / 2
    return out, mu, ph, w * F.col("radius") * F.col("radius")


def surface_masses(cells: DataFrame, slots: DataFrame, flux, n_quad: int = 3) -> DataFrame:
    """tracer_id, slot, mass: ``flux`` (density times radial speed, a function of Columns radius, mu, phi, time)
    through each cell in each slot, every snapshot of a slot counting for dt / n_files. SLOTS(spec_id, slot, time,
    n_files, dt) joins by specification."""
    out, mu, ph, w = _surface_quadrature(cells.select("tracer_id", "spec_id", "radius", "mu0", "mu1", "ph0", "ph1"), n_quad)
    part = w * flux(F.col("radius"), mu, ph, F.col("time")) * F.col("dt") / F.col("n_files")
    return out.join(slots, "spec_id").groupBy("tracer_id", "slot").agg(F.sum(part).alias("mass"))


def surface_nodes(cells: DataFrame, slots: DataFrame, n_quad: int = 3) -> DataFrame:
    """tracer_id, slot, time_idx, x, y, z, w: each cell's nodes at each snapshot of each slot of ``slots`` (slot, time_idx,
    n_files, dt; a run's few, sent to all), their weights shared out among the slot's snapshots."""
    out, mu, ph, w = _surface_quadrature(cells, n_quad)
    placed = _placed(out.withColumn("w0", w), F.col("radius"), F.acos(mu), ph).select("tracer_id", "x", "y", "z", "w0")
    times = slots.select(F.struct("slot", "time_idx", (F.col("dt") / F.col("n_files")).alias("part")).alias("s")).agg(F.collect_list("s").alias("s"))
    every = placed.join(F.broadcast(times), F.lit(True)).withColumn("s", F.explode("s"))
    return every.select("tracer_id", "s.slot", "s.time_idx", "x", "y", "z", (F.col("w0") * F.col("s.part")).alias("w"))


def surface_seeds(cells: DataFrame, slots: DataFrame, times: DataFrame, jitter: int | None = None) -> DataFrame:
    """tracer_id, slot, x, y, z, t0: a seed of each cell of ``cells`` (of one sphere) for each slot, slots slowest: in the
    middle of its cell at the slot's first snapshot or, with a ``jitter`` seed, anywhere in it at any of them."""
    per = cells.agg(F.count(F.lit(1))).first()[0]
    listed = slots.groupBy("slot", "i_start").agg(F.array_sort(F.collect_list(F.col("time_idx").cast("long"))).alias("files"))
    out = cells.join(F.broadcast(listed.agg(F.collect_list(F.struct("slot", "i_start", "files")).alias("s"))), F.lit(True)).withColumn("s", F.explode("s"))
    out = out.withColumn("tracer_id", (F.col("s.slot") * per + F.col("tracer_id")).cast("long"))
    pick = F.col("s.i_start") if jitter is None else F.element_at("s.files", (F.floor(uniform(F.col("tracer_id"), jitter, 9) * F.size("s.files")) + 1).cast("int"))
    placed = _placed(out.withColumn("time_idx", pick.cast("int")), F.col("radius"), _between("th0", "th1", jitter, 1), _between("ph0", "ph1", jitter, 2))
    return placed.join(times.select("time_idx", F.col("time").alias("t0")), "time_idx").select("tracer_id", "s.slot", "x", "y", "z", "t0")


def summed(nodes: DataFrame, field: DataFrame, grid: Grid | Octree, density: str, vel_keys: list[str] | None = None, by: tuple[str, ...] = ("tracer_id",), method: str = "pchip", size: int = tiling.SIZE) -> DataFrame:
    """<by>, mass: the weighted sum over ``nodes`` (<by>, time_idx, x, y, z, w) of FIELD's density there or, with
    ``vel_keys``, of density times radial speed. Nodes are gathered by tile and summed where they come out."""
    keys = [density, *(vel_keys or [])]
    node = nodes.select(F.struct(*by, "x", "y", "z", "w").alias("node"), "time_idx", "x", "y", "z")
    got = blockstep.gather(node, field, grid, keys, "node") if isinstance(grid, Octree) else tiling.gather(node, field, grid, keys, method, "node", size=size)
    value = F.col(density)
    if vel_keys:
        x, y, z = (F.col(f"node.{c}") for c in "xyz")
        value = value * (x * F.col(vel_keys[0]) + y * F.col(vel_keys[1]) + z * F.col(vel_keys[2])) / F.sqrt(x * x + y * y + z * z)
    return got.groupBy(*(F.col(f"node.{c}").alias(c) for c in by)).agg(F.sum(F.col("node.w") * value).alias("mass"))


def rings(specs: DataFrame, n_angles: int) -> DataFrame:
    """``specs`` (spec_id, radius, width, rho): tracers on circles in the plane, mass = rho r dr dtheta."""
    out = specs.withColumn("iph", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1)))).withColumn("phi", 2 * math.pi * F.col("iph") / n_angles)
    mass = F.col("rho") * F.col("radius") * F.col("width") * (2 * math.pi / n_angles)
    return out.select((F.col("spec_id") * n_angles + F.col("iph")).cast("long").alias("tracer_id"), (F.col("radius") * F.cos("phi")).alias("x"), (F.col("radius") * F.sin("phi")).alias("y"), F.lit(0.0).alias("z"), mass.alias("mass"))
