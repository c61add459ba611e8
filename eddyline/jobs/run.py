"""A run: seeds in a volume or on a surface, carried through snapshots; histories and properties as Parquet.

    python -m eddyline.jobs.run --data-dir run/ --output-dir out --start-t 0 --end-t 3 volume \
        --r-min 300 --r-max 1000 --n-r 30 --n-th 15 --n-ph 30

The snapshots are files of the ``--format``, landed below the output first, or with ``--field`` what a landing job left.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions.grid import METHODS, Grid
from eddyline.jobs.formats import FORMATS, Options, kept
from eddyline.functions.spline import DEGREES
from eddyline.operators import advance, catalog, history, seeding, splines
from eddyline.shared import exists, plain, record, recorded, source_of
from eddyline.sources.ascii import write_trajectories


class Engine:
    """Seeds in, histories out, below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def times(self, start: float, end: float, dt: float) -> list[float]:
        n = max(1, round(abs(end - start) / dt))
        return [start + (end - start) * i / n for i in range(n + 1)]

    def integrate(self, seeds: DataFrame, flow, start: float, end: float, dt: float, scheme: str = "impl_trap", chunk: int = 10, **options) -> DataFrame:
        """``seeds`` (tracer_id, x, y, z and perhaps t0) through a closed-form flow; stops at ``end``, forward or backward."""
        if "t0" not in seeds.columns:
            seeds = seeds.withColumn("t0", F.lit(float(start)))
        return advance.advance(seeds, flow, self.times(start, end, dt), self.folder, scheme, chunk, **options)

    def snapshots(self, seeds: DataFrame, field: DataFrame, grid: Grid, times: list[float], start: int, end: int, keys: list[str], vel_keys: list[str], scheme: str = "impl_trap", method: str = "pchip", **options) -> DataFrame:
        """``seeds`` (tracer_id, x, y, z, t0) through snapshots of a FIELD."""
        return advance.advance_snapshots(seeds, field, grid, times, start, end, f"{self.folder}/steps", keys, vel_keys, scheme, method, **options)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--data-dir")
    source.add_argument("--field", help="a folder that eddyline.jobs.land wrote")
    p.add_argument("--format", choices=sorted(FORMATS), default="vtk", help="kind of the files; defaults of other options depend on it")
    p.add_argument("--output-dir", default="tracer_output")
    p.add_argument("--text-output", action="store_true", help="histories and properties as a text file a particle, too")
    p.add_argument("--file-pattern")
    p.add_argument("--start-t", type=float, required=True)
    p.add_argument("--end-t", type=float, required=True)
    p.add_argument("--keys", nargs="+")
    p.add_argument("--vel-keys", nargs=3, default=["V_u_x", "V_u_y", "V_u_z"])
    p.add_argument("--density-key", default="rho")
    p.add_argument("--heavy-neutrinos", choices=("sum", "drop", "separate"), default="sum")
    p.add_argument("--interpolator", choices=("pchip", "regular", "blocks"))
    p.add_argument("--interp-method", choices=sorted({*METHODS} - {"regular_pchip"}), default="linear", help="with --interpolator regular")
    p.add_argument("--rad-transform", choices=("log", "asinh", "none"))
    p.add_argument("--bh-mass", type=float, default=1.0, help="of --format blocks: the mass in the lapse of its velocities")
    p.add_argument("--rad-scale", type=float)
    p.add_argument("--integrator", choices=("impl_trap", "expl_trap", "rk4", "euler"), default="impl_trap")
    p.add_argument("--tol", type=float, default=1e-8)
    p.add_argument("--max-iter", type=int, default=20)
    p.add_argument("--relax", type=float, default=1.0)
    p.add_argument("--rk4-lagrange", action="store_true")
    p.add_argument("--steps-a-job", type=int, default=1, help="snapshots that a task holds of its part of the field, less three")
    p.add_argument("--seed-rng", type=int, default=0)
    kinds = p.add_subparsers(dest="seeds", required=True)
    for name, radii, n_quad in (("volume", ("--r-min", "--r-max"), 2), ("surface", ("--r-surf",), 3)):
        s = kinds.add_parser(name)
        for r in radii:
            s.add_argument(r, type=float, required=True)
        for n in (*(("--n-r",) if name == "volume" else ()), "--n-th", "--n-ph"):
            s.add_argument(n, type=int, required=True)
        for limit, default in (("--phi-min-deg", 0.0), ("--phi-max-deg", 360.0), ("--theta-min-deg", 0.0), ("--theta-max-deg", 180.0)):
            s.add_argument(limit, type=float, default=default)
        s.add_argument("--n-quad", type=int, default=n_quad)
        s.add_argument("--no-random-shift", action="store_true")
        if name == "surface":
            s.add_argument("--every-n-files", type=int, default=1)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(TRAJ, PROPS) of a parsed command line, as written."""
    if a.field:
        landed = kept(spark, a.field)
    else:
        pattern = a.file_pattern if any(c in a.file_pattern for c in "*?[]") else f"*{a.file_pattern}"
        options = Options(a.rad_transform, a.rad_scale, a.heavy_neutrinos, a.bh_mass)
        landed = FORMATS[a.format].land(spark, f"{a.data_dir}/{pattern}", a.keys, f"{a.output_dir}/field", options)
    times_table, grid, field = landed.times, landed.grid, landed.field
    rows = times_table.orderBy("time_idx").limit(history.MOST_TIMES + 1).collect()
    if len(rows) > history.MOST_TIMES:
        raise ValueError(f"more than {history.MOST_TIMES} snapshots in {a.data_dir or a.field}: narrow --file-pattern")
    times = [r["time"] for r in rows]
    near = lambda t: min(range(len(times)), key=lambda i: (abs(times[i] - t), i))
    start, end = near(a.start_t), near(a.end_t)
    method = "pchip" if a.interpolator == "pchip" else {"pchip": "regular_pchip"}.get(a.interp_method, a.interp_method)
    if method in DEGREES and isinstance(grid, Grid):
        made_of, at = plain({"field": source_of(field), "method": method, "keys": a.keys}), f"{a.output_dir}/splines"
        if not exists(spark, f"{at}/_SUCCESS") or recorded(spark, f"{at}.from") != made_of:
            splines.fitted(field, grid, a.keys, method).write.mode("overwrite").partitionBy("time_idx").parquet(at)
            record(spark, f"{at}.from", made_of)
        field = spark.read.parquet(at)
    limits = (a.theta_min_deg, a.theta_max_deg, a.phi_min_deg, a.phi_max_deg)
    jitter = None if a.no_random_shift else a.seed_rng
    if a.seeds == "volume":
        spec = spark.createDataFrame([(0, a.r_min, a.r_max)], "spec_id long, r_min double, r_max double")
        cells = seeding.volume_cells(spec, a.n_r, a.n_th, a.n_ph, limits, jitter)
        mass = seeding.summed(seeding.volume_nodes(cells, a.n_quad).withColumn("time_idx", F.lit(start)), field, grid, a.density_key, method=method)
        seeds = cells.select("tracer_id", "x", "y", "z", F.lit(times[start]).alias("t0"), "dV")
        props = seeds.join(mass, "tracer_id").select("tracer_id", "mass", "dV")
    else:
        spec = spark.createDataFrame([(0, a.r_surf)], "spec_id long, radius double")
        cells = seeding.surface_cells(spec, a.n_th, a.n_ph, limits)
        chosen = catalog.every_nth(times_table, times[start], times[end], a.every_n_files)
        if chosen.count() < 2:
            raise ValueError("a surface needs two snapshots or more")
        slots = catalog.slot_windows(times_table, chosen.select(F.col("step").alias("order"), F.col("time").alias("t_start")))
        flux = seeding.summed(seeding.surface_nodes(cells, slots, a.n_quad), field, grid, a.density_key, a.vel_keys, ("tracer_id", "slot"), method)
        per = a.n_th * a.n_ph
        seeds = seeding.surface_seeds(cells, slots, times_table, jitter)
        props = flux.select((F.col("slot") * per + F.col("tracer_id")).cast("long").alias("tracer_id"), "mass", F.lit(None).cast("double").alias("dV"))
    options = {"impl_trap": {"tol": a.tol, "max_iter": a.max_iter, "relax": a.relax}, "rk4": {"mode": "lagrange" if a.rk4_lagrange else "monotone"}}.get(a.integrator, {})
    traj = Engine(spark, a.output_dir).snapshots(seeds, field, grid, times, start, end, a.keys, a.vel_keys, a.integrator, method, together=a.steps_a_job, **options)
    status = advance.statuses(seeds, traj, times[end], end >= start)
    history.latest_density_mass(traj, props, a.density_key).join(status, "tracer_id", "left").write.mode("overwrite").parquet(f"{a.output_dir}/props")
    props = spark.read.parquet(f"{a.output_dir}/props")
    if a.text_output:
        write_trajectories(traj, props, f"{a.output_dir}/text", ["x", "y", "z", *a.keys]).collect()
    return traj, props


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    p = parser()
    a = p.parse_args(arguments)
    preset = FORMATS[a.format].preset
    for name, default in (("file_pattern", preset.pattern), ("keys", list(preset.keys)), ("rad_transform", preset.transform or "none"), ("interpolator", preset.method)):
        if getattr(a, name) is None:
            setattr(a, name, default)
    if a.data_dir and (a.format == "blocks") != (a.interpolator == "blocks"):
        p.error("--interpolator blocks goes with --format blocks, and no other does")
    if a.format == "blocks" and a.rad_transform != "none":
        p.error("--format blocks interpolates on the blocks' own nodes: --rad-transform none")
    if a.rad_transform == "asinh" and a.rad_scale is None:
        p.error("--rad-transform asinh needs --rad-scale")
    if a.steps_a_job < 1:
        p.error("--steps-a-job: one or more")
    lacking = [k for k in [*a.vel_keys, a.density_key] if k not in a.keys]
    if lacking:
        p.error(f"not among --keys: {', '.join(lacking)}")
    return a


def main(arguments: list[str] | None = None) -> None:
    run(SparkSession.builder.getOrCreate(), parsed(arguments))


if __name__ == "__main__":
    main()
