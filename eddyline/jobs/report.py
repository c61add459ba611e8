"""Reports on what runs wrote, as Parquet tables: mass-weighted histograms, and a check of mass through a sphere.

    python -m eddyline.jobs.report histograms --runs out --output rep --t-ref 5 --temperature-gk 0.0116 --r-ref 500 1000
    python -m eddyline.jobs.report mass --volume-runs out-v --surface-runs out-s --r-check 400 --field landed --output rep

Histograms have a row a panel and bin; the check a row a time. With ``--field`` (what a landing job left) the check holds
tracers against the flux through the grid's sphere that is nearest to the radius.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.functions import geometry
from eddyline.functions.grid import Grid
from eddyline.jobs.formats import kept
from eddyline.operators import history, seeding

STATUSES = ("done", "active")


def read_runs(spark: SparkSession, folders: list[str], statuses: list[str] = list(STATUSES)) -> tuple[DataFrame, DataFrame]:
    """(TRAJ, PROPS) of runs with one of the statuses; ids are numbered apart run by run."""
    both = []
    for n, folder in enumerate(folders):
        tracer = (F.col("tracer_id") + F.lit(n) * F.lit(1 << 48)).alias("tracer_id")
        traj = spark.read.parquet(f"{folder}/steps/steps").where("status = 'active'").drop("status", "step", "part", "tile", "starts", "answers", "time_idx")
        props = spark.read.parquet(f"{folder}/props").where(F.col("status").isin(statuses))
        both.append((traj.select(tracer, *(c for c in traj.columns if c != "tracer_id")), props.select(tracer, "mass", "status")))
    traj, props = both[0]
    for t, p in both[1:]:
        traj, props = traj.unionByName(t, allowMissingColumns=True), props.unionByName(p)
    r = geometry.radius(F.col("x"), F.col("y"), F.col("z"))
    return traj.join(props.select("tracer_id"), "tracer_id").withColumn("r", r), props


def binned(values: DataFrame, bins: int) -> DataFrame:
    """panel, bin, low, high, mass, share (of the panel's mass), n of ``values`` (panel, log, value, mass): even bins from each
    panel's least to its greatest finite value, of its logarithm where ``log``. What isn't finite, or not above 0, is left out."""
    v = F.when(F.col("log"), F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value"))
    fine = values.withColumn("v", v).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    spans = fine.groupBy("panel").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("mass").alias("all"))
    width = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(F.lit(1.0)) / bins
    place = F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    counted = fine.join(F.broadcast(spans), "panel").withColumns({"bin": place, "w": width}).groupBy("panel", "log", "bin", "a", "w", "all").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.when(F.col("log"), F.pow(F.lit(10.0), F.col("a") + (F.col("bin") + k) * F.col("w"))).otherwise(F.col("a") + (F.col("bin") + k) * F.col("w"))
    return counted.select("panel", "bin", edge(0).alias("low"), edge(1).alias("high"), "mass", (F.col("mass") / F.col("all")).alias("share"), "n")


def _long(rows: DataFrame, panels: dict[str, tuple[Column, bool]]) -> DataFrame:
    """panel, log, value, mass: a row a panel of each of ``rows`` (with a mass)."""
    each = F.array(*(F.struct(F.lit(n).alias("panel"), F.lit(log).alias("log"), c.cast("double").alias("value")) for n, (c, log) in panels.items()))
    return rows.select(F.explode(each).alias("p"), "mass").select("p.panel", "p.log", "p.value", "mass")


def _speed() -> Column:
    return geometry.radius(*(F.col(c) for c in ("V_u_x", "V_u_y", "V_u_z")))


def _angles() -> dict[str, tuple[Column, bool]]:
    return {"theta": (F.degrees(geometry.polar(F.col("x"), F.col("y"), F.col("z"))), False), "phi": (F.degrees(geometry.azimuth(F.col("x"), F.col("y"))), False)}


def histograms(traj: DataFrame, props: DataFrame, bins: int = 40, t_ref: float = 5.0, temperature_gk: float = 1.0, radii: list[float] | None = None) -> DataFrame:
    """Panels of what the keys of ``traj`` allow: speed, its asymptotic value and angles of the last records; composition and
    expansion time when the temperature first falls through ``t_ref`` after its peak; and for each of ``radii`` the same where
    a tracer first goes out through it (``speed@500``)."""
    have, mass = set(traj.columns), props.select("tracer_id", "mass")
    velocity = {"V_u_x", "V_u_y", "V_u_z"} <= have

    def panels() -> dict[str, tuple[Column, bool]]:
        out = _angles()
        if velocity:
            out["speed"] = (_speed(), False)
        if "u_t" in have:
            out["speed_asymptotic"] = (geometry.asymptotic_velocity(-F.col("u_t")), False)
        if {"h", "u_t"} <= have:
            out["speed_bernoulli"] = (geometry.asymptotic_velocity(-F.col("h") * F.col("u_t")), False)
        return out | {n: (F.col(c), log) for n, c, log in (("composition", "r_0", False), ("temperature", "T_gk", True)) if c in have or (c == "T_gk" and "T" in have)}

    keys = [c for c in traj.columns if c not in ("tracer_id", "time")]
    warm = traj.withColumn("T_gk", F.col("T") * temperature_gk) if "T" in have else traj
    keys += ["T_gk"] * ("T" in have)
    parts = [_long(history.final_state(warm, keys).join(mass, "tracer_id"), panels())]
    if {"T", "rho"} <= have:
        cooling = history.expansion_time(warm)
        for name, column, log in (("composition_when_cooled", "r_0", False), ("expansion_time_when_cooled", "tau", True)):
            if column in cooling.columns:
                cooled = history.value_when_cooled(cooling, t_ref, column, "T_gk").join(mass, "tracer_id")
                parts.append(_long(cooled, {name: (F.col("value"), log)}))
    for radius in radii or []:
        crossing = history.first_crossing(warm, radius, "r", tuple(k for k in keys if k != "r")).withColumn("r", F.lit(float(radius))).join(mass, "tracer_id")
        parts.append(_long(crossing, {f"{n}@{radius:g}": c for n, c in panels().items()}))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return binned(whole, bins)


def sphere_flux(times: DataFrame, field: DataFrame, grid: Grid, radius: float, density: str, vel_keys: list[str], n_theta: int = 32, n_phi: int = 64, n_quad: int = 2) -> DataFrame:
    """time, radius, flux: mass a unit of time through the sphere of the grid's radius nearest to ``radius``, at each snapshot."""
    nearest = min(grid.axes[0][1:-1] or grid.axes[0], key=lambda r: (abs(r - radius), r))
    spec = times.sparkSession.createDataFrame([(0, float(nearest))], "spec_id long, radius double")
    slots = times.select(F.col("time_idx").cast("long").alias("slot"), F.col("time_idx").cast("int").alias("time_idx"), F.lit(1).alias("n_files"), F.lit(1.0).alias("dt"))
    nodes = seeding.surface_nodes(seeding.surface_cells(spec, n_theta, n_phi), slots, n_quad)
    flux = seeding.summed(nodes, field, grid, density, vel_keys, ("slot",))
    return flux.join(times.select(F.col("time_idx").cast("long").alias("slot"), "time"), "slot").select("time", F.lit(float(nearest)).alias("radius"), F.col("mass").alias("flux"))


def mass_check(volume: tuple[DataFrame, DataFrame], surface: tuple[DataFrame, DataFrame], radius: float, innermost: float | None = None, flux: DataFrame | None = None) -> DataFrame:
    """time, mass, rate, mass_surface, rate_surface: what is beyond ``radius`` of both kinds of runs, and of surface runs alone; of
    tracers that come within ``innermost``, if given. With ``flux`` (time, radius, flux) also that and its sum over time."""
    def of(traj: DataFrame, props: DataFrame) -> tuple[DataFrame, DataFrame]:
        if innermost is not None:
            near = traj.groupBy("tracer_id").agg(F.min("r").alias("least")).where(F.col("least") < innermost)
            traj, props = (x.join(near.select("tracer_id"), "tracer_id") for x in (traj, props))
        return traj.select("tracer_id", "time", "r"), props

    (vt, vp), (st, sp) = of(*volume), of(*surface)
    apart = lambda df, n: df.withColumn("tracer_id", F.col("tracer_id") * 2 + n)
    both = history.mass_outside(apart(vt, 0).unionByName(apart(st, 1)), apart(vp, 0).unionByName(apart(sp, 1)), radius)
    alone = history.mass_outside(st, sp, radius)
    # times of the other runs keep the mass that was there before
    held = F.last("m", ignorenulls=True).over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    series = both.join(alone.select("time", F.col("mass").alias("m")), "time", "left").withColumn("mass_surface", F.coalesce(held, F.lit(0.0))).drop("m")
    out = history.rate(history.rate(series).withColumnRenamed("rate", "rate_all"), "mass_surface").select("time", "mass", F.col("rate_all").alias("rate"), "mass_surface", F.col("rate").alias("rate_surface"))
    if flux is not None:
        out = out.join(history.running(flux.withColumnRenamed("flux", "f"), "f", "flux_mass").select("time", "radius", F.col("f").alias("flux"), "flux_mass"), "time", "full")
    return out.orderBy("time")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = p.add_subparsers(dest="report", required=True)
    h, m = kinds.add_parser("histograms"), kinds.add_parser("mass")
    h.add_argument("--runs", nargs="+", required=True)
    h.add_argument("--bins", type=int, default=40)
    h.add_argument("--t-ref", type=float, default=5.0)
    h.add_argument("--temperature-gk", type=float, default=1.0, help="a unit of the runs' temperature in the unit of --t-ref")
    h.add_argument("--r-ref", type=float, nargs="+", default=[])
    m.add_argument("--volume-runs", nargs="+", required=True)
    m.add_argument("--surface-runs", nargs="+", required=True)
    m.add_argument("--r-check", type=float, required=True)
    m.add_argument("--min-innermost-r", type=float)
    m.add_argument("--field")
    m.add_argument("--density-key", default="rho")
    m.add_argument("--vel-keys", nargs=3, default=["V_u_x", "V_u_y", "V_u_z"])
    for s in (h, m):
        s.add_argument("--output", required=True)
        s.add_argument("--status", nargs="+", default=list(STATUSES))
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.report == "histograms":
        out = histograms(*read_runs(spark, a.runs, a.status), a.bins, a.t_ref, a.temperature_gk, a.r_ref)
    else:
        flux = None
        if a.field:
            landed = kept(spark, a.field)
            flux = sphere_flux(landed.times, landed.field, landed.grid, a.r_check, a.density_key, a.vel_keys)
        out = mass_check(read_runs(spark, a.volume_runs, a.status), read_runs(spark, a.surface_runs, a.status), a.r_check, a.min_innermost_r, flux)
    out.write.mode("overwrite").parquet(f"{a.output}/{a.report}")


if __name__ == "__main__":
    main()
