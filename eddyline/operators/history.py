"""Questions about histories: TRAJ(tracer_id, time, <keys>) and PROPS(tracer_id, mass, status).

Windows run by tracer and time; ties in time are settled by ``seq`` where the caller has one. Nothing needs more
than one tracer's history in a task, and masses join by tracer id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
#: Times that a grid may have; they are the snapshots of a run.
MOST_TIMES = 100_000


def by_time(*ties: str):
    return Window.partitionBy("tracer_id").orderBy("time", *ties)


def gradient(f: Column, t: Column, w) -> Column:
    """df/dt on uneven times: second order inside, one-sided at the ends, NaN for a single point."""
    f0, f2, t0, t2 = F.lag(f).over(w), F.lead(f).over(w), F.lag(t).over(w), F.lead(t).over(w)
    hs, hd = t - t0, t2 - t
    inner = (hs * hs * f2 + (hd * hd - hs * hs) * f - hd * hd * f0) / F.when(hs * hd * (hd + hs) != 0, hs * hd * (hd + hs))
    ends = F.when(t0.isNull(), (f2 - f) / F.when(hd != 0, hd)).otherwise((f - f0) / F.when(hs != 0, hs))
    return F.coalesce(F.when(t0.isNull() | t2.isNull(), ends).otherwise(inner), F.lit(NAN))


def expansion_time(traj: DataFrame, key: str = "rho", ties: tuple[str, ...] = ()) -> DataFrame:
    w = by_time(*ties)
    return traj.withColumn("tau", F.col(key) / (F.abs(gradient(F.col(key), F.col("time"), w)) + 1e-300))


def peak(traj: DataFrame, key: str = "temp") -> DataFrame:
    """tracer_id, t_peak, peak: the first time of each tracer's greatest value."""
    best = F.max_by("time", F.struct(F.col(key), -F.col("time")))
    return traj.groupBy("tracer_id").agg(best.alias("t_peak"), F.max(key).alias("peak"))


def after_peak(traj: DataFrame, key: str = "temp") -> DataFrame:
    return traj.join(peak(traj, key), "tracer_id").where("time >= t_peak")


def value_when_cooled(traj: DataFrame, at: float, wanted: str, key: str = "temp", ties: tuple[str, ...] = ()) -> DataFrame:
    """tracer_id, value: ``wanted`` where ``key`` first falls through ``at`` after its peak, linear between
    the two records; no row where it never does."""
    w = by_time(*ties)
    steps = after_peak(traj, key).select("tracer_id", "time", *ties, F.col(key).alias("b"), F.col(wanted).alias("vb"), F.lag(key).over(w).alias("a"), F.lag(wanted).over(w).alias("va"))
    down = steps.where((F.col("a") > at) & (F.col("b") <= at))
    first = down.groupBy("tracer_id").agg(F.min_by(F.struct("a", "b", "va", "vb"), F.struct("time", *ties)).alias("s"))
    return first.select("tracer_id", (F.col("s.va") + (F.col("s.vb") - F.col("s.va")) * (F.lit(at) - F.col("s.a")) / (F.col("s.b") - F.col("s.a"))).alias("value"))


def first_crossing(traj: DataFrame, radius: float, key: str = "r", values: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """tracer_id, t_cross and ``values`` there: where ``key`` first reaches ``radius`` from below, linear in
    ``key``; a tracer that starts beyond it crosses at its first record."""
    w = by_time(*ties)
    before = [F.lag(c).over(w).alias(f"{c}__0") for c in ("time", key, *values)]
    steps = traj.select("tracer_id", "time", key, *values, *ties, *before).where(F.col(key) >= radius)
    names = list(dict.fromkeys(["time", key, *values, *(f"{c}__0" for c in ("time", key, *values))]))
    first = steps.groupBy("tracer_id").agg(F.min_by(F.struct(*names), F.struct("time", *ties)).alias("s"))
    k0, k1 = F.col(f"s.{key}__0"), F.col(f"s.{key}")
    part = F.when(k0.isNull() | (k1 == k0), F.lit(1.0)).otherwise((radius - k0) / F.when(k1 != k0, k1 - k0))

    def at(c: str, alias: str) -> Column:
        v0, v1 = F.col(f"s.{c}__0"), F.col(f"s.{c}")
        return F.when(k0.isNull(), v1).otherwise(v0 + (v1 - v0) * part).alias(alias)

    return first.select("tracer_id", at("time", "t_cross"), *(at(c, c) for c in values))


def final_state(traj: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    return traj.groupBy("tracer_id").agg(F.max_by(F.struct("time", *keys), F.struct("time", *ties)).alias("s")).select("tracer_id", "s.*")


def weighted_histogram(values: DataFrame, value: str, weight: str, low: float, high: float, n_bins: int, log: bool = False) -> DataFrame:
    """bin, mass, n: weights by equal bins of [low, high], the last one closed; ``log`` bins the logarithm.
    What isn't finite or is outside is left out."""
    v, a, b = F.col(value), low, high
    ok = ~F.isnan(v) & v.between(low, high)
    if log:
        import math

        ok, v, a, b = ok & (v > 0), F.log10(v), math.log10(low), math.log10(high)
    place = F.least(F.width_bucket(v, F.lit(float(a)), F.lit(float(b)), F.lit(n_bins)), F.lit(n_bins)).cast("int")
    return values.where(ok).groupBy(place.alias("bin")).agg(F.sum(weight).alias("mass"), F.count(F.lit(1)).alias("n"))


def cumulative(hist: DataFrame, value: str = "mass") -> DataFrame:
    """A histogram's running sum from its lowest bin; histograms are as small as their bins."""
    return hist.withColumn("enclosed", F.sum(value).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def held_to_times(traj: DataFrame, times: DataFrame, key: str = "r") -> DataFrame:
    """tracer_id, time, key on every one of ``times``: its record there, 0 where it has none, and its last
    record's value from that on. The result has a row for each tracer and time by nature; the times, at most
    ``MOST_TIMES``, are counted and then sent to all. For sums by time see ``mass_outside``, which needs no grid."""
    known = traj.select("tracer_id", "time", key)
    last = known.groupBy("tracer_id").agg(F.max("time").alias("t_last"), F.max_by(key, "time").alias("held"))
    n = times.select("time").distinct().limit(MOST_TIMES + 1).count()
    if n > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times; mass_outside() needs no grid of them")
    grid = times.select("time").distinct().agg(F.sort_array(F.collect_list("time")).alias("all"))
    full = last.join(F.broadcast(grid), F.lit(True)).select("tracer_id", "t_last", "held", F.explode("all").alias("time"))
    joined = full.join(known, ["tracer_id", "time"], "left")
    return joined.select("tracer_id", "time", F.when(F.col("time") >= F.col("t_last"), F.col("held")).otherwise(F.coalesce(key, F.lit(0.0))).alias(key))


def mass_outside(traj: DataFrame, props: DataFrame, radius: float, key: str = "r") -> DataFrame:
    """time, mass: at each recorded time the mass of the tracers that are beyond ``radius`` then or, their
    records over, were at their last. Each record speaks for the time to the tracer's next distinct time, so
    sums of changes give it without pairing tracers with times."""
    joined = traj.join(props.select("tracer_id", "mass"), "tracer_id")
    here = joined.groupBy("time").agg(F.sum(F.when(F.col(key) >= radius, F.col("mass")).otherwise(0.0)).alias("now"))
    ends = joined.groupBy("tracer_id").agg(F.max("time").alias("time"), F.max_by(F.struct(key, "mass"), "time").alias("s"))
    gone = ends.groupBy("time").agg(F.sum(F.when(F.col(f"s.{key}") >= radius, F.col("s.mass")).otherwise(0.0)).alias("gone"))
    before = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return here.join(gone, "time", "left").select("time", (F.col("now") + F.coalesce(F.sum("gone").over(before), F.lit(0.0))).alias("mass"))


def rate(series: DataFrame, value: str = "mass") -> DataFrame:
    """The first differences of a series over time; 0 at its start."""
    w = Window.orderBy("time")
    dt = F.col("time") - F.lag("time").over(w)
    return series.withColumn("rate", F.coalesce((F.col(value) - F.lag(value).over(w)) / F.when(dt != 0, dt), F.lit(0.0)))


def latest_density_mass(traj: DataFrame, props: DataFrame, density: str = "rho", ties: tuple[str, ...] = ()) -> DataFrame:
    """PROPS with ``mass`` = dV times the density of the latest record, where there are both; ``mass_quad``
    keeps the mass that a tracer was seeded with."""
    last = traj.groupBy("tracer_id").agg(F.max_by(density, F.struct("time", *ties)).alias("__rho"))
    new = props.join(last, "tracer_id", "left")
    return new.withColumn("mass_quad", F.col("mass")).withColumn("mass", F.coalesce(F.col("dV") * F.col("__rho"), F.col("mass"))).drop("__rho")


def even_by_value(metrics: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose values are the first at or above each of n even targets between the least and the greatest;
    the
    first of those between two targets, so nothing is joined."""
    low, high = metrics.agg(F.min(value), F.max(value)).first()
    if low is None:
        return metrics
    step = (high - low) / (n - 1) if n > 1 and high > low else 1.0
    best = Window.partitionBy("__t").orderBy(value, *[c for c in metrics.columns if c != value])
    between = metrics.withColumn("__t", F.floor((F.col(value) - low) / step + 1e-12))
    return between.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__t")


def running(series: DataFrame, value: str, name: str = "total") -> DataFrame:
    """``series`` with the running sum of ``value`` times the time to the next record (0 at the last)."""
    w = Window.orderBy("time")
    dt = F.coalesce(F.lead("time").over(w) - F.col("time"), F.lit(0.0))
    return series.withColumn(name, F.sum(F.col(value) * dt).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def of_status(traj: DataFrame, statuses: list[str]) -> DataFrame:
    return traj.where(F.col("status").isin(statuses))


def never_within(traj: DataFrame, radius: float, key: str = "r") -> DataFrame:
    """The records of tracers that never come within ``radius``."""
    far = traj.groupBy("tracer_id").agg(F.min(F.col(key) * F.col(key)).alias("r2")).where(F.col("r2") >= radius * radius)
    return traj.join(far, "tracer_id", "left_semi")


def reaching(traj: DataFrame, radius: float, key: str = "r") -> DataFrame:
    """tracer_id, n of the tracers that come within ``radius`` and how many records they have."""
    return traj.groupBy("tracer_id").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("least") < radius).select("tracer_id", "n")


def sampled(tracers: DataFrame, n: int, seed: int, key: str = "tracer_id") -> DataFrame:
    """``n`` rows picked by a hash of their key, the same in every rerun."""
    order = (F.col(key) * F.lit(2654435761) + seed) % F.lit(4294967296)
    return tracers.orderBy(order, key).limit(n)


def means(traj: DataFrame, key: str) -> DataFrame:
    return traj.groupBy("tracer_id").agg(F.avg(key).alias("mean"), F.max(key).alias("peak"), F.count(F.lit(1)).alias("n"))


def rms(errors: DataFrame, error: str, *by: str) -> DataFrame:
    """<by>, rms of ``error``, what is NaN left out."""
    return errors.groupBy(*by).agg(F.sqrt(F.avg(F.when(~F.isnan(error), F.col(error) * F.col(error)))).alias("rms"))


def convergence_order(errors: DataFrame, level: str = "k", error: str = "err") -> DataFrame:
    """level, order: log2 of each level's error over the next finer one's; a handful of rows."""
    return errors.select(level, F.log2(F.lag(error).over(Window.orderBy(level)) / F.col(error)).alias("order_"))


def disagreement(pairs: DataFrame, distance: Column, *by: str) -> DataFrame:
    """<by>, the mean and greatest distance."""
    return pairs.groupBy(*by).agg(F.avg(distance).alias("mean"), F.max(distance).alias("most"))


def unbound_fraction(final: DataFrame, energy: Column, mass: str = "mass") -> DataFrame:
    """unbound (the share of the mass whose ``energy``, -u_t or -h u_t, is above 1) and n."""
    return final.agg((F.sum(F.when(energy > 1, F.col(mass)).otherwise(0.0)) / F.sum(mass)).alias("unbound"), F.count(F.lit(1)).alias("n"))
