"""Particles carried along by a flow.

STATE(tracer_id, x, y, z, time, status) is small and mutable, the flow large and fixed. Three forms:

* Columns: a fixed number of unrolled steps for closed-form flows, all in the JVM (`column_steps`).
* Closed-form flows in tasks: `advance_chunk` takes every particle through a run of times in one `mapInPandas`,
  `advance` walks the chunks.
* Snapshots: `advance_snapshots` steps through a FIELD table. Each step is a job or a few: particles meet the tile of the field
  that they are in, for all snapshots that the scheme needs, take the whole step there and read every wanted key at
  its end. The step's rows are written and are the next step's state, so lineage never grows with time, a lost
  executor costs a task, and a run that was broken off goes on behind its last complete step.

Implicit steps stop particle by particle, so results don't depend on how particles are dealt to tasks. Positions that
aren't finite end a particle. Integration runs either way in time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions.grid import Grid
from eddyline.functions.octree import Octree
from eddyline.functions.stencil import midpoint_weights, pchip4_np
from eddyline.operators import blockstep, catalog, staged, tiles as tiling
from eddyline.shared import OtherRun, claim, content_of, exists, recorded, source_of

SCHEMA = "tracer_id long, time double, x double, y double, z double, status string"


def euler(v, p, t, dt):
    return p + dt * v(p, t)


def heun(v, p, t, dt):
    v0 = v(p, t)
    return p + dt / 2 * (v0 + v(p + dt * v0, t + dt))


def implicit_trapezoid(v, p, t, dt, tol: float = 1e-8, max_iter: int = 20, relax: float = 1.0):
    """Picard iteration; each tracer stops by itself, with its last iterate if it never settles."""
    v0 = v(p, t)
    new, open_ = p + dt * v0, np.ones(p.shape[1], bool)
    for _ in range(max_iter):
        asked = np.where(open_, new, np.nan)  # those that have settled ask for nothing
        step = relax * (p + dt / 2 * (v0 + v(asked, t + dt)) - new)
        new = np.where(open_, new + step, new)
        settled = np.sqrt((step * step).sum(0)) <= tol * np.maximum(1, np.sqrt((new * new).sum(0)))
        open_ &= ~settled & np.isfinite(new).all(0)
        if not open_.any():
            break
    return new


def runge_kutta(v, p, t, dt, mode: str = "exact", window: list[float] | None = None):
    """Fourth order. ``mode`` says where velocities at the middle come from: ``exact`` (the flow itself), or the four
    snapshot times of ``window`` around the step by ``lagrange`` weights or the ``monotone`` cubic. Without a window, at
    the first and last snapshots of a run, such a step is an explicit trapezoid."""
    if mode != "exact" and window is None:
        return heun(v, p, t, dt)

    def middle(q):
        if mode == "exact":
            return v(q, t + dt / 2)
        samples, times = np.stack([v(q, s) for s in window]), np.array(window, float)
        if mode == "lagrange":
            return np.tensordot(midpoint_weights(list(times)), samples, 1)
        if times[-1] < times[0]:
            samples, times = samples[::-1], times[::-1]
        nodes = times.reshape(4, *[1] * (samples.ndim - 1)) * np.ones_like(samples)
        return pchip4_np(nodes, samples, np.full(samples.shape[1:], (times[1] + times[2]) / 2))

    k1 = v(p, t)
    k2 = middle(p + dt / 2 * k1)
    k3 = middle(p + dt / 2 * k2)
    return p + dt / 6 * (k1 + 2 * k2 + 2 * k3 + v(p + dt * k3, t + dt if window is None else window[2]))


def around(times: list, n: int) -> list | None:
    """The four times around the step from the n-th, if there are that many."""
    return times[n - 1 : n + 3] if 0 < n < len(times) - 2 else None


SCHEMES = {"euler": euler, "expl_trap": heun, "impl_trap": implicit_trapezoid, "rk4": runge_kutta}


def column_steps(state: DataFrame, flow, scheme: str, dt: float, n_steps: int) -> DataFrame:
    """``state`` (tracer_id, x, y, z, time) after n steps of ``euler``, ``expl_trap`` or ``rk4`` on an analytic
    flow, as plain projections."""
    out = state
    for _ in range(n_steps):
        p, t = [F.col(c) for c in "xyz"], F.col("time")

        def staged(df: DataFrame, at: list[Column], when: Column, name: str) -> DataFrame:
            return df.withColumns({f"__{name}{c}": v for c, v in zip("xyz", flow.velocity(*at, when), strict=True)})

        def moved(name: str, h: float) -> list[Column]:
            return [F.col(c) + h * F.col(f"__{name}{c}") for c in "xyz"]

        out = staged(out, p, t, "a")
        if scheme == "euler":
            new = moved("a", dt)
        elif scheme == "expl_trap":
            out = staged(out, moved("a", dt), t + dt, "b")
            new = [F.col(c) + dt / 2 * (F.col(f"__a{c}") + F.col(f"__b{c}")) for c in "xyz"]
        elif scheme == "rk4":
            out = staged(out, moved("a", dt / 2), t + dt / 2, "b")
            out = staged(out, moved("b", dt / 2), t + dt / 2, "c")
            out = staged(out, moved("c", dt), t + dt, "d")
            new = [F.col(c) + dt / 6 * (F.col(f"__a{c}") + 2 * F.col(f"__b{c}") + 2 * F.col(f"__c{c}") + F.col(f"__d{c}")) for c in "xyz"]
        else:
            raise ValueError(f"no column form of {scheme!r}")
        out = out.select(*(c for c in state.columns if c not in ("x", "y", "z", "time")), *(n.alias(c) for n, c in zip(new, "xyz", strict=True)), (t + dt).alias("time"))
    return out


def advance_chunk(state: DataFrame, flow, times: list[float], scheme: str = "impl_trap", records_only_last: bool = False, span: tuple[int, int] | None = None, **options) -> DataFrame:
    """TRAJ rows of every particle through ``times`` (from the first to the second index of ``span``, if given): those that
    wait start at theirs, which must be one of ``times``; those that are done stay so. ``flow`` is pickled to tasks."""
    step = SCHEMES[scheme]
    forward = times[-1] >= times[0]
    first, last_index = span or (0, len(times) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids, p, t0 = batch["tracer_id"].to_numpy(), batch[["x", "y", "z"]].to_numpy(float).T.copy(), batch["time"].to_numpy(float)
            done = (batch["status"] == "done").to_numpy()
            rows = []

            def record(mask, t, final=False):
                if mask.any() and (final or not records_only_last):
                    rows.append(pd.DataFrame({"tracer_id": ids[mask], "time": t if np.ndim(t) == 0 else t[mask], "x": p[0, mask], "y": p[1, mask], "z": p[2, mask], "status": np.where(done[mask], "done", "active")}))

            last = t0.copy()
            for n in range(first, last_index):
                a, b = times[n], times[n + 1]
                on = ~done & ((t0 <= a) if forward else (t0 >= a))
                if not on.any():
                    continue
                more = {"window": around(times, n)} if options.get("mode", "exact") != "exact" else {}
                new = step(flow.velocity_np, p[:, on], a, b - a, **options, **more)
                fine = np.isfinite(new).all(0)
                at = np.flatnonzero(on)
                p[:, at[fine]] = new[:, fine]
                done[at[~fine]] = True
                last[at[fine]] = b
                moved = np.zeros(len(ids), bool)
                moved[at[fine]] = True
                record(moved, b)
            if records_only_last:
                record(np.ones(len(ids), bool), last, True)
            if rows:
                yield pd.concat(rows)

    return state.select("tracer_id", "x", "y", "z", "time", "status").mapInPandas(run, SCHEMA)


#: The embedded pair of orders 5 and 4 by Dormand and Prince; stage times, stage weights, and the pair's difference.
_STAGE_TIMES = (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1)
_STAGE_WEIGHTS = (
    (),
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
    (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
_DIFFERENCE = (71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)


def adaptive(v, p: np.ndarray, start: np.ndarray, end: float, rtol: float = 1e-13, atol: float = 1e-14, most: int = 100_000) -> np.ndarray:
    """``p`` (3, n) carried by ``v(p, t)`` (times an array, one a particle) from its ``start`` to ``end``: each particle takes steps
    of its own, as long as its estimated error allows, the last one ending at ``end``. Positions that don't stay finite are NaN."""
    out, t = np.array(p, float), np.array(start, float)
    way = np.sign(end - t)
    h = np.abs(end - t) / 100
    on = (way != 0) & np.isfinite(out).all(0)
    for _ in range(most):
        live = np.flatnonzero(on)
        if not len(live):
            return out
        left = np.abs(end - t[live])
        step = np.minimum(h[live], left) * way[live]
        q, k = out[:, live], []
        for c, weights in zip(_STAGE_TIMES, _STAGE_WEIGHTS, strict=True):
            k.append(v(q + step * sum((w * s for w, s in zip(weights, k, strict=True)), np.zeros_like(q)), t[live] + c * step))
        new = q + step * sum(w * s for w, s in zip(_STAGE_WEIGHTS[-1], k[:-1], strict=True))
        scale = atol + rtol * np.maximum(np.abs(q), np.abs(new))
        with np.errstate(invalid="ignore"):
            error = np.sqrt(np.mean((step * sum(w * s for w, s in zip(_DIFFERENCE, k, strict=True)) / scale) ** 2, 0))
        lost = ~np.isfinite(error)
        fine = error <= 1
        out[:, live[fine]] = new[:, fine]
        there = fine & (np.abs(step) >= left)
        t[live] = np.where(there, end, np.where(fine, t[live] + step, t[live]))
        h[live] = np.abs(step) * np.clip(0.9 * np.where(lost, 1, np.maximum(error, 1e-10)) ** -0.2, 0.2, 5)
        out[:, live[lost]] = np.nan
        on[live[there | lost]] = False
    raise ValueError(f"a particle needs more than {most} steps")


def reference(state: DataFrame, flow, times: list[float], rtol: float = 1e-13, atol: float = 1e-14) -> DataFrame:
    """TRAJ rows of ``state`` (as ``advance_chunk`` takes it) at ``times``, by ``adaptive``: what fixed steps are held against.
    Any start times, those before the first of ``times`` (in their order) included; a particle that ends has no further row."""
    forward = times[-1] >= times[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, p, at = batch["tracer_id"].to_numpy(), batch[["x", "y", "z"]].to_numpy(float).T.copy(), batch["time"].to_numpy(float).copy()
            for t in times:
                due = (at <= t) if forward else (at >= t)
                due &= np.isfinite(p).all(0)
                p[:, due] = adaptive(flow.velocity_np, p[:, due], at[due], t, rtol, atol)
                at[due] = t
                due &= np.isfinite(p).all(0)
                if due.any():
                    yield pd.DataFrame({"tracer_id": ids[due], "time": float(t), "x": p[0, due], "y": p[1, due], "z": p[2, due], "status": "active"})

    return state.select("tracer_id", "x", "y", "z", "time", "status").mapInPandas(run, SCHEMA)


def seed_state(seeds: DataFrame, t0: Column | None = None) -> DataFrame:
    """STATE of seeds (tracer_id, x, y, z): active from ``t0`` (or their own column t0) on."""
    return seeds.select("tracer_id", "x", "y", "z", (F.col("t0") if t0 is None else t0).cast("double").alias("time"), F.lit("active").alias("status"))


def snapped(seeds: DataFrame, times: list[float]) -> DataFrame:
    """``seeds`` (with t0) and the time_idx in ``times`` that t0 means; an error where t0 isn't close to any."""
    spark = seeds.sparkSession
    table = spark.createDataFrame([(n, float(t)) for n, t in enumerate(times)], "time_idx int, time double")
    width = max((abs(b - a) for a, b in zip(times, times[1:])), default=1.0) or 1.0
    near = catalog.nearest_time(seeds, table, width)
    fits = F.coalesce(catalog.is_close(F.col("t0"), F.col("time")), F.lit(False))
    return near.withColumn("time_idx", F.when(fits, F.col("time_idx")).otherwise(F.raise_error(F.concat(F.lit("no snapshot at a seed's time "), F.coalesce(F.col("t0").cast("string"), F.lit("null")))).cast("int"))).drop("time")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``; one that is complete there already, from a run that was broken off, is taken."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _named(flow) -> str:
    return f"{type(flow).__qualname__}({', '.join(f'{k}={v!r}' for k, v in sorted(vars(flow).items()))})"


def advance(seeds: DataFrame, flow, times: list[float], folder: str, scheme: str = "impl_trap", chunk: int = 10, **options) -> DataFrame:
    """TRAJ(tracer_id, time, x, y, z, status) of seeds (tracer_id, x, y, z, t0) through all ``times`` of a closed-form flow,
    written chunk by chunk below ``folder``: the seeds' own rows first, then a table a chunk. Chunks that are there already
    are taken if they come from the same seeds, flow, scheme and times, which may go on behind whole chunks; else it
    is an error (``OtherRun``)."""
    spark = seeds.sparkSession
    made_of = {"seeds": content_of(seeds.select("tracer_id", "x", "y", "z", "t0")), "flow": _named(flow), "scheme": scheme, "options": options, "chunk": chunk, "times": [float(t) for t in times]}
    before = (recorded(spark, folder) or {}).get("times", times)
    if len(before) < len(times) and (len(before) - 1) % chunk:
        raise OtherRun(f"{folder} ends within a chunk of {chunk} steps, after {len(before) - 1}: it can't go on")
    claim(spark, folder, made_of, "times")
    start = spark.createDataFrame([(n, float(t)) for n, t in enumerate(times)], "time_idx int, __t double")
    names = "tracer_id", "time", "x", "y", "z", "status"
    own = seed_state(snapped(seeds, times).join(F.broadcast(start), "time_idx").withColumn("t0", F.col("__t")))
    state = written(own.select(*names), f"{folder}/chunks/chunk=0")
    for n, at in enumerate(range(0, len(times) - 1, chunk), 1):
        new = written(advance_chunk(state, flow, times, scheme, span=(at, min(at + chunk, len(times) - 1)), **options).select(*names), f"{folder}/chunks/chunk={n}")
        ahead = F.max_by(F.struct("time", "x", "y", "z", "status"), F.col("time") if times[-1] >= times[0] else -F.col("time")).alias("s")
        state = written(state.unionByName(new).groupBy("tracer_id").agg(ahead).select("tracer_id", "s.*").select(*names), f"{folder}/states/state={n}")
        if state.where("status = 'active'").isEmpty():
            break
    return spark.read.parquet(f"{folder}/chunks").select(*names)


def advance_snapshots(seeds: DataFrame, field: DataFrame, grid: Grid | Octree, times: list[float], start: int, end: int, folder: str, keys: list[str], vel_keys: list[str], scheme: str = "impl_trap", method: str = "pchip", size: int = tiling.SIZE, together: int = 1, **options) -> DataFrame:
    """TRAJ(tracer_id, time_idx, time, x, y, z, <keys>) of seeds (tracer_id, x, y, z, t0) through the snapshots ``start`` to
    ``end`` (indices in ``times``, either may be the later) of FIELD(time_idx, i, j, k, ...), all keys read at every
    record, the first included. A row's position may lie where its values are NaN: the particle has just left. Steps that
    lie in ``folder`` already are taken if all these, seeds and field included, were the same; else it is an error (``OtherRun``).
    With an ``Octree`` for a grid ``field`` is a BLOCK table, see ``blockstep``. Stages may lie in any tile or block, see ``staged``,
    which takes ``together`` steps a job: results are the same to the bit, and a task holds its tile at that many snapshots and three."""
    if together < 1:
        raise ValueError("a job takes a step or more")
    made_of = {"seeds": content_of(seeds.select("tracer_id", "x", "y", "z", "t0")), "field": source_of(field), "grid": hashlib.sha256(repr(grid).encode()).hexdigest()[:16], "times": [float(t) for t in times]}
    claim(seeds.sparkSession, folder, made_of | {"start": start, "end": end, "keys": keys, "vel_keys": vel_keys, "scheme": scheme, "method": method, "size": size, "together": together, "options": options})
    low, high = max(0, min(start, end) - 1), min(len(times) - 1, max(start, end) + 1)
    if scheme == "rk4":
        options = {"mode": "monotone", **options}
    names = list(dict.fromkeys([*vel_keys, *keys]))
    used = field.where(F.col("time_idx").between(low, high))
    if isinstance(grid, Octree):
        space, parts = blockstep.Space(grid), blockstep.parts(used)
    else:
        space, at = tiling.Space(grid, size, method), f"{folder}/tiles"
        if not exists(seeds.sparkSession, f"{at}/_SUCCESS"):
            tiling.tiled(used, grid, names, size, space.halo).write.mode("overwrite").partitionBy("time_idx").parquet(at)
        parts = seeds.sparkSession.read.parquet(at)
    placed = snapped(seeds, times).select("tracer_id", *(F.col(c).cast("double") for c in "xyz"), "time_idx")
    begin = written(staged.located(placed, space, ["x", "y", "z"]), f"{folder}/seeds")
    return staged.walk(begin, parts, space, SCHEMES[scheme], written, times, start, end, folder, keys, vel_keys, scheme, together, **options)


def statuses(seeds: DataFrame, traj: DataFrame, end: float, forward: bool = True) -> DataFrame:
    """tracer_id, status of every seed: not started (no record beyond its seed), done (it ended before ``end``) or active."""
    last = traj.groupBy("tracer_id").agg(F.count(F.lit(1)).alias("n"), (F.max("time") if forward else F.min("time")).alias("t"))
    joined = seeds.select("tracer_id").join(last, "tracer_id", "left")
    return joined.select("tracer_id", F.when(F.coalesce("n", F.lit(0)) <= 1, F.lit("not started")).when(F.col("t") == end, F.lit("active")).otherwise(F.lit("done")).alias("status"))
