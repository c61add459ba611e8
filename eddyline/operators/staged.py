"""Steps of particles whose stages may lie in different parts of a divided field.

A part (a tile of a grid, a block of a refined one) is a row of a table for each snapshot, and owns the points in it. Its
particles meet the rows that the scheme needs and take the step there. Where a stage's point belongs to another part, that
particle stops at that stage and goes, with the velocities that it has found so far, to the part that owns the point, where
the scheme is run again on them and goes on. So parts are no wider than their stencils need, however far a predictor flies,
values come from the owner whoever computes, and results don't depend on how particles are dealt. Only those that cross take
part in a further round; a step has as many rounds as the most parts that one particle's stages visit.

A job may take several steps: its parts come with all snapshots of the run's next ``together`` steps, and a particle goes on from step
to step where it is until it crosses. Each is then at a step of its own (``at``), and a job's rounds are the most crossings of
one particle in all these steps, not the sum of each step's most. Only a part's rows from its latest particle on are sent.

A ``space`` has ``coordinates(p)``, ``find(x)`` (the owners, -1 outside), ``columns(names)`` (what its rows hold) and
``readers(table, names)`` (by time_idx a function from coordinates to values).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.operators import catalog, tiles as tiling


class Stages:
    """The velocity that a scheme asks for: answers of earlier rounds first (an array of (particles, calls, 3), the first ``known`` calls
    of each particle's), then those that this block can give. ``stopped`` holds the block that a particle must go to for its
    next one, -1 while it needn't."""

    def __init__(self, space, block: int, read, before: np.ndarray, known: np.ndarray):
        self.space, self.block, self.read, self.before = space, block, read, before
        self.known, self.stopped, self.calls = known.copy(), np.full(len(known), -1, np.int64), []

    def __call__(self, q: np.ndarray, t: float) -> np.ndarray:
        n, out = len(self.calls), np.full(q.shape, np.nan)
        have = self.known > n
        if have.any():
            out[:, have] = self.before[have, n].T
        ask = np.flatnonzero(~have & (self.stopped < 0))
        if len(ask):
            x = self.space.coordinates(q[:, ask])
            home = self.space.find(x)
            away, mine = (home >= 0) & (home != self.block), home == self.block
            self.stopped[ask[away]] = home[away]
            self.known[ask[~away]] += 1
            if mine.any():
                out[:, ask[mine]] = self.read(x[:, mine], t)
        self.calls.append(out)
        return out

    def answers(self, i: int) -> list[float]:
        return [v for c in self.calls[: self.known[i]] for v in c[:, i].tolist()]


def located(points: DataFrame, space, place: list[str]) -> DataFrame:
    """``points`` with the part (``tile``) that owns each."""

    def run(batches):
        for batch in batches:
            p = np.stack([np.asarray(batch[c], float) for c in place]) if len(batch) else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.find(space.coordinates(p)), pa.int64())], [*batch.schema.names, "tile"])

    return points.mapInArrow(run, f"{tiling._ddl(points.schema)}, tile long")


def needed(n: int, last: int, way: int, scheme: str) -> list[int]:
    """Snapshots that the step from the n-th needs, in order; a wide scheme has two where there aren't four."""
    wide = [n - way, n, n + way, n + 2 * way]
    return wide if scheme == "rk4" and 0 <= min(wide) and max(wide) <= last else [n, n + way]


def stepped(particles: DataFrame, parts: DataFrame, space, step: Callable, times: list[float], first: int, last: int, keys: list[str], vel_keys: list[str], scheme: str, **options) -> DataFrame:
    """tracer_id, time_idx, time, x, y, z, status, tile, starts, answers and <keys> of ``particles`` (tracer_id, x, y, z, at, starts,
    answers, tile) at each snapshot behind theirs (``at``, from ``first`` to ``last``) up to ``last``, and at their own of those that
    start there. Status ``again`` marks those that go on in another part, which ``tile`` says, from ``time_idx`` with their ``answers``."""
    way = 1 if last >= first else -1
    whole = [*range(first, last, way), last]  # the snapshots of which more than velocities are wanted
    windows = {n: needed(n, len(times) - 1, way, scheme) for n in whole[:-1]}
    need = sorted({*whole, *(i for window in windows.values() for i in window)})
    names = list(dict.fromkeys([*vel_keys, *keys]))
    right = parts.where(F.col("time_idx").isin(need)).select("time_idx", "tile", *space.columns(names))
    for k in names:
        if k not in vel_keys and len(need) > len(whole):
            right = right.withColumn(k, F.when(F.col("time_idx").isin(whole), F.col(k)))
    left = particles.select("tracer_id", "x", "y", "z", "at", "starts", "answers", "tile")
    before_it = max((way * (n - i) for n, window in windows.items() for i in window), default=0)  # snapshots that a step needs before its own
    left, right = tiling._dealt(left, right, ["tile"], (F.col("at") * way - before_it, F.col("time_idx") * way), len(whole) - 1)
    order, speed = (np.array([names.index(k) for k in ks], int) for ks in (keys, vel_keys))

    def run(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = mine.sort_by("tracer_id")
        block = int(key[0].as_py())
        held = space.readers(theirs, names)
        p = np.stack([mine[c].to_numpy().astype(float) for c in "xyz"])
        ids, at, starts = mine["tracer_id"].to_numpy(), mine["at"].to_numpy().copy(), mine["starts"].to_numpy(zero_copy_only=False).astype(bool)
        known = mine["answers"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) // 3
        before = np.full((len(ids), known.max(initial=0), 3), np.nan)
        before[np.arange(before.shape[1]) < known[:, None]] = mine["answers"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        kinds = [pa.int64(), pa.int32(), pa.float64(), *[pa.float64()] * 3, pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), *[pa.float64()] * len(keys)]
        columns = ["tracer_id", "time_idx", "time", "x", "y", "z", "status", "tile", "starts", "answers", *keys]
        tables = []

        def values(x, i):
            return held[i](x) if i in held else np.full((len(names), x.shape[1]), np.nan)

        def record(who, i, pos, tile, status, began, read, answers=None):
            k = len(who)
            found = answers if answers is not None else pa.ListArray.from_arrays(pa.array(np.zeros(k + 1, np.int32)), pa.array([], pa.float64()))
            row = [ids[who], np.full(k, i, np.int32), np.full(k, times[i]), *pos, np.array([status] * k, object), tile, np.full(k, began), found, *read]
            tables.append(pa.table([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(row, kinds, strict=True)], names=columns))

        for n in whole:
            on = np.flatnonzero(at == n)
            begin = on[starts[on]]  # a start is read where it lies, which is where it is dealt first
            if len(begin):
                record(begin, n, p[:, begin], np.full(len(begin), block), "active", True, values(space.coordinates(p[:, begin]), n)[order])
                starts[begin] = False
            if n == last or not len(on):
                continue
            to, index = n + way, {times[i]: i for i in windows[n]}
            read = lambda x, t, index=index, to=to: values(x, index[t if t in index else times[to]])[speed]  # noqa: E731  t + dt may round
            stages = Stages(space, block, read, before[on], known[on])
            window = {"window": [times[i] for i in windows[n]] if len(windows[n]) == 4 else None} if scheme == "rk4" else {}
            new = step(stages, p[:, on], times[n], times[to] - times[n], **options, **window)
            fine = np.isfinite(new).all(0) & (stages.stopped < 0)
            x = space.coordinates(np.where(fine, new, np.nan))
            home = space.find(x)
            leaves = fine & (home >= 0) & (home != block)  # its values are read where it ends
            stopped = np.where(leaves, home, stages.stopped)
            fine &= ~leaves
            again = np.flatnonzero(stopped >= 0)
            if len(again):
                answers = pa.array([stages.answers(i) for i in again], pa.list_(pa.float64()))
                record(on[again], n, p[:, on[again]], stopped[again], "again", False, np.full((len(keys), len(again)), np.nan), answers)
            there = np.full((len(names), len(on)), np.nan)
            own = fine & (home == block)
            there[:, own] = values(x[:, own], to)
            record(on[fine], to, new[:, fine], home[fine], "active", False, there[order][:, fine])
            p[:, on[fine]] = new[:, fine]
            at[on] = np.where(fine, to, -1)
            known[on] = 0
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], kind) for kind in kinds], names=columns)

    on = ["tile", "share"]
    schema = "tracer_id long, time_idx int, time double, x double, y double, z double, status string, tile long, starts boolean, answers array<double>, " + ", ".join(f"`{k}` double" for k in keys)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def walk(begin: DataFrame, parts: DataFrame, space, step: Callable, written: Callable, times: list[float], start: int, end: int, folder: str, keys: list[str], vel_keys: list[str], scheme: str, together: int = 1, **options) -> DataFrame:
    """TRAJ(tracer_id, time_idx, time, x, y, z, <keys>) of ``begin`` (tracer_id, x, y, z, time_idx, tile) through the snapshots
    ``start`` to ``end`` of ``parts``, ``together`` steps a job, each round's rows written by ``written`` below ``folder``."""
    spark: SparkSession = begin.sparkSession
    way = 1 if end >= start else -1
    starting = {r["time_idx"] for r in begin.select("time_idx").distinct().collect()}
    none, state = F.array().cast("array<double>").alias("answers"), None
    runs = catalog.chunks(start, end, together + 1, 2) or ([(end, end)] if end in starting else [])
    for first, last in runs:
        if state is not None and not any((i - first) * way >= 0 for i in starting) and state.isEmpty():
            break
        begins = [n for n in range(first, last + way, way) if n != last or n == end]  # those at its last snapshot start the next
        particles = begin.where(F.col("time_idx").isin(begins)).select("tracer_id", "x", "y", "z", F.col("time_idx").cast("int").alias("at"), F.lit(True).alias("starts"), none, "tile")
        if state is not None:
            particles = particles.unionByName(state.withColumns({"at": F.lit(first), "starts": F.lit(False), "answers": none}))
        paths = []
        while True:
            paths.append(f"{folder}/steps/step={first:06d}/part={len(paths)}")
            found = stepped(particles, parts, space, step, times, first, last, keys, vel_keys, scheme, **options)
            again = written(found, paths[-1]).where("status = 'again'")
            if again.isEmpty():
                break
            particles = again.select("tracer_id", "x", "y", "z", F.col("time_idx").alias("at"), "starts", "answers", "tile")
        state = spark.read.schema(found.schema).parquet(*paths).where((F.col("status") == "active") & (F.col("time_idx") == last)).select("tracer_id", "x", "y", "z", "tile")
    if state is None:
        raise ValueError("no step lies between the start and the end")
    return spark.read.parquet(f"{folder}/steps").where("status = 'active'").select("tracer_id", F.col("time_idx").cast("int"), "time", "x", "y", "z", *keys)
