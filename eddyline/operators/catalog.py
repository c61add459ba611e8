"""Snapshots as tables: which file has which time and keys, which times a run uses.

FILES(path, time, keys array<string>) describes files; times are doubles that identify a snapshot exactly, and
joins go by ``time_idx``, never by the time itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshots(files: DataFrame) -> DataFrame:
    """time_idx, time, n_files, first_path, last_path: a row for each time, rising; files without a path are left out.
    Paths themselves join back by time, so none are gathered."""
    groups = files.where("path != ''").groupBy("time").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    return groups.withColumn("time_idx", F.row_number().over(Window.orderBy("time")) - 1).select("time_idx", "time", "n_files", "first_path", "last_path")


def incomplete(files: DataFrame, keys: list[str]) -> DataFrame:
    """(time, key) that no file has, of the times that any file has."""
    want = files.select("time").distinct().withColumn("key", F.explode(F.array(*map(F.lit, keys))))
    return want.join(files.select("time", F.explode("keys").alias("key")), ["time", "key"], "left_anti")


def latest_path(values: DataFrame, time: str = "time", key: str = "key", path: str = "path") -> DataFrame:
    """Of rows that give the same key at the same time those of the lexically last path."""
    w = Window.partitionBy(time, key).orderBy(F.desc(path))
    return values.withColumn("__r", F.dense_rank().over(w)).where("__r = 1").drop("__r")


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def nearest_time(seeds: DataFrame, times: DataFrame, width: float) -> DataFrame:
    """``seeds`` (with t0), a row for each row, and the nearest snapshot's time_idx and time, of those within ``width``;
    of two as near the earlier. Settled once for each different t0, by an equi-join on bins of time."""
    near = times.withColumn("__bin", F.explode(F.array(*(F.floor(F.col("time") / width).cast("long") + F.lit(d) for d in (-1, 0, 1)))))
    asked = seeds.select("t0").distinct().withColumn("__bin", F.floor(F.col("t0") / width).cast("long"))
    far = F.struct(F.abs(F.col("time") - F.col("__t0")).alias("d"), F.col("time").alias("time"), F.col("time_idx").alias("time_idx"))
    found = asked.withColumnRenamed("t0", "__t0").join(near.select("__bin", "time_idx", "time"), "__bin", "left").groupBy("__t0").agg(F.min(F.when(F.col("time").isNotNull(), far)).alias("__n"))
    return seeds.join(found, F.col("t0").eqNullSafe(F.col("__t0")), "left").select(*seeds.columns, F.col("__n.time_idx").alias("time_idx"), F.col("__n.time").alias("time"))


def every_nth(times: DataFrame, start: float, end: float, n: int) -> DataFrame:
    """The times of a run from ``start`` to ``end`` (either may be the later), each n-th of them, in its order."""
    low, high = min(start, end), max(start, end)
    order = F.asc("time") if end >= start else F.desc("time")
    w = Window.orderBy(order)
    return times.where(F.col("time").between(low, high)).withColumn("step", F.row_number().over(w) - 1).where(F.col("step") % n == 0)


def step_windows(times: DataFrame) -> DataFrame:
    """Each step's times: before (t_a), its own (t_b, t_c) and after (t_d), null beyond the ends."""
    w = Window.orderBy("time")
    return times.select("time_idx", F.lag("time").over(w).alias("t_a"), F.col("time").alias("t_b"), F.lead("time").over(w).alias("t_c"), F.lead("time", 2).over(w).alias("t_d")).where("t_c is not null")


def chunks(start: int, end: int, size: int, snapshots_per_step: int) -> list[tuple[int, int]]:
    """(first, last) snapshot indices of each chunk from ``start`` to ``end``; neighbours share what a step
    needs of both. Stops at ``end``."""
    stride = size - (snapshots_per_step - 1)
    if stride < 1:
        raise ValueError("a chunk holds fewer snapshots than a step needs")
    way = 1 if end >= start else -1
    return [(i, min(i + way * (size - 1), end) if way > 0 else max(i - (size - 1), end)) for i in range(start, end, way * stride)]


def slot_windows(times: DataFrame, starts: DataFrame) -> DataFrame:
    """slot, i_start, time_idx, n_files, dt: which snapshots count for which slot. ``starts`` (order, t_start) are slot
    boundaries in the run's direction, each of which means the snapshot whose cell it is in, cells parting halfway
    between neighbours. A slot goes from its boundary's snapshot up to before the next one's (after it in a backward
    run), so the last boundary begins no slot; dt is the time between the two, n_files the snapshots that share it.
    Boundaries outside all snapshots, or two in one snapshot, are an error. Snapshots and boundaries are as few
    as a run has, so the windows over them have no partition."""
    w = Window.orderBy("time")
    low = F.coalesce((F.lag("time").over(w) + F.col("time")) / 2, F.col("time"))
    cells = times.select(low.alias("v"), F.lit(0).alias("kind"), F.col("time_idx").cast("long").alias("i"), "time", F.max("time").over(Window.partitionBy(F.lit(0))).alias("top"), F.lit(None).cast("long").alias("order"))
    asked = starts.select(F.col("t_start").cast("double").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("time"), F.lit(None).cast("double").alias("top"), F.col("order").cast("long"))
    seen = Window.orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = cells.unionByName(asked).select("order", "v", *(F.last(c, ignorenulls=True).over(seen).alias(c) for c in ("i", "time", "top"))).where("order is not null")
    inside = F.coalesce(F.col("v") <= F.col("top"), F.lit(False))
    found = found.withColumn("i", F.when(inside, F.col("i")).otherwise(F.raise_error(F.lit("a slot begins outside the snapshots' times")).cast("long")))
    run = Window.orderBy("order")
    pairs = found.select("order", F.col("i").alias("a"), "time", F.lead("i").over(run).alias("b"), F.lead("time").over(run).alias("after")).where("b is not null")
    pairs = pairs.withColumn("b", F.when(F.col("a") != F.col("b"), F.col("b")).otherwise(F.raise_error(F.lit("two slots begin in one snapshot")).cast("long")))
    slots = pairs.select(F.col("order").cast("int").alias("slot"), F.col("a").alias("i_start"), F.explode(F.when(F.col("b") > F.col("a"), F.sequence("a", F.col("b") - 1)).otherwise(F.sequence("a", F.col("b") + 1))).alias("time_idx"), F.abs(F.col("b") - F.col("a")).alias("n_files"), F.abs(F.col("after") - F.col("time")).alias("dt"))
    return slots.withColumn("time_idx", F.col("time_idx").cast("int"))


def nearest_index(radii: DataFrame, wanted: float) -> DataFrame:
    """irad, r: the place among ``radii`` (irad, r) of the one nearest to ``wanted``, of two as near the first."""
    return radii.agg(F.min(F.struct(F.abs(F.col("r") - wanted), "irad", "r")).alias("m")).select("m.irad", "m.r")
