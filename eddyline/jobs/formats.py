"""Kinds of snapshot files: what each can tell (files, grid) and how it becomes a table that runs read.

A ``Format`` is all that landing and runs know of a kind of file; ``register`` adds one. Fields land as FIELD tables of cells
on a ``Grid`` or as BLOCK tables on an ``Octree``, partitioned by ``time_idx``.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions.geometry import sanitised
from eddyline.functions.grid import Grid
from eddyline.functions.keys import BLOCK_NAMES, PRESETS, Preset, key_specs, reduced_moments
from eddyline.functions.octree import Octree
from eddyline.jobs import land as grids
from eddyline.operators import catalog, meshblock
from eddyline.shared import content_of, exists, few, plain, record, recorded
from eddyline.sources import simulation, vtk

VELOCITY = ("V_u_x", "V_u_y", "V_u_z")


@dataclass(frozen=True)
class Options:
    """What landing may be told besides keys: the radial transform, heavy species, the black hole's mass, moments to be reduced."""

    transform: str | None = "log"
    scale: float | None = None
    heavy: str = "sum"
    mass: float = 1.0
    reduce: bool = False


@dataclass(frozen=True)
class Landed:
    """TIMES(time_idx, time), the grid and the table of its values."""

    times: DataFrame
    grid: Grid | Octree
    field: DataFrame


@dataclass(frozen=True)
class Format:
    name: str
    preset: Preset
    files: Callable[[SparkSession, str], DataFrame]
    land: Callable[[SparkSession, str, list[str], str, Options], Landed]


FORMATS: dict[str, Format] = {}


def register(f: Format) -> None:
    FORMATS[f.name] = f


def _vtk(spark: SparkSession, path: str, keys: list[str], output: str, o: Options) -> Landed:
    grid, flipped = grids.grid_of(spark, path, o.transform, o.scale)
    times, field = grids.land(spark, path, keys, output, o.heavy, flipped=flipped, n_theta=grid.shape[1])
    return Landed(times, grid, field)


def _complete(files: DataFrame, raw: list[str]) -> None:
    have = files.groupBy("time").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("have"))
    lacks = have.withColumn("lacks", F.array_except(F.array(*map(F.lit, raw)), "have")).where(F.size("lacks") > 0).limit(1).collect()
    if lacks:
        raise KeyError(f"time {lacks[0]['time']} lacks {', '.join(sorted(lacks[0]['lacks']))}")


def _written(spark: SparkSession, field: Callable[[], DataFrame], output: str, made_of: dict) -> DataFrame:
    """The table at ``output``: what lies there if it was made of the same, else ``field()``."""
    made_of = plain(made_of)
    if not exists(spark, f"{output}/_SUCCESS") or recorded(spark, f"{output}.from") != made_of:
        field().write.mode("overwrite").partitionBy("time_idx").parquet(output)
        record(spark, f"{output}.from", made_of)
    return spark.read.parquet(output)


def _blocks(spark: SparkSession, path: str, keys: list[str], output: str, o: Options) -> Landed:
    """BLOCK(time_idx, block_id, x1v, x2v, x3v, <keys>), values sanitised, velocities made Cartesian, polar nodes rising. Where several
    files give a variable at one time the lexically last counts; values meet by block only if a time has several files."""
    files = simulation.read_files(spark, path, simulation.BlocksHdf5)
    layout = simulation.read_layout(files.agg(F.min("path")).first()[0])
    direct = {k: BLOCK_NAMES.get(k, k) for k in keys if k not in VELOCITY}
    raw = sorted({*direct.values(), *(simulation.RAW_VELOCITY if set(keys) & {*VELOCITY} else ())})
    _complete(files, raw)
    times = catalog.snapshots(files).select("time_idx", "time")

    def made() -> DataFrame:
        last = simulation.latest(files, raw)
        read = spark.read.format("blocks_hdf5").options(keys=",".join(raw), layout=layout.digest).load(path).join(few(last), ["time", "path"])
        sane = lambda k: F.transform(F.col(f"`{k}`"), lambda v: sanitised(v))
        own = ["block_id", "x1v", "x2v", "x3v", "x2f"]
        several = not last.groupBy("time").count().where("count > 1").isEmpty()
        if several:
            mine = [F.first(F.when(F.array_contains("mine", k), F.col(f"`{k}`")), ignorenulls=True).alias(k) for k in raw]  # one file has it
            read = read.groupBy("time", "block_id").agg(*(F.first(c).alias(c) for c in own[1:]), *mine)
        rows = read.join(few(times), "time").select(F.col("time_idx").cast("int").alias("time_idx"), *own, *(sane(k).alias(k) for k in raw))
        u = [F.col(k) if k in raw else F.transform(F.col(f"`{raw[0]}`"), lambda v: F.lit(0.0)) for k in simulation.RAW_VELOCITY]
        named = rows.select("time_idx", *own, *(c.alias(f"u{n}") for n, c in enumerate(u, 1)), *(F.col(f"`{r}`").alias(k) for k, r in direct.items()))
        return meshblock.landed(named, layout.ghosts, o.mass).select("time_idx", "block_id", "x1v", "x2v", "x3v", *keys)

    made_of = {"files": content_of(files.select("path", "time", "keys", "layout")), "keys": keys, "mass": o.mass}
    return Landed(times, layout.octree, _written(spark, made, output, made_of))


def _surface(spark: SparkSession, path: str, keys: list[str], output: str, o: Options) -> Landed:
    """FIELD of surfaces, raw or reduced before: a row a cell. With ``reduce`` all variables land, moments reduced to fluxes and
    energies; else ``keys`` do."""
    files = simulation.read_files(spark, path, simulation.SurfaceHdf5)
    first = files.agg(F.min("path")).first()[0]
    radii, theta, phi = simulation.read_axes(first)
    order = sorted(range(len(radii)), key=lambda i: radii[i])
    polar = vtk.polar_axis(theta)
    grid = Grid((tuple(radii[i] for i in order), polar.nodes, vtk.even_azimuth(phi.tolist())), True, polar.kind, polar.node_centred, o.transform, o.scale)
    specs = key_specs(keys, {}, "separate")
    raw = sorted(k for (k,) in files.select(F.explode("keys")).distinct().collect()) if o.reduce else sorted({r for s in specs for r in s.raw})
    if not o.reduce:
        _complete(files, raw)
    times = catalog.snapshots(files).select("time_idx", "time")

    def made() -> DataFrame:
        last = simulation.latest(files, raw)
        rows = spark.read.format("surface_hdf5").option("keys", ",".join(raw)).load(path).join(few(last), ["time", "path"]).where(F.array_contains("mine", F.col("key")))
        wide = rows.groupBy("time", "i").agg(*(F.first(F.when(F.col("key") == k, F.col("values")), ignorenulls=True).alias(k) for k in raw))
        cells = wide.select("time", "i", F.posexplode(F.arrays_zip(*(F.col(f"`{k}`").alias(f"v{n}") for n, k in enumerate(raw)))).alias("at", "v"))
        rank = F.element_at(F.array(*(F.lit(order.index(i)) for i in range(len(radii)))), F.col("i") + 1)
        row = F.floor(F.col("at") / len(phi)).cast("int")
        j = F.lit(len(theta) - 1) - row if polar.flipped else row
        named = cells.join(few(times), "time").select(F.col("time_idx").cast("int").alias("time_idx"), rank.alias("i"), j.alias("j"), (F.col("at") % len(phi)).cast("int").alias("k"), *(sanitised(F.col(f"v.v{n}")).alias(k) for n, k in enumerate(raw)))
        return reduced_moments(named) if o.reduce else named.select("time_idx", "i", "j", "k", *(s.column() for s in specs))

    made_of = {"files": content_of(files.select("path", "time", "keys")), "keys": keys, "reduce": o.reduce}
    return Landed(times, grid, _written(spark, made, output, made_of))


register(Format("vtk", PRESETS["grid"], vtk.read_files, _vtk))
register(Format("blocks", PRESETS["blocks"], lambda spark, path: simulation.read_files(spark, path, simulation.BlocksHdf5), _blocks))
register(Format("surface", PRESETS["surface"], lambda spark, path: simulation.read_files(spark, path, simulation.SurfaceHdf5), _surface))


def keep(spark: SparkSession, landed: Landed, folder: str) -> None:
    """Writes times and grid beside the field, so that ``kept`` finds all three."""
    landed.times.write.mode("overwrite").parquet(f"{folder}/times")
    values = {f.name: getattr(landed.grid, f.name) for f in dataclasses.fields(landed.grid) if f.name != "table"}
    record(spark, f"{folder}/grid", {"kind": type(landed.grid).__name__, **values})


def kept(spark: SparkSession, folder: str) -> Landed:
    """What a landing job left in ``folder``."""
    told = recorded(spark, f"{folder}/grid")
    if told is None:
        raise FileNotFoundError(f"{folder}: no grid was landed there")
    deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
    grid = {"Grid": Grid, "Octree": Octree}[told.pop("kind")](**{k: deep(v) for k, v in told.items()})
    return Landed(spark.read.parquet(f"{folder}/times"), grid, spark.read.parquet(f"{folder}/field"))
