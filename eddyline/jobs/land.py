"""Landing snapshots: from files to FIELD tables that steps, gathers and masses read.

    python -m eddyline.jobs.land --data-dir run/ --output field --keys rho V_u_x V_u_y V_u_z

FIELD(time_idx, i, j, k, <keys>) is partitioned by ``time_idx``, so a run reads its own snapshots and keys only.
"""

from __future__ import annotations

import argparse

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions.geometry import ENERGY_LIMIT, is_sane, sanitised
from eddyline.functions.grid import Grid
from eddyline.functions.keys import GRID_NAMES, key_specs, missing
from eddyline.operators import catalog
from eddyline.shared import content_of, exists, few, plain, record, recorded
from eddyline.sources import vtk


def grid_of(spark: SparkSession, path: str, transform: str | None = "log", scale: float | None = None) -> tuple[Grid, bool]:
    """(the grid of the first of the files at ``path``, whether its polar rows are stored falling)."""
    spark.dataSource.register(vtk.SnapshotVtk)
    first = vtk.read_files(spark, path).agg(F.min("path")).first()[0]
    points = spark.read.format("snapshot_vtk").option("points", "true").load(first)
    r, theta, phi = vtk.grid_axes(points)
    polar = vtk.polar_axis(np.array(theta))
    return Grid((tuple(r), polar.nodes, vtk.even_azimuth(phi)), True, polar.kind, polar.node_centred, transform, scale), polar.flipped


def land(spark: SparkSession, path: str, keys: list[str], output: str, heavy: str = "sum", names: dict[str, str] = GRID_NAMES, flipped: bool = False, n_theta: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(TIMES(time_idx, time), FIELD as written to ``output``) of VTK files: raw values are sanitised and combined to
    ``keys``; of files that give the same scalar at the same time the lexically last counts; polar rows rise. A time that
    lacks a part of a key is an error. A table that was landed from the same files in the same way is taken as it is."""
    spark.dataSource.register(vtk.SnapshotVtk)
    specs = key_specs(keys, names, heavy)
    raw = sorted({r for s in specs for r in s.raw})
    bound = {names.get(k, k) for k in names if k.startswith("eps_")}
    files = vtk.read_files(spark, path)
    times = catalog.snapshots(files).select("time_idx", "time")
    have = files.groupBy("time").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("have"))
    lacks = have.where(F.size(missing(specs, F.col("have"))) > 0).limit(1).collect()
    if lacks:
        raise KeyError(f"time {lacks[0]['time']} lacks a part of {', '.join(keys)}")
    made_of = plain({"files": content_of(files.select("path", "time", "keys")), "keys": keys, "heavy": heavy, "names": names, "flipped": flipped, "n_theta": n_theta})
    if exists(spark, f"{output}/_SUCCESS") and recorded(spark, f"{output}.from") == made_of:
        return times, spark.read.parquet(output)
    last = files.select("time", "path", F.explode("keys").alias("key")).where(F.col("key").isin(raw)).groupBy("time", "key").agg(F.max("path").alias("path"))
    rows = spark.read.format("snapshot_vtk").option("keys", ",".join(raw)).option("runs", "true").load(path)
    rows = rows.join(few(last), ["time", "key", "path"])
    # runs of values of one place meet, not single values; one file has each key
    of = lambda r: F.first(F.when(F.col("key") == r, F.col("values")), ignorenulls=True).alias(r)
    met = rows.groupBy("time", "at", "n_r", "n_theta").agg(*(of(r) for r in raw))
    cells = met.select("time", "at", "n_r", "n_theta", F.posexplode(F.arrays_zip(*(F.col(f"`{r}`").alias(f"v{n}") for n, r in enumerate(raw)))).alias("o", "v"))
    place, sane = F.col("at") + F.col("o"), lambda n, r: sanitised(F.col(f"v.v{n}"), ENERGY_LIMIT if r in bound else None).alias(r)
    row = (F.floor(place / F.col("n_r")) % F.col("n_theta")).cast("int")
    j = F.lit((n_theta or 0) - 1) - row if flipped else row
    wide = cells.select("time", (place % F.col("n_r")).cast("int").alias("i"), j.alias("j"), F.floor(place / F.col("n_r") / F.col("n_theta")).cast("int").alias("k"), *(sane(n, r) for n, r in enumerate(raw)))
    field = wide.join(few(times), "time").select(F.col("time_idx").cast("int"), "i", "j", "k", *(s.column() for s in specs))
    field.write.mode("overwrite").partitionBy("time_idx").parquet(output)
    record(spark, f"{output}.from", made_of)
    return times, spark.read.parquet(output)


def insane(spark: SparkSession, path: str, keys: list[str], names: dict[str, str] = GRID_NAMES) -> DataFrame:
    """path, key, n: how many values of each file landing replaces by 0."""
    spark.dataSource.register(vtk.SnapshotVtk)
    raw = sorted({r for s in key_specs(keys, names) for r in s.raw})
    bound = sorted({names[k] for k in names if k.startswith("eps_")})
    bad = F.when(F.col("key").isin(bound), ~is_sane(F.col("value"), ENERGY_LIMIT)).otherwise(~is_sane(F.col("value")))
    return spark.read.format("snapshot_vtk").option("keys", ",".join(raw)).load(path).where(bad).groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))


def main(arguments: list[str] | None = None) -> None:
    from eddyline.jobs.formats import FORMATS, Options, keep  # which know this module

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--format", choices=sorted(FORMATS), default="vtk")
    p.add_argument("--file-pattern")
    p.add_argument("--output", required=True)
    p.add_argument("--keys", nargs="+")
    p.add_argument("--heavy-neutrinos", choices=("sum", "drop", "separate"), default="sum")
    p.add_argument("--rad-transform", choices=("log", "asinh", "none"))
    p.add_argument("--rad-scale", type=float)
    p.add_argument("--bh-mass", type=float, default=1.0)
    p.add_argument("--reduce", action="store_true", help="of --format surface: all variables, moments reduced to fluxes and energies")
    a = p.parse_args(arguments)
    kind = FORMATS[a.format]
    pattern = a.file_pattern or kind.preset.pattern
    path = f"{a.data_dir}/{pattern if any(c in pattern for c in '*?[]') else '*' + pattern}"
    options = Options(a.rad_transform or kind.preset.transform, a.rad_scale, a.heavy_neutrinos, a.bh_mass, a.reduce)
    spark = SparkSession.builder.getOrCreate()
    keep(spark, kind.land(spark, path, a.keys or list(kind.preset.keys), f"{a.output}/field", options), a.output)


if __name__ == "__main__":
    main()
