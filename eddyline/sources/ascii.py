"""Trajectories as text, a file a tracer: a line of properties, a line of names, then records.

    # mass=1.5; status=done
    # time x y z rho
      0.0000000000000000e+00 ...

Reading keeps one file a row until its records are exploded in the JVM. Writing deals whole tracers to tasks; a
task writes a file under a name of its own attempt and renames it, so a repeated attempt replaces it whole.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole_files(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """filename, props, names, rows, parsed: a row a file; ``parsed`` is whether it is a trajectory with all ``keys``."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("filename"), F.split("value", "\r?\n").alias("lines"))
    line = lambda n: F.coalesce(F.try_element_at("lines", F.lit(n)), F.lit(""))
    head = F.regexp_replace(line(1), r"^#\s*", "")
    names = F.transform(F.split(F.trim(F.regexp_replace(line(2), r"^#\s*", "")), r"\s+"), lambda n: F.element_at(F.split(n, r"\."), -1))
    files = lines.select("filename", "lines", F.when(head.contains("="), F.str_to_map(head, F.lit("; *"), F.lit("="))).alias("props"), names.alias("names"))
    wanted = F.array(*map(F.lit, ["time", *keys]))
    parsed = (F.size("lines") > 2) & F.col("props").isNotNull() & (F.size(F.array_except(wanted, F.col("names"))) == 0)
    return files.select("filename", "props", "names", F.when(F.size("lines") > 2, F.slice("lines", 3, F.size("lines"))).alias("rows"), parsed.alias("parsed"))


def broken_files(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """filename of what ``read_trajectories`` leaves out because its properties or names don't parse or a key lacks."""
    return _whole_files(spark, path, keys).where(~F.col("parsed")).select("filename")


def read_trajectories(spark: SparkSession, path: str, keys: list[str], statuses: list[str] | None = None, some: bool = False) -> DataFrame:
    """filename, props (map of strings), time and ``keys`` (the last part of dotted names counts) of the files that parse (see
    ``broken_files``) and have one of ``statuses``. With ``some``, that there are none is an error."""
    wanted = ["time", *keys]
    files = _whole_files(spark, path, keys).where("parsed")
    if statuses:
        files = files.where(F.col("props")["status"].isin(statuses))
    if some and files.isEmpty():
        raise ValueError(f"no trajectory with {', '.join(wanted)} at {path}")
    rows = files.select("filename", "props", "names", F.explode("rows").alias("row")).where(F.trim("row") != "").withColumn("cells", F.split(F.trim("row"), r"\s+"))
    return rows.select("filename", "props", *(F.element_at("cells", F.array_position("names", k).cast("int")).try_cast("double").alias(k) for k in wanted))


def write_trajectories(traj: DataFrame, props: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Writes tracer files of TRAJ(tracer_id, time, <keys>) and PROPS(tracer_id, <anything>) and returns
    (tracer_id, file, rows). ``folder`` must be one that all executors share."""
    names = [c for c in props.columns if c != "tracer_id"]
    text = props.select("tracer_id", F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names)).alias("__props"))
    rows = traj.select("tracer_id", "time", *keys).join(text, "tracer_id", "left")

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time", kind="stable")
        number = int(part["tracer_id"].iloc[0])
        path = os.path.join(folder, f"tracer_{number:06d}.dat")
        os.makedirs(folder, exist_ok=True)
        legend = "# " + f"{'time':>23s}" + "".join(f"{k.rsplit('.', 1)[-1]:>26s}" for k in keys)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(f"# {part['__props'].iloc[0] or ''}\n{legend}\n")
            for row in part[["time", *keys]].itertuples(index=False):
                f.write(" ".join(f"{v:25.16e}" for v in row) + "\n")
        os.replace(own, path)
        return pd.DataFrame({"tracer_id": [number], "file": [path], "rows": [len(part)]})

    return rows.groupBy("tracer_id").applyInPandas(write, "tracer_id long, file string, rows long")

