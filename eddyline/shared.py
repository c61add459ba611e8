"""Folders that driver and executors share, and what lies in them."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only in local mode, where one machine is all there is, may it be unset; a folder of this
    machine is then set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='eddyline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/eddyline/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked through Spark's own readers, so wherever Spark reads."""
    try:
        spark.read.text(path).schema  # noqa: B018  analysed here
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def content_of(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: their number and the sum of their hashes."""
    n, code = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n} rows {code or 0}"


def source_of(df: DataFrame) -> str:
    """What a table is read from: a digest of its files' paths or, of one without files, of its rows."""
    files = sorted(df.inputFiles())
    return f"{len(files)} files {hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:16]}" if files else content_of(df)


#: Rows that ``few`` broadcasts at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has ``FEW`` rows at most (which is counted), else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


class OtherRun(ValueError):
    """A folder holds the results of other inputs."""


def recorded(spark: SparkSession, folder: str) -> dict | None:
    """What ``claim`` wrote down in a folder."""
    path = f"{folder}/manifest"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, f"{path}/_SUCCESS") else None


def record(spark: SparkSession, folder: str, what: dict[str, object]) -> None:
    spark.createDataFrame([(json.dumps(plain(what)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def plain(what: dict[str, object]) -> dict:
    """As it is when it was written down and read again."""
    return json.loads(json.dumps(what, default=str))


def claim(spark: SparkSession, folder: str, what: dict[str, object], may_grow: str | None = None) -> None:
    """Writes down in ``folder`` what its results come from; if that is there already, it must be the same, or an error
    names what differs. The list ``may_grow`` may go on behind what was written down."""
    now, before = plain(what), recorded(spark, folder)
    if before is not None:
        grown = may_grow and before.get(may_grow) == now[may_grow][: len(before.get(may_grow) or [])]
        differ = [k for k in sorted({*before, *now}) if before.get(k) != now.get(k) and not (k == may_grow and grown)]
        if differ:
            raise OtherRun(f"{folder} holds results of something else: " + "; ".join(f"{k} was {str(before.get(k))[:200]}, is {str(now.get(k))[:200]}" for k in differ))
    if before != now:
        record(spark, folder, now)
