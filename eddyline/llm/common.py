"""What the operators of this subpackage share: tables, the shared scratch folder, label samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.shared import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, so a lost executor costs no
    more than the task that was reading it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table that ``saved`` wrote and nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(conf).delete(path, True)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key`` (key, n and more; a row a key, n the rows that have it, a written table). Keys
    that more than one row in ``PARTS`` has are dealt in parts by a hash of the row, and their ``per_key`` row is copied to
    each part: no task gets all rows of a hot key. Such keys number ``PARTS`` at most, so they are broadcast."""
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(64, total // PARTS)
    hot = per_key.where(F.col("n") > limit).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / limit).alias("__parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1)))).drop("__hot", "__parts")
    copies = per_key.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / limit), F.lit(1)) - 1))).drop("n")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


#: The share of rows from which a key counts as hot is one in this number.
PARTS = 500


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Labels that a sample may have, and rows that it has in all.
MOST_LABELS = 4096
MOST_ROWS = 100_000


def taken(code: Column, part: float) -> Column:
    """Whether a 64-bit hash falls in the first ``part`` of all hashes, however small that is."""
    return F.lit(True) if part >= 1 else F.shiftrightunsigned(code, 1) < F.lit(min(int(part * 2**63), 2**63 - 1))


def bounded_sample(labels: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """(doc_id, label) of about ``per_label`` ids at most of each label and ``MOST_ROWS`` in all, picked by a hash of
    the id: which ids are taken depends on them and the number of rows only. An id with several labels has its
    greatest. More than ``MOST_LABELS`` labels are an error."""
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    counts = {r[label]: r["count"] for r in labels.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different values of {label!r}")
    per = min(per_label, MOST_ROWS // max(1, len(counts)))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(label) == F.lit(value)) & taken(F.xxhash64("doc_id", F.lit(seed)), per / n))
    return labels.where(keep).groupBy("doc_id").agg(F.max(label).alias("label"))


def sampled_texts(documents: DataFrame, labels: DataFrame, label: str, per_label: int, max_chars: int, seed: int) -> DataFrame:
    """(doc_id, label, text) of a bounded sample: a row for each sampled id that ``documents`` has, with the text of least
    hash where an id has several. Texts of more than ``max_chars`` characters teach nothing and are left out. The
    sample is what is broadcast, ``MOST_ROWS`` ids or so at most."""
    sample = bounded_sample(labels, label, per_label, seed)
    texts = documents.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
