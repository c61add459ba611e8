"""Five stages from raw documents to training tokens, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.llm.bpe import encoded_texts
from eddyline.llm.common import saved
from eddyline.llm.mixing import mixed_texts
from eddyline.llm.quality import keep_good
from eddyline.llm.secrets import redact
from eddyline.llm.simhash import keep_one

STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one),
    ("secret scans", redact),
    ("mixing sources to target weights", mixed_texts),
    ("BPE encoding and decoding", encoded_texts),
]

#: Neither the trained classifier nor the stages after it can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k + 1}")
    return docs
