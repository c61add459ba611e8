"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document,
with a softmax on top, trained by stochastic gradient descent in numpy.

Training takes a bounded sample of labelled rows (``per_label`` rows of each label at most, none longer
than ``max_chars``), whose features tasks extract and whose sparse counts alone reach the driver. Scoring
covers every whole text, without a shuffle. As the output layer is linear in the mean vector, a trained
model comes down to one number a bucket, which is what tasks receive (fixed size, ``2 ** bits`` floats).

Defined results: a null or empty text has no features and gets the model's prior; rows with a null id
are in no fold and are scored; repeated rows are scored each; other columns of the input are ignored.
Without labelled rows of both kinds every score is the share of label 1 (0.5 if there are no labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import held_out, sampled_texts, table
from eddyline.llm.hashing import SPACE, blocks, gram_ids, piece_sums, word_hashes

ORDERS = (2, 3, 4)
#: Zero vectors that are averaged in, so that a text of a few words stays near the prior.
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    bits: int
    bucket: np.ndarray  # what an occurrence of a bucket adds to the log-odds, before averaging
    bias: float


def _features(buf: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(buckets, whether they count, positions) for each kind of feature."""
    for n in ORDERS:
        ids, ok = gram_ids(buf, n, bits)
        yield ids, ok, None
    code, start = word_hashes(buf, ~SPACE)
    yield (code >> np.uint64(64 - bits)).astype(np.uint32), None, start
    # of two words in a row the difference counts, so that all words that are said twice share a bucket
    step = (code[1:] - code[:-1]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x94D049BB133111EB)
    piece = np.searchsorted(starts, start, "right")
    same = piece[1:] == piece[:-1]
    yield (step[same] >> np.uint64(64 - bits)).astype(np.uint32), None, start[1:][same]


def sparse_counts(column: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each row."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for buf, rows, starts, _ in blocks(column):
        ends = np.append(starts[1:] - 1, len(buf))
        for ids, ok, at in _features(buf, starts, bits):
            for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                if at is None:
                    a = max(a - 1, 0)  # the space before
                    found[row].append(ids[a:b][ok[a:b]])
                else:
                    found[row].append(ids[np.searchsorted(at, a) : np.searchsorted(at, b)])
    none = np.zeros(0, np.uint32)
    return [np.unique(np.concatenate(x or [none]), return_counts=True) for x in found]


def training_rows(documents: DataFrame, labels: DataFrame, label: str, bits: int, per_label: int, max_chars: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    texts = sampled_texts(documents, labels, label, per_label, max_chars, seed)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = sparse_counts(batch["text"], bits)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"].cast(pa.int64()), pa.array([i.astype("<u4").tobytes() for i, _ in counts], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in counts], pa.binary())],
                ["doc_id", "label", "ids", "n"],
            )

    rows = texts.mapInArrow(extract, "doc_id long, label long, ids binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return [(int(r["label"]), np.frombuffer(bytes(r["ids"]), "<u4"), np.frombuffer(bytes(r["n"]), "<u4")) for r in rows]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, the rate falling to 0."""
    n_one = sum(label == 1 for label, _, _ in rows)
    if not rows or n_one in (0, len(rows)):
        share = min(max(n_one / len(rows), 1e-6), 1 - 1e-6) if rows else 0.5
        return Model(bits, np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.log(np.array([len(rows) - n_one, n_one]) / len(rows))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, ids, n = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            weight = (n / (n.sum() + SMOOTH)).astype(np.float32)
            hidden = weight @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = (p @ out).astype(np.float32)
            out -= (now * np.outer(p, hidden)).astype(np.float32)
            # a step of the mean vector as a whole, shared among its parts by their weights
            vectors[ids] -= (now * len(ids) * weight)[:, None].clip(max=now * 8) * back
    return Model(bits, ((out[1] - out[0]) @ vectors.T).astype(np.float32), float(bias[1] - bias[0]))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for buf, rows, starts, _ in blocks(column):
        for ids, ok, at in _features(buf, starts, model.bits):
            value = model.bucket[ids]
            if at is None:
                value *= ok
                one = ok
                begin = np.maximum(starts - 1, 0)
            else:
                dense, one = np.zeros(len(buf), np.float32), np.zeros(len(buf), np.bool_)
                dense[at], one[at] = value, True
                value, begin = dense, starts
            np.add.at(total, rows, piece_sums(value, begin, len(buf)))
            np.add.at(count, rows, piece_sums(one, begin, len(buf)))
    return 1 / (1 + np.exp(-(total / (count + SMOOTH) + model.bias)))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 17, per_label: int = 2000, max_chars: int = 200_000, seed: int = 11) -> Model:
    """Fits on the labelled rows given; which rows those are is the caller's business."""
    return fit(training_rows(documents, labels, label, bits, per_label, max_chars, seed), bits)


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score and predicted (1 from ``threshold`` up), a row for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch["__text"], shared.value)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    inputs = documents.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return inputs.mapInArrow(score, f"{schema}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows whose crc32(doc_id) mod 5 is not 0; every document scored."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score_documents(documents, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, documents: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject, with their own columns."""
    labels = table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch["text"], shared.value) >= threshold))

    return documents.mapInArrow(keep, documents.schema)
