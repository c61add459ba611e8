"""Language ID by error-correcting output codes: each language has a codeword; a linear classifier over
hashed byte n-grams predicts each bit, and loss-weighted decoding picks the codeword with the least loss.

Up to ``EXHAUSTIVE`` languages the code is the exhaustive one (every split of the languages in two). Beyond, words are
rows of a Hadamard matrix without its first column, every two of which differ in half their bits or more; their
length grows with the languages, of which ``MOST_LANGUAGES`` at most are taken, so that a model has a bound (33 MB).
Bits are trained by stochastic gradient descent on the logistic loss, in numpy, on a bounded labelled sample
(``per_label`` ids of each language, none with more than ``max_chars`` characters, which teach nothing but are
predicted whole); tasks receive ``2 ** bits`` weights a bit. Scoring reads whole texts in bounded blocks, without a
shuffle.

Defined results: a text that is null or without a letter is ``und`` with score 0; so is every text if no
labelled rows exist. ``ambiguous`` marks texts whose second codeword is within ``margin`` of the first.
Ties go to the first language by code point. Repeated rows are predicted each, null ids are in no fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import held_out, sampled_texts, table
from eddyline.llm.hashing import blocks, gram_ids, piece_sums

ORDERS = (2, 3)
EXHAUSTIVE = 5
MOST_LANGUAGES = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x code bits, +1 and -1
    weight: np.ndarray  # code bits x buckets
    bias: np.ndarray
    bits: int


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one for each of n languages."""
    if n <= EXHAUSTIVE:
        splits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(2 ** (n - 1) - 1)]
        return np.array(splits or [[1] * n]).T
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    matrix = np.ones((1, 1), int)
    while len(matrix) <= n:
        matrix = np.kron(matrix, [[1, 1], [1, -1]])
    return matrix[1 : n + 1, 1:]


def _kinds(buf: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for n in ORDERS:
        ids, ok = gram_ids(buf, n, bits)
        yield ids, ok, np.maximum(starts - 1, 0)


def counts(column: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for buf, rows, starts, _ in blocks(column):
        ends = np.append(starts[1:] - 1, len(buf))
        for ids, ok, begin in _kinds(buf, starts, bits):
            for row, a, b in zip(rows.tolist(), begin.tolist(), ends.tolist(), strict=True):
                found[row].append(ids[a:b][ok[a:b]])
    none = np.zeros(0, np.uint32)
    return [np.unique(np.concatenate(x or [none]), return_counts=True) for x in found]


def training_rows(documents: DataFrame, labels: DataFrame, bits: int, per_label: int, max_chars: int, seed: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    texts = sampled_texts(documents, labels, "lang", per_label, max_chars, seed)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = counts(batch["text"], bits)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([i.astype("<u4").tobytes() for i, _ in c], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in c], pa.binary())], ["doc_id", "label", "ids", "n"])

    rows = texts.mapInArrow(extract, "doc_id long, label string, ids binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return [(r["label"], np.frombuffer(bytes(r["ids"]), "<u4"), np.frombuffer(bytes(r["n"]), "<u4")) for r in rows]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], bits: int, epochs: int = 6, rate: float = 4.0, seed: int = 3) -> Model:
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    weight, bias = np.zeros((code.shape[1], 1 << bits), np.float32), np.zeros(code.shape[1])
    rng = np.random.default_rng(seed)
    step, steps = 0, epochs * max(1, len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, ids, n = rows[i]
            x = (n / n.sum()).astype(np.float32)
            target = code[languages.index(label)]
            now = rate * (1 - step / steps)
            step += 1
            z = target * (weight[:, ids] @ x + bias)
            g = target / (1 + np.exp(np.clip(z, -30, 30)))
            weight[:, ids] += (now * len(ids) / 16 * g[:, None] * x).astype(np.float32)
            bias += 0.01 * now * g
    return Model(languages, code, weight, bias, bits)


def decode(z: np.ndarray, model: Model, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) of rows of bit outputs: the loss of a codeword is the mean of its
    bits' logistic losses, each weighed by how sure its bit is."""
    sure = np.abs(np.tanh(z / 2)) + 1e-9
    loss = np.stack([(sure * np.logaddexp(0, -z * row)).sum(1) / sure.sum(1) for row in model.code], 1)
    best = loss.argmin(1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * model.code.shape[1])
    p /= p.sum(1, keepdims=True)
    order = np.sort(loss, 1)
    near = order[:, 1] - order[:, 0] < margin if loss.shape[1] > 1 else np.zeros(len(z), bool)
    return best, p[np.arange(len(z)), best], near


def bit_outputs(column: pa.Array, model: Model) -> np.ndarray:
    total, count = np.zeros((len(column), len(model.bias))), np.zeros(len(column))
    for buf, rows, starts, _ in blocks(column):
        for ids, ok, begin in _kinds(buf, starts, model.bits):
            np.add.at(count, rows, piece_sums(ok, begin, len(buf)))
            for k, w in enumerate(model.weight):
                np.add.at(total[:, k], rows, piece_sums(w[ids] * ok, begin, len(buf)))
    return total / np.maximum(count, 1)[:, None] + model.bias


def train(documents: DataFrame, labels: DataFrame, bits: int = 14, per_label: int = 500, max_chars: int = 200_000, seed: int = 17) -> Model:
    """``labels`` has doc_id and lang; which rows they are is the caller's business."""
    return fit(training_rows(documents, labels, bits, per_label, max_chars, seed), bits)


def identify(documents: DataFrame, model: Model, margin: float = 0.05) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, a row for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, texts = shared.value, batch["text"]
            lettered = np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in texts], bool)
            lettered &= bool(m.languages)
            names, score, near = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if lettered.any():
                best, p, close = decode(bit_outputs(texts, m), m, margin)
                names[lettered] = np.array(m.languages, object)[best[lettered]]
                score[lettered], near[lettered] = p[lettered], close[lettered]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(score), pa.array(near)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows whose crc32(doc_id) mod 4 is not 2; every document predicted."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, documents.select("doc_id", "lang").where(~held_out(F.col("doc_id"), 4, 2)))
    return identify(documents, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
