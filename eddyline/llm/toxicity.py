"""Toxicity by multiple-instance learning: a document is a bag of sentences, of which only the bag has a
label. A sentence's probability is logistic in its words, a document's the noisy-or of its sentences',
and the gradient of the document's likelihood teaches the words, so that the sentences to blame come out.

Words are runs of letters, digits and characters beyond ASCII, lower-cased in ASCII, known by 64-bit
hashes, and so are their first 4 to 7 bytes (stems whose endings change); a sentence counts each up to
``MOST`` times. Sentences end at ``.``, ``!``, ``?`` or a line's end. The vocabulary (features in
``MIN_DOCS`` and a share of ``MIN_SHARE`` or more of the toxic documents of a bounded labelled sample, a
share below which the pull of ``sparse`` keeps weights at 0, and ``MIN_RATIO`` times their share of the clean ones or
more; ``VOCABULARY`` of them at most) is counted by tasks and is what they receive: its size is fixed by parameters. The
sample has ``per_label`` ids of each label at most, and none of more than ``max_chars`` characters; such texts teach nothing
but are scored whole. Scoring covers whole texts in bounded blocks, without a shuffle.

Defined results: a null or empty text has no sentence and a score of 0; a sentence without a known word
still has the bias, a small chance. Rows with a null id are in no fold and are scored; repeated rows are
scored each; ties for the worst sentence go to the first; other columns of the input are ignored.
Without labelled rows of both kinds every sentence's weight is 0 and its bias ``LEAST_BIAS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import held_out, sampled_texts, saved, table
from eddyline.llm.hashing import WORDLIKE, blocks, prefix_hashes, word_hashes

ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(x) for x in ".!?\n\r"]] = True
LEAST_BIAS = -9.0
PREFIXES = range(4, 8)
MOST = 4
#: A feature's least number of toxic documents, their least share, how many times its share of the clean ones that must
#: be, and how many features there are at most.
MIN_DOCS, MIN_SHARE, MIN_RATIO, VOCABULARY = 3, 0.003, 1.0, 50_000


def speaks(n1, n0, toxic: int, clean: int):
    """Whether a feature in n1 of the toxic and n0 of the clean documents may tell them apart (arrays or Columns)."""
    return (n1 >= max(MIN_DOCS, MIN_SHARE * toxic)) & (n1 * max(1, clean) >= MIN_RATIO * max(1, toxic) * n0)


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float
    power: float = 1.0  # of each sentence's chance to be clean


def sentences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: hashes of words and their prefixes, the sentence of each, and each sentence's row, byte start and
    length in its text's bytes. Only sentences with a word are there."""
    for buf, rows, starts, origins in blocks(column):
        code, at = word_hashes(buf, WORDLIKE)
        if not len(at):
            continue
        stem, stem_at = prefix_hashes(buf, WORDLIKE, PREFIXES)
        cut = np.concatenate([[0], np.cumsum(ENDS[buf])])
        piece = np.searchsorted(starts, at, "right") - 1
        key = cut[at] + piece  # a new piece begins a sentence too
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sentence = np.cumsum(new) - 1
        first = at[new]
        ends = np.flatnonzero(ENDS[buf])
        stop = np.minimum(np.append(ends, len(buf))[np.searchsorted(ends, first)], np.append(starts[1:] - 1, len(buf) - 1)[piece[new]])
        code, sentence = np.concatenate([code, stem]), np.concatenate([sentence, sentence[np.searchsorted(at, stem_at)]])
        order = np.argsort(sentence, kind="stable")
        code, sentence = code[order], sentence[order]
        yield code, sentence, rows[piece[new]], first - starts[piece[new]] + origins[piece[new]], stop - first


def _known(code: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted ``words``, or ``len(words)``."""
    if not len(words):
        return np.zeros(len(code), np.int64)
    at = np.searchsorted(words, code)
    return np.where(words[np.minimum(at, len(words) - 1)] == code, at, len(words))


def _counted(word: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, times) of each feature in each sentence."""
    key, times = np.unique(sentence.astype(np.int64) * max(1, size) + word, return_counts=True)
    of, word = np.divmod(key, max(1, size))
    return word, of, np.minimum(times, MOST)


def sentence_sums(code: np.ndarray, sentence: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Sum of the weights of each sentence's features, each ``MOST`` times at most."""
    word = _known(code, model.words)
    here = word < len(model.words)
    word, of, times = _counted(word[here], sentence[here], len(model.words))
    return np.bincount(of, model.weight[word] * times if len(word) else None, n).astype(float)


def log_none(total: np.ndarray, bias: float) -> np.ndarray:
    """log(1 - p) of sentences with the given sums of weights."""
    return -np.logaddexp(0, total + bias)


def scores(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: probability, that of its worst sentence, and its number of sentences and of those
    likelier than not."""
    none, worst = np.zeros(len(column)), np.zeros(len(column))
    count, bad = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for code, sentence, rows, _, _ in sentences(column):
        z = sentence_sums(code, sentence, len(rows), model)
        clean = model.power * log_none(z, model.bias)
        p = -np.expm1(clean)
        np.add.at(none, rows, clean)
        np.maximum.at(worst, rows, p)
        np.add.at(count, rows, 1)
        np.add.at(bad, rows, p >= 0.5)
    return -np.expm1(none), worst, count, bad


def offending(column: pa.Array, model: Model, least: float = 0.5) -> list[list[tuple[int, int, float]]]:
    """For each row the (start, end, probability) of its sentences of ``least`` and more; bytes of the
    text's UTF-8, end exclusive."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(column))]
    for code, sentence, rows, start, length in sentences(column):
        p = -np.expm1(model.power * log_none(sentence_sums(code, sentence, len(rows), model), model.bias))
        for i in np.flatnonzero(p >= least):
            out[rows[i]].append((int(start[i]), int(start[i] + length[i]), float(p[i])))
    return out


def _hashes(texts: DataFrame) -> DataFrame:
    """doc_id, label, n_sentences and, as bytes, the hashes of a text's features and the sentence of each."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            marks: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            total = np.zeros(len(batch), np.int64)
            for code, sentence, rows, _, _ in sentences(batch["text"]):
                of = rows[sentence]
                for row in np.unique(of):
                    here = of == row
                    own = sentence[here]
                    words[row].append(code[here])
                    marks[row].append((own - own[0] + total[row]).astype("<u4"))
                    total[row] = int(marks[row][-1][-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"].cast(pa.int64()), pa.array(total), pa.array([b"".join(x.astype("<u8").tobytes() for x in w) for w in words], pa.binary()), pa.array([b"".join(x.tobytes() for x in m) for m in marks], pa.binary())],
                ["doc_id", "label", "n_sentences", "words", "sentences"],
            )

    return texts.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label long, n_sentences long, words binary, sentences binary")


def _vocabulary(bags: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Sorted hashes of the features that ``speaks`` holds of, the ``VOCABULARY`` most frequent of them."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(np.frombuffer(w.as_buffer(), "<u8")) for w in batch["words"]]
            label = np.repeat(np.asarray(batch["label"]), [len(e) for e in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array((label == 1).astype(np.int64))], ["code", "toxic"])

    counted = bags.select("label", "words").mapInArrow(distinct, "code long, toxic long").groupBy("code").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    chosen = counted.where(speaks(F.col("n1"), F.col("n0"), toxic, clean)).orderBy(F.desc("n1"), "code").limit(VOCABULARY)
    return np.sort(np.array([r["code"] for r in chosen.collect()], np.int64).view(np.uint64))


def training_bags(texts: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(label, known features' hashes, sentence of each, number of sentences) of a bounded sample (doc_id, label, text).
    Tasks extract, count and choose the vocabulary; the driver gets it and where sampled texts hold it."""
    bags = saved(_hashes(texts), "toxic-bags")
    toxic, clean = (bags.where(f"label {sign} 1").count() for sign in ("=", "!="))
    known = _vocabulary(bags, toxic, clean)
    shared = bags.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks = [], []
            for w, m in zip(batch["words"], batch["sentences"], strict=True):
                code, mark = np.frombuffer(w.as_buffer(), "<u8"), np.frombuffer(m.as_buffer(), "<u4")
                here = _known(code, shared.value) < len(shared.value)
                words.append(code[here].tobytes())
                marks.append(mark[here].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["n_sentences"], pa.array(words, pa.binary()), pa.array(marks, pa.binary())], batch.schema.names)

    rows = bags.mapInArrow(keep, bags.schema).toArrow()
    order = pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("words", "ascending")]).to_pylist()
    label_of, size, words, marks = (rows[c] for c in ("label", "n_sentences", "words", "sentences"))
    return [(label_of[i].as_py(), np.frombuffer(words[i].as_buffer(), "<u8"), np.frombuffer(marks[i].as_buffer(), "<u4"), size[i].as_py()) for i in order]


def _laid(bags: list[tuple], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, times) of the known ``words`` in all bags, and the bag of each sentence."""
    n_sentences = [n for *_, n in bags]
    first = np.concatenate([[0], np.cumsum(n_sentences)])
    parts = []
    for (_, w, at, _), f in zip(bags, first[:-1], strict=True):  # bag by bag: unknown features are most of them
        word = _known(w, words)
        known = word < len(words)
        word, sentence, times = _counted(word[known], at[known], len(words))
        parts.append((word.astype(np.int32), (sentence + f).astype(np.int32), times.astype(np.int8)))
    word, sentence, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return word, sentence, times, np.repeat(np.arange(len(bags)), n_sentences)


def _chosen(bags: list[tuple], y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that may speak."""
    each = [np.unique(w) for _, w, _, _ in bags]
    seen, of = np.unique(np.concatenate(each), return_inverse=True)
    label = np.repeat(y, [len(e) for e in each])
    docs, clean = np.bincount(of, label, len(seen)), np.bincount(of, 1 - label, len(seen))
    often = speaks(docs, clean, int(y.sum()), int((1 - y).sum()))
    seen, docs = seen[often], docs[often]
    return seen if len(seen) <= VOCABULARY else np.sort(seen[np.lexsort((seen, -docs))[:VOCABULARY]])


def _climbed(bags, y, words, weight, bias, epochs, rate, most_wrong, sparse=0.0, ridge=0.0, least_bias=-np.inf):
    """(weights, bias) after gradient steps on the likelihood of the bags' labels, all bags in each."""
    word, sentence, times, bag = _laid(bags, words)
    wrong = min(0.02, most_wrong)
    past, past_bias = np.full(len(words), 1e-3), 1e-3
    for _ in range(epochs):
        z = np.clip(np.bincount(sentence, weight[word] * times, len(bag)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = -np.expm1(np.bincount(bag, -np.logaddexp(0, z), len(bags)))
        blame = wrong + (1 - wrong) * total
        back = np.where(y == 1, (1 - wrong) * (1 - total) / blame, -1.0)  # of log-likelihood, by -log(1 - p) of a sentence
        by_mistake = (y * wrong * (1 - total) / blame).sum()
        wrong = min(most_wrong, max(1e-4, by_mistake / (by_mistake + (1 - y).sum())))
        g = back[bag] * p
        step = np.bincount(word, g[sentence] * times, len(words)) - ridge * weight
        past += step * step
        pace = rate / np.sqrt(past)
        weight = weight + pace * step
        if sparse:
            weight = np.sign(weight) * np.maximum(np.abs(weight) - pace * sparse * y.sum(), 0)
        past_bias = 0.9 * past_bias + 0.1 * g.sum() ** 2  # forgets the first steps, whose gradients are far greater
        bias = max(least_bias, bias + 0.1 * rate * g.sum() / np.sqrt(past_bias))
    return weight, float(bias)


def _uncalibrated(bags: list[tuple], epochs: int, rate: float, sparse: float, ridge: float, most_wrong: float) -> Model:
    y = np.array([b[0] for b in bags], float)
    if not len(bags) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), LEAST_BIAS)
    words = _chosen(bags, y)
    weight, bias = _climbed(bags, y, words, np.zeros(len(words)), -5.0, epochs, rate, most_wrong, sparse=sparse, least_bias=LEAST_BIAS)
    words, weight = words[weight != 0], weight[weight != 0]
    return Model(words, *_climbed(bags, y, words, weight, bias, epochs // 2, rate / 2, most_wrong, ridge=ridge))


def best_power(none: np.ndarray, y: np.ndarray) -> float:
    """The power of the noisy-or by which 0.5 parts documents best (by F1), of their log(1 - p) and labels. 1 where
    one label is lacking."""
    if not len(y) or y.min() == y.max():
        return 1.0
    order = np.argsort(none, kind="stable")
    found, alarms = np.cumsum(y[order]), np.cumsum(1 - y[order])
    # a cut between documents of equal scores can't be made
    cuts = np.flatnonzero(np.append(np.diff(none[order]) > 0, True))
    f1 = 2 * found[cuts] / (found[cuts] + alarms[cuts] + y.sum())
    at = cuts[int(np.argmax(f1))]
    low, high = -none[order[at]], -none[order[min(at + 1, len(order) - 1)]]
    return float(np.clip(np.log(2) / np.sqrt(max(low, 1e-9) * max(high, 1e-9)), 0.1, 10))


def fit(bags: list[tuple], epochs: int = 200, rate: float = 1.0, sparse: float = 0.0005, ridge: float = 0.3, most_wrong: float = 0.005, folds: int = 3) -> Model:
    """Of (label, features, sentence of each and, where features may lack at the end, number of sentences). Steps are scaled word
    by word by the squares of past gradients (words differ by orders of magnitude in how often they occur). A pull of
    ``sparse`` times the toxic bags towards 0 chooses the words that many documents speak for; their weights and the bias are then
    fitted again without it, held by a slight ``ridge`` only. Some labels are wrong: a document without a toxic sentence is
    labelled toxic with a chance that is estimated along (by EM) and is ``most_wrong`` at most: a greater one would explain
    short toxic documents away, whose few words speak softly. Models of all but one of ``folds`` parts of the bags score that
    one, and the noisy-or's power is what parts those scores best at 0.5."""
    bags = [(*b[:3], b[3] if len(b) > 3 else int(b[2][-1]) + 1) for b in bags if (b[3] if len(b) > 3 else len(b[1]))]
    how = (epochs, rate, sparse, ridge, most_wrong)
    model = _uncalibrated(bags, *how)
    if not len(model.words):
        return model
    y, none = np.array([b[0] for b in bags], float), np.zeros(len(bags))
    for f in range(folds):
        part = _uncalibrated([b for i, b in enumerate(bags) if i % folds != f], *how)
        for i in range(f, len(bags), folds):
            _, words, marks, n = bags[i]
            none[i] = log_none(sentence_sums(words, marks, n, part), part.bias).sum()
    return Model(model.words, model.weight, model.bias, best_power(none, y))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 2500, max_chars: int = 200_000, seed: int = 13) -> Model:
    """Fits on the labelled rows given; which rows those are is the caller's business."""
    return fit(training_bags(sampled_texts(documents, labels, label, per_label, max_chars, seed)))


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, worst_score (of a sentence), n_sentences, n_offending."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, worst, count, bad = scores(batch["text"], shared.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(worst), pa.array(count), pa.array(bad)], ["doc_id", "score", "predicted", "worst_score", "n_sentences", "n_offending"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int, worst_score double, n_sentences long, n_offending long")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows whose crc32(doc_id) mod 5 is not 0; every document scored."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score_documents(documents, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "worst_score", "n_sentences", "n_offending")
