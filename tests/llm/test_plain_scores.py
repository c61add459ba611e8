"""What the classifiers' queries return against plain loops over whole texts, one byte at a time."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.llm import language, quality
from eddyline.llm.common import held_out
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
SPACES = b" \t\n\v\f\r"
M32, M64 = 2**32 - 1, 2**64 - 1


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def grams(text, n, bits):
    """Buckets of all runs of n bytes in the text between two spaces that have white space at their edges only."""
    body, out = b" " + lowered(text) + b" ", []
    for i in range(len(body) - n + 1):
        gram = body[i : i + n]
        if any(b in SPACES for b in gram[1:-1]) or (n == 2 and gram[0] in SPACES and gram[1] in SPACES):
            continue
        code = int.from_bytes(gram, "little") + (n * 0x01000193 if n < 4 else 0) & M32
        for shift, factor in ((15, 0x2C1B3C6D), (13, 0x297A2D39)):
            code = (code ^ code >> shift) * factor & M32
        out.append(code >> 32 - bits)
    return out


def word_code(word):
    code = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(word)) & M64
    code = (code ^ code >> 31) * 0xD6E8FEB86659FD93 & M64
    return code ^ code >> 32


def quality_features(text, bits):
    codes = [word_code(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))]
    pairs = [((b - a) * 0x9E3779B97F4A7C15 + 0x94D049BB133111EB & M64) >> 64 - bits for a, b in zip(codes, codes[1:])]
    return [*(g for n in (2, 3, 4) for g in grams(text, n, bits)), *(c >> 64 - bits for c in codes), *pairs]


def quality_score(text, model):
    found = quality_features(text, model.bits)
    return 1 / (1 + math.exp(-(math.fsum(float(model.bucket[i]) for i in found) / (len(found) + 64) + model.bias)))


def language_of(text, model, margin=0.05):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    found = [g for n in (2, 3) for g in grams(text, n, model.bits)]
    z = [math.fsum(float(w[i]) for i in found) / max(1, len(found)) + float(b) for w, b in zip(model.weight, model.bias, strict=True)]
    sure = [abs(math.tanh(v / 2)) + 1e-9 for v in z]
    losses = [sum(s * math.log1p(math.exp(-v * c)) for s, v, c in zip(sure, z, row, strict=True)) / sum(sure) for row in model.code.tolist()]
    best = losses.index(min(losses))
    share = 1 / sum(math.exp(-(x - losses[best]) * len(z)) for x in losses)
    return model.languages[best], share, sorted(losses)[1] - losses[best] < margin


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_quality_scores_by_a_plain_loop(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    assert np.ptp(model.bucket) > 0
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = quality.op1_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = quality_score(texts[r.doc_id], model)
        assert r.score == pytest.approx(want, abs=1e-9) and (r.predicted == (want >= 0.3) or abs(want - 0.3) < 1e-9), r.doc_id


def test_languages_by_a_plain_loop(spark, docs):
    model = language.train(docs, docs.select("doc_id", "lang").where(~held_out(F.col("doc_id"), 4, 2)))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = language.op9_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and len({r.lang_pred for r in got}) >= 4
    for r in got:
        name, score, ambiguous = language_of(texts[r.doc_id], model)
        assert (r.lang_pred, r.ambiguous) == (name, ambiguous) and r.score == pytest.approx(score, abs=1e-6), r.doc_id


def test_texts_of_equal_scores_go_to_the_first_language_and_are_ambiguous(spark):
    names = ["de", "en", "fr"]
    code = language.codewords(len(names))
    none = language.Model(names, code, np.zeros((code.shape[1], 1 << 8), np.float32), np.zeros(code.shape[1]), 8)
    texts = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, "12 34"), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 9), r.ambiguous) for r in language.identify(texts, none).collect())
    third = round(1 / 3, 9)
    assert got == [(0, "de", third, True), (1, "de", third, True), (1, "de", third, True), (2, "und", 0.0, False)]
    sure = language.Model(names, code, none.weight, 5.0 * code[2], 8)
    assert [(r.lang_pred, r.ambiguous) for r in language.identify(texts.limit(1), sure).collect()] == [("fr", False)]
