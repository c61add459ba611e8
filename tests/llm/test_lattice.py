"""Lattice scores against a plain recursion and plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.llm import lattice
from tests.conftest import DATA

WORDS = ["the", "hello", "straße", "日本語", "x" * 40, "a", "🎉🎉", "internationalization", "▁▁", "\x00"]


@pytest.fixture(scope="module")
def pieces():
    return lattice.read_pieces(lattice.vocabulary_path())


@pytest.fixture(scope="module")
def names():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=lattice.vocabulary_path())
    return {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}


def plainly(word, pieces, names, e, more=0.0):
    s = lattice.MARK + word
    ahead = [0.0]
    for t in range(1, len(s) + 1):
        terms = [ahead[t - 1] + sum(pieces.log_byte[e][b] + more for b in s[t - 1].encode())]
        for n in range(1, min(t, pieces.longest) + 1):
            if s[t - n : t] in names:
                at = np.searchsorted(pieces.hashes, lattice.piece_hash(lattice._codes(s[t - n : t])))
                terms.append(ahead[t - n] + pieces.log_p[e][at] + more)
        ahead.append(np.logaddexp.reduce(terms))
    return ahead[-1]


def test_sums_of_words(pieces, names, monkeypatch):
    want = np.array([[plainly(w, pieces, names, e, -0.25) for w in WORDS] for e in range(len(lattice.EXPONENTS))])
    assert np.allclose(lattice.marginals(WORDS, pieces, -0.25), want, atol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 5)
    monkeypatch.setattr(lattice, "AREA", 7)
    assert np.allclose(lattice.marginals(WORDS, pieces, -0.25), want, atol=1e-9)
    assert lattice.marginals([], pieces).shape == (3, 0)


def test_all_cuts_of_a_small_vocabulary_count_and_log_probabilities_are_taken_as_they_are():
    scores = {"▁": math.log(0.2), "a": math.log(0.3), "b": math.log(0.1), "ab": math.log(0.15), "▁a": math.log(0.05)}
    p = lattice.pieces_of(scores, [math.log(0.2 / 256)] * 256)
    assert np.allclose(np.exp(p.log_p).sum(1) + np.exp(p.log_byte).sum(1), 1)
    byte = 0.2 / 256
    a, b, mark = 0.3 + byte, 0.1 + byte, 0.2 + byte**3
    assert np.allclose(np.exp(lattice.marginals(["ab"], p)), mark * (a * b + 0.15) + 0.05 * b)
    # words of one letter and less sum to the chance of all texts that short, below 1
    assert np.exp(lattice.marginals(["", *"abcdef"], p)[0]).sum() < 1


def plain_scores(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of (doc_id, text) rows."""
    split = [((i, zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False), (x or "").encode().lower().split() + [b""]) for i, x in rows]
    c = Counter(w for (_, held), words in split if not held for w in words)
    total, distinct = sum(c.values()), len(c)
    return [(i, held, len(w), sum(c[t] > 0 for t in w), total, sum(math.log10((c[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in w)) for (i, held), w in split]


def scored(documents, pieces):
    d = documents.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    model = lattice.fit(d.withColumn("teaches", ~F.col("held_out")), "teaches", pieces)
    return model, lattice.score_documents(d, model, ["doc_id", "held_out"])


def test_documents_with_odd_rows(spark, pieces, names, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 40)  # most words go by the join
    long_word = "é" * 3000
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "The cat\x0bsat"), (5, "the CAT"), (5, "the CAT"), (None, "no id the"), (6, long_word + " the"), (7, "x" * 70 + " y"), (8, "x" * 70), *((n, f"w{n} the cat É") for n in range(9, 40))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, keys string").repartition(3)
    model, got = scored(df, pieces)
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(plain_scores(rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want] and model.total == want[0][4]
    assert np.allclose([g[4] for g in got], [w[5] for w in want])
    go_on = math.log1p(-(10**model.end))
    text = next(g[5] for g in got if g[0] == 4)
    mine = sum(plainly(w, pieces, names, model.exponent, go_on) for w in ("the", "cat", "sat")) / math.log(10) + model.end
    assert text == pytest.approx(mine, abs=1e-9)
    assert all(g[5] < 0 for g in got)
    best = [sum(c * plainly(w.decode(), pieces, names, e, go_on) for w, c in Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in (x or "").encode().lower().split()).items()) for e in range(3)]
    assert model.exponent == int(np.argmax(best))


def test_no_rows_and_nothing_to_learn_from(spark, pieces):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scored(none, pieces)[1].count() == 0
    held = next(n for n in range(100) if zlib.crc32(str(n).encode()) % 5 == 1)
    (row,) = scored(spark.createDataFrame([(held, "some words")], "doc_id long, text string"), pieces)[1].collect()
    assert (row.n_tokens, row.n_known) == (3, 0) and row.base_score == pytest.approx(0) and row.score < 0


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = lattice.op11_lattice(spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = sorted(plain_scores([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=str)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want] and np.allclose([r[5] for r in rows], [w[5] for w in want])
    assert all(r[6] < 0 for r in rows)


def spelt_plainly(word, spelling, names):
    """Chance of a word by pieces, and its expected pieces by place, over all cuts one by one."""
    s, n_pieces = lattice.MARK + word, len(spelling.pieces.hashes)
    counts, total = Counter(), 0.0

    def go_on(at, chance, used):
        nonlocal total
        if at == len(s):
            total += chance
            for u in used:
                counts[u] += chance
            return
        for n in range(1, min(spelling.pieces.longest, len(s) - at) + 1):
            place, part = 2 * (at > 0) + (at + n == len(s)), s[at : at + n]
            if part in names:
                which = int(np.searchsorted(spelling.pieces.hashes, lattice.piece_hash(lattice._codes(part))))
                go_on(at + n, chance * spelling.chance[place, which], [*used, (place, which)])
            if n == 1:
                go_on(at + 1, chance * spelling.chance[place, n_pieces] * math.exp(sum(spelling.by_byte[b] for b in part.encode())), [*used, (place, n_pieces)])

    go_on(0, 1.0, [])
    return total, {k: v / total for k, v in counts.items()}


def test_spelling_and_what_it_learns_against_all_cuts(pieces, names, monkeypatch):
    words = ["the", "hello", "straße", "日本", "a", "🎉", "▁▁", "\x00", "tion.", "zzzz"]
    spelling = lattice.first_spelling(pieces)
    for _ in range(2):
        plain = [spelt_plainly(w, spelling, names) for w in words]
        assert np.allclose(lattice.spelt(words, spelling), [math.log(p) for p, _ in plain], atol=1e-9)
        counts, want = np.zeros(spelling.chance.shape), np.zeros(spelling.chance.shape)
        lattice.expected(words, spelling, counts)
        for _, expected in plain:
            for at, n in expected.items():
                want[at] += n
        assert np.allclose(counts, want, atol=1e-9)
        spelling = spelling.learnt(counts)
        assert np.allclose(spelling.chance.reshape(2, -1).sum(1), 1)
    long_words = ["é" * 3000, "x" * 70, "internationalization" * 20, "🎉" * 33]
    together = lattice.spelt([*words, *long_words], spelling)
    monkeypatch.setattr(lattice, "SIDE", 40)
    assert np.isfinite(together).all() and np.allclose(lattice.spelt([*words, *long_words], spelling), together, rtol=1e-12)
    monkeypatch.setattr(lattice, "STRETCH", 2)
    assert np.allclose(lattice.spelt([*words, *long_words], spelling), together, rtol=1e-12)
    counts = np.zeros(spelling.chance.shape)
    lattice.expected(["x" * 70, ""], spelling, counts)  # in stretches: each word begins and ends once
    assert counts[:2].sum() == pytest.approx(2) and counts[[1, 3]].sum() == pytest.approx(2)
    assert lattice.spelt([], spelling).shape == (0,)


def test_chances_of_all_words_of_a_learnt_model_sum_to_less_than_one(spark, pieces):
    rows = [(n, t) for n, t in enumerate(["a b c ab", "a a b", "c c a ba", "b", None, ""] * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("teaches", F.lit(True))
    model = lattice.fit(d, "teaches", pieces, 2)
    seen = sum(10 ** r.log0 for r in model.words.collect())
    assert 0.5 < seen + 10**model.end < 1


def test_learnt_scores_of_odd_rows(spark, pieces, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 40)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "The cat\x0bsat"), (5, "the CAT"), (None, "no id the"), (6, "é" * 3000 + " the"), (7, "日本語 🎉 \x00"), *((n, f"w{n} the cat É") for n in range(9, 40))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("teaches", F.col("doc_id") > 8).withColumn("teaches", F.coalesce("teaches", F.lit(False)))
    got = {r.doc_id: r for r in lattice.score_documents(d, lattice.fit(d, "teaches", pieces, 2), ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert got[1].score == got[2].score == got[3].score
    assert got[5].score == pytest.approx(got[5].base_score, abs=0.5)  # known words cost what they should
    nothing = d.withColumn("teaches", F.lit(False))
    assert all(math.isfinite(r.score) and r.score < 0 for r in lattice.score_documents(nothing, lattice.fit(nothing, "teaches", pieces, 2), ["doc_id"]).collect())


def test_held_out_scores_are_near_the_base_score(spark):
    """Unlearnt chances gave 4.3 digits a token less than the base score, which no proper model reaches on new words."""
    rows = [r for r in lattice.op11_lattice(spark, f"{DATA}/sf0.01").collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    assert all(math.isfinite(r.score) for r in rows)
    base, score = (sum(getattr(r, c) for r in rows) / tokens for c in ("base_score", "score"))
    assert score > base - 0.8
    known = [r for r in rows if r.n_known == r.n_tokens]
    assert known and sum(r.score - r.base_score for r in known) > -0.15 * sum(r.n_tokens for r in known)
