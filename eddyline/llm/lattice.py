"""Language-model scores: the probability of a text summed over all ways to cut it into pieces of an existing vocabulary.

Texts are lower-cased in ASCII and split at white space; each word, with the vocabulary's word mark before it, is a lattice
whose edges are pieces, and an end follows the last word. Pieces are drawn independently, the end with a chance learnt from
the training rows, so the text's probability is the product of its words' lattice sums, which a forward recursion in
log space gives. Bytes are pieces too: every text has a positive probability.

``fit`` with rounds, as the query calls it, learns the chances of the pieces. A word of the training rows is an edge from its
first to its last character too: its count less a discount gives its chance, and the discounts of all, estimated from the words
that training has once and twice, are the chance that a word is spelt by pieces (all words, so that is summed in for known ones as well).
What spelling has to give is new words, so it learns from distinct training words, each once: rounds of forward and backward
sums (in plain, scaled numbers; STRETCH characters at most side by side) expect pieces, by their place in the word: first or
later, last or not. The chances of all words sum to 1 at most, whereas the base score gives each of any number of unknown
words the same chance, so on texts of many new words it is the higher one.

Without rounds the chances are the vocabulary's own. The vocabulary file is read as it is. Scores of a unigram model are logarithms of probabilities; those of a BPE model are
ranks, which become probabilities by Zipf's law, (rank + SHIFT) to a power of ``EXPONENTS``: the one under which the training
words are likeliest counts. That choice and the counts of the base score come from all training rows.

Words are counted once for the corpus and each distinct word's lattice is summed once. Words that are one token in
``FREQUENT`` or more, of which there can't be more than that, are broadcast (``SHORT`` bytes each at most: longer words
go by their hash) and scored where the text is read; what is left of a document's words joins the table of words. A word that
isn't broadcast is less than one token in ``FREQUENT``, so no key of the join is hot.

Defined results: a null or empty text is the end alone; rows with a null id aren't held out, are trained on and scored; repeated
rows count and are scored each; other columns are ignored. Without training rows nothing is known and the first exponent
counts; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import held_out, saved, table

EXPONENTS = (0.8, 1.0, 1.2)
SHIFT = 2.7
MARK = "▁"
FREQUENT = 1 << 17
SHORT = 64
#: Characters of words whose lattices are summed side by side, and the length from which a word is summed alone.
AREA, LONG = 1 << 16, 512
#: Texts whose words a task holds at a time when it scores.
ROWS = 512
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
#: How often the query learns the spelling's chances from its own expected counts, and the pieces that the prior counts for.
ROUNDS, PRIOR = 3, 1000.0
#: Longest stretch of characters that is spelt in plain, scaled numbers, and the area of stretches side by side.
STRETCH, SIDE = 32, 1 << 14


def vocabulary_path() -> str:
    """The public vocabulary that queries use unless told otherwise."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


@dataclass(frozen=True)
class Pieces:
    """Sorted hashes of the pieces and, a row for each exponent, their natural log-probabilities and those of the bytes."""

    hashes: np.ndarray
    log_p: np.ndarray
    log_byte: np.ndarray
    longest: int
    hit: np.ndarray  # by the upper bits of a hash: one more than the place of the first piece that has them, 0 for none


def piece_hash(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = (h + c) * _FACTOR
    return h


def pieces_of(scores: dict[str, float], byte_scores: list[float], exponents: tuple[float, ...] = EXPONENTS) -> Pieces:
    """``scores`` of pieces and of the 256 bytes: log-probabilities if they sum to about 1, else ranks below 0. What a
    vocabulary of ranks gives to bytes (0) isn't a rank: they come behind all pieces."""
    names = sorted(scores)
    s, b = np.array([scores[n] for n in names], float), np.array(byte_scores, float)
    if 0.5 < np.exp(np.minimum(s, 0)).sum() < 1.5 and (s <= 0).all():
        log = np.concatenate([s, b])[None, :].repeat(len(exponents), 0)
    else:
        rank = np.concatenate([-s, np.full(256, float(len(s)))])
        log = -np.outer(exponents, np.log(rank + SHIFT))
    log -= np.logaddexp.reduce(log, axis=1)[:, None]
    hashes = np.array([piece_hash(_codes(n)) for n in names], np.uint64)
    order = np.argsort(hashes)
    hit = np.zeros(1 << _BITS, np.int32)
    hit[hashes[order][::-1] >> np.uint64(64 - _BITS)] = np.arange(len(hashes), 0, -1)
    return Pieces(hashes[order], log[:, : len(s)][:, order], log[:, len(s) :], max(map(len, names), default=1), hit)


def read_pieces(path: str, exponents: tuple[float, ...] = EXPONENTS) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    byte = {int(model.id_to_piece(i)[3:5], 16): model.get_score(i) for i in ids if model.is_byte(i)}
    plain = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return pieces_of(plain, [byte.get(b, 0.0) for b in range(256)], exponents)


def _byte_sums(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(exponents, *codes.shape): log-probability of each character as its UTF-8 bytes."""
    c = (codes - np.uint64(1)).astype(np.int64)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    lead = np.choose(size - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    out = pieces.log_byte[:, np.minimum(lead, 255)]
    for n in (2, 3, 4):
        tail = 0x80 | (c >> (6 * (size - n)).clip(0)) & 0x3F
        out = out + np.where(size >= n, pieces.log_byte[:, tail], 0.0)
    return out


def _edges(codes: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the flat places in ``codes`` (words, characters; 0 past a word's end) where a piece of it ends, and which."""
    h = np.zeros(codes.shape, np.uint64)
    for n in range(1, min(pieces.longest, codes.shape[1]) + 1):
        if n > 1:
            h[:, 1:] = h[:, :-1].copy()
        h = (h + codes) * _FACTOR
        if n > 1:
            h[:, : n - 1] = 0
        flat = h.ravel()
        at = np.flatnonzero((pieces.hit[flat >> np.uint64(64 - _BITS)] > 0) & (codes.ravel() > 0))
        at = at[at % codes.shape[1] >= n - 1]
        wanted = flat[at]
        found = pieces.hit[wanted >> np.uint64(64 - _BITS)] - 1
        other = np.flatnonzero(pieces.hashes[found] != wanted)
        found[other] = np.minimum(np.searchsorted(pieces.hashes, wanted[other]), len(pieces.hashes) - 1)
        ok = pieces.hashes[found] == wanted
        yield n, at[ok], found[ok]


def _side_by_side(words: list[np.ndarray], pieces: Pieces) -> np.ndarray:
    """(exponents, words) of words of like lengths."""
    size = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(size.max())), np.uint64)
    codes[np.arange(codes.shape[1]) < size[:, None]] = np.concatenate(words)
    n_exp, shape = len(pieces.log_p), codes.shape
    single = np.where(codes > 0, _byte_sums(np.maximum(codes, 1), pieces), -np.inf)
    edges = []
    for n, at, found in _edges(codes, pieces):
        log = np.full((n_exp, codes.size), -np.inf)
        log[:, at] = pieces.log_p[:, found]
        log = log.reshape(n_exp, *shape)
        edges.append(np.logaddexp(log, single) if n == 1 else log)
    ahead = np.full((shape[1] + 1, n_exp, shape[0]), -np.inf)
    ahead[0] = 0
    for t in range(1, shape[1] + 1):
        terms = np.stack([ahead[t - n] + edges[n - 1][:, :, t - 1] for n in range(1, min(t, len(edges)) + 1)])
        top = terms.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            ahead[t] = safe + np.log(np.exp(terms - safe).sum(0))
    return ahead[size, :, np.arange(len(words))].T


def _alone(word: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(exponents,) of one long word: its pieces are found stretch by stretch, its recursion remembers ``longest`` sums."""
    n_exp, keep = len(pieces.log_p), pieces.longest
    last = [[0.0] + [-math.inf] * (keep - 1) for _ in range(n_exp)]  # the newest first
    for begin in range(0, len(word), AREA):
        back = min(begin, keep - 1)
        part = word[begin - back : begin + AREA]
        single = _byte_sums(part, pieces)
        ends: list[list[tuple[int, int]]] = [[] for _ in part]
        for n, at, found in _edges(part[None, :], pieces):
            for a, f in zip(at.tolist(), found.tolist(), strict=True):
                ends[a].append((n, f))
        for e in range(n_exp):
            sums, log_p, by_byte = last[e], pieces.log_p[e].tolist(), single[e].tolist()
            for a in range(back, len(part)):
                terms = [sums[0] + by_byte[a], *(sums[n - 1] + log_p[f] for n, f in ends[a])]
                top = max(terms)
                sums.insert(0, top + math.log(sum(math.exp(x - top) for x in terms)))
                sums.pop()
    return np.array([s[0] for s in last])


def marginals(words: list[str], pieces: Pieces, go_on: float = 0.0) -> np.ndarray:
    """(exponents, words): natural logarithm of each word's probability, its mark included, over all segmentations; ``go_on``
    is the log-probability that a piece isn't the end, which each piece pays."""
    if go_on:
        pieces = Pieces(pieces.hashes, pieces.log_p + go_on, pieces.log_byte + go_on, pieces.longest, pieces.hit)
    out = np.zeros((len(pieces.log_p), len(words)))
    codes = [_codes(MARK + w) for w in words]
    order = sorted(range(len(words)), key=lambda i: len(codes[i]))
    with np.errstate(over="ignore"):
        at = 0
        while at < len(order):
            if len(codes[order[at]]) > LONG:
                out[:, order[at]] = _alone(codes[order[at]], pieces)
                at += 1
                continue
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(codes[order[stop]]) <= AREA and len(codes[order[stop]]) <= LONG:
                stop += 1
            out[:, order[at:stop]] = _side_by_side([codes[i] for i in order[at:stop]], pieces)
            at = stop
    return out


@dataclass(frozen=True)
class Spelling:
    """Chances of spelling a word by pieces, one drawn after another until one is the last. ``chance`` (4, pieces + 1) is by
    place, 2 * (not at the word's begin) + (at its end), and piece, the last being a character in bytes: a first piece's chances, ended or
    not, sum to 1, and so do a later one's. The chances of all words sum to 1 at most."""

    pieces: Pieces
    chance: np.ndarray
    by_byte: np.ndarray  # log-probabilities of bytes (256,), given that a character is spelt in them
    prior: np.ndarray  # as ``chance``, before anything was learnt

    def learnt(self, counts: np.ndarray) -> Spelling:
        """The spelling whose pieces are as frequent as in ``counts`` and ``PRIOR`` pieces of the prior."""
        more = (counts + PRIOR / 2 * self.prior).reshape(2, -1)
        return replace(self, chance=(more / more.sum(1, keepdims=True)).reshape(4, -1))


def first_spelling(pieces: Pieces) -> Spelling:
    """By the vocabulary's own chances (the middle exponent's), the same at each place, each piece as likely the last as not."""
    e = len(pieces.log_p) // 2
    all_bytes = np.logaddexp.reduce(pieces.log_byte[e])
    chance = np.tile(np.exp(np.append(pieces.log_p[e], all_bytes)) / 2, (4, 1))
    return Spelling(pieces, chance, pieces.log_byte[e] - all_bytes, chance)


def _character_bytes(codes: np.ndarray, spelling: Spelling) -> np.ndarray:
    """Like ``codes``: log-probability of each character's bytes."""
    own = Pieces(spelling.pieces.hashes, spelling.chance[:1], spelling.by_byte[None, :], 1, spelling.pieces.hit)
    low = _byte_sums(np.arange(1, 0x3001, dtype=np.uint64), own)[0]
    at = codes.astype(np.int64) - 1
    out = low[np.clip(at, 0, len(low) - 1)]
    high = at >= len(low)
    out[high] = _byte_sums(codes[high], own)[0]
    return out


def _spelt_edges(codes: np.ndarray, first: np.ndarray, last: np.ndarray, spelling: Spelling) -> tuple[np.ndarray, ...]:
    """(row, place of its last character, length, place in ``chance``, log-chance) of each piece in ``codes`` (stretches, characters), then
    of each character in bytes; ``first`` and ``last``: whether a stretch begins and ends its word."""
    n_pieces, size = len(spelling.pieces.hashes), (codes > 0).sum(1)
    parts = list(_edges(codes, spelling.pieces))
    in_bytes = np.flatnonzero(codes.ravel() > 0)
    at = np.concatenate([*(a for _, a, _ in parts), in_bytes])
    which = np.concatenate([*(f for _, _, f in parts), np.full(len(in_bytes), n_pieces)])
    length = np.repeat([*(n for n, _, _ in parts), 1], [*(len(a) for _, a, _ in parts), len(in_bytes)])
    row, end = np.divmod(at, codes.shape[1])
    place = 2 * ((end >= length) | ~first[row]) + ((end == size[row] - 1) & last[row])
    index = place * (n_pieces + 1) + which
    with np.errstate(divide="ignore"):
        log = np.log(spelling.chance).ravel()[index]
    log[len(at) - len(in_bytes) :] += _character_bytes(codes.ravel()[in_bytes], spelling)
    return row, end, length, index, log


def _spelt_side_by_side(codes: np.ndarray, first: np.ndarray, last: np.ndarray, spelling: Spelling, counts: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each stretch of ``codes`` (stretches, characters; 0 past an end); adds the expected number of each piece to
    ``counts``. A character's numbers are divided by the root of its chance of standing alone, so sums are between the product of such
    roots and its inverse, which ``STRETCH`` keeps in range."""
    size, (n, width) = (codes > 0).sum(1), codes.shape
    row, end, length, index, log = _spelt_edges(codes, first, last, spelling)
    one = length == 1
    alone = np.bincount(row[one] * width + end[one], np.exp(log[one]), n * width).reshape(n, width)
    scale = np.zeros((width + 1, n))
    scale[1:] = np.cumsum(np.log(np.where(codes > 0, alone, 1)) / 2, 1).T
    begin = end + 1 - length
    p = np.exp(log - scale[end + 1, row] + scale[begin, row])
    most = int(length.max())
    edges = np.bincount(((length - 1) * width + end) * n + row, p, most * width * n).reshape(most, width, n)
    ahead = np.zeros((width + 1, n))
    ahead[0] = 1
    for t in range(1, width + 1):
        for k in range(1, min(t, most) + 1):
            ahead[t] += ahead[t - k] * edges[k - 1, t - 1]
    each = np.arange(n)
    total = ahead[size, each]
    if counts is not None:
        behind = np.zeros((width + 1, n))
        behind[size, each] = 1
        for t in range(width - 1, -1, -1):
            for k in range(1, min(width - t, most) + 1):
                behind[t] += behind[t + k] * edges[k - 1, t + k - 1]
        counts += np.bincount(index, ahead[begin, row] * p * behind[end + 1, row] * (1 / total)[row], counts.size).reshape(counts.shape)
    return np.log(total) + scale[size, each]


def _spelt_alone(word: np.ndarray, spelling: Spelling) -> float:
    """Log-probability of one long word, stretch by stretch as ``_alone``."""
    keep = spelling.pieces.longest
    sums = [0.0] + [-math.inf] * (keep - 1)  # the newest first
    for begin in range(0, len(word), SIDE):
        back = min(begin, keep - 1)
        part = word[begin - back : begin + SIDE]
        ends: list[list[tuple[int, float]]] = [[] for _ in part]
        sides = np.array([begin == back]), np.array([begin + SIDE >= len(word)])
        _, end, length, _, log = _spelt_edges(part[None, :], *sides, spelling)
        for a, n, x in zip(end.tolist(), length.tolist(), log.tolist(), strict=True):
            ends[a].append((n, x))
        for a in range(back, len(part)):
            terms = [sums[n - 1] + x for n, x in ends[a]]
            top = max(terms)
            sums.insert(0, top + math.log(sum(math.exp(x - top) for x in terms)))
            sums.pop()
    return sums[0]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their marks, one after another, and where each begins and its length."""
    codes = _codes("".join(f"{MARK}{w}\n" for w in words))  # no word holds a line's end
    end = np.flatnonzero(codes == np.uint64(ord("\n") + 1))
    begin = np.append(0, end[:-1] + 1)[: len(end)]
    return codes, begin, end - begin


def _like_lengths(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``begin`` and the codes there, side by side (0 past ``size``)."""
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        widest = size[order[min(at + SIDE // size[order[at]], len(order) - 1)]]
        group = order[at : at + max(1, SIDE // widest)]
        place = np.arange(size[group].max())
        inside = place < size[group][:, None]
        yield group, np.where(inside, codes[np.where(inside, begin[group][:, None] + place, 0)], np.uint64(0))
        at += len(group)


def spelt(words: list[str], spelling: Spelling) -> np.ndarray:
    """Natural logarithm of each word's chance of being spelt, its mark included, over all segmentations."""
    out, (codes, begin, size) = np.zeros(len(words)), _flat(words)
    short = np.flatnonzero(size <= STRETCH)
    with np.errstate(over="ignore"):
        for group, part in _like_lengths(codes, begin[short], size[short]):
            whole = np.ones(len(group), bool)
            out[short[group]] = _spelt_side_by_side(part, whole, whole, spelling)
        for i in np.flatnonzero(size > STRETCH):
            out[i] = _spelt_alone(codes[begin[i] : begin[i] + size[i]], spelling)
    return out


def expected(words: list[str], spelling: Spelling, counts: np.ndarray) -> None:
    """Adds to ``counts`` (as ``chance``) how often each piece is expected in ``words``, once each; a long word is cut in stretches."""
    codes, begin, size = _flat(words)
    parts = -(-size // STRETCH)
    word = np.repeat(np.arange(len(words)), parts)
    place = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last = place == 0, place == parts[word] - 1
    length = np.where(last, size[word] - STRETCH * place, STRETCH)
    with np.errstate(over="ignore"):
        for group, part in _like_lengths(codes, begin[word] + STRETCH * place, length):
            _spelt_side_by_side(part, first[group], last[group], spelling, counts)


def key_of(word: bytes) -> bytes:
    """The word or, of a longer one, a hash behind a space, which no word holds."""
    return word if len(word) <= SHORT else b" " + hashlib.sha256(word).hexdigest()[: SHORT - 2].encode()


def _split(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text, one text at a time."""
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").lower().split()  # bytes: ASCII letters and white space only


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def word_counts(documents: DataFrame, training: str) -> DataFrame:
    """word, c, n: how often each word is in the rows that ``training`` (a boolean column) holds of, and in all; the end is the
    word of no characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, taught = Counter(), Counter()
            for words, teaches in zip(_split(batch["text"]), batch[training].to_pylist(), strict=True):
                words.append(b"")
                seen.update(words)
                if teaches:
                    taught.update(words)
            columns = [pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array([taught[w] for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "n"])

    parts = documents.select(F.col("text").cast("string").alias("text"), training).mapInArrow(count, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """What a fit leaves: WORD(key, word, c, n, log0...) as a written table and a handful of numbers."""

    words: DataFrame
    exponent: int  # which of ``EXPONENTS``
    end: float  # log10 of the end's chance
    total: int  # N: training tokens
    distinct: int  # V
    ends: int  # training documents
    every: int  # tokens of all rows

    def base(self, c):
        """log10 of the smoothed frequency of a token that training has c times (numbers or arrays)."""
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def learnt_spelling(taught: DataFrame, spelling: Spelling) -> Spelling:
    """One round of learning: the chances under which the pieces expected in each word of ``taught`` (word) are likeliest. What goes to
    the driver is a number for each piece and place."""
    shared = taught.sparkSession.sparkContext.broadcast(spelling)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shared.value.chance.shape)
        for batch in batches:
            expected(batch["word"].to_pylist(), shared.value, counts)
        (at,) = np.nonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at])], ["at", "n"])

    sums = taught.select("word").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(spelling.chance.size)
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return spelling.learnt(counts.reshape(spelling.chance.shape))


def _weigh_learnt(counted: DataFrame, pieces: Pieces, rounds: int, end_chance: float, total: int, distinct: int) -> DataFrame:
    """key, c, n, log0 of each word but the end, by chances learnt from the training words."""
    taught = counted.where("word != '' AND c > 0")
    spelling = first_spelling(pieces)
    for _ in range(rounds):
        spelling = learnt_spelling(taught, spelling)
    once, twice = taught.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    off = (once + 0.5) / (once + 2 * twice + 1)
    spell = off * distinct / total if total else 1.0
    shared = counted.sparkSession.sparkContext.broadcast(spelling)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            by_pieces = spelt(words, shared.value) + math.log(spell)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(batch["c"].to_numpy() - off, 0) / max(total, 1))
            value = (np.logaddexp(by_pieces, whole) + math.log1p(-end_chance)) / math.log(10)
            keys = pa.array([key_of(w.encode()) for w in words], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch["c"], batch["n"], pa.array(value)], ["key", "c", "n", "log0"])

    return saved(counted.where("word != ''").mapInArrow(weigh, "key string, c long, n long, log0 double"), "lattice-words")


def fit(documents: DataFrame, training: str, pieces: Pieces, rounds: int = 0) -> Model:
    """Counts and lattice sums of every word of ``documents`` (text and the boolean column ``training``): by the vocabulary's own
    chances or, with ``rounds``, by chances learnt in so many."""
    counted = saved(word_counts(documents, training), "lattice-counts")
    sums = counted.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("n"), F.max(F.when(F.col("word") == "", F.col("c")))).first()
    total, distinct, every, ends = (x or 0 for x in sums)
    chance = (ends + 0.5) / (total + 1)
    if rounds:
        words = _weigh_learnt(counted, pieces, rounds, chance, total - ends, distinct - (ends > 0))
        return Model(words, 0, math.log10(chance), total, distinct, ends, every)
    shared = counted.sparkSession.sparkContext.broadcast(pieces)
    logs = [f"log{i}" for i in range(len(pieces.log_p))]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            values = marginals(words, shared.value, math.log1p(-chance)) / math.log(10)
            keys = pa.array([key_of(w.encode()) for w in words], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch["c"], batch["n"], *map(pa.array, values)], ["key", "c", "n", *logs])

    words = saved(counted.where("word != ''").mapInArrow(weigh, ", ".join(["key string, c long, n long", *(f"{x} double" for x in logs)])), "lattice-words")
    likely = words.agg(*(F.sum(F.col("c") * F.col(x)).alias(x) for x in logs)).first()
    best = max(range(len(logs)), key=lambda i: (likely[i] or 0.0, -i))
    return Model(words, best, math.log10(chance), total, distinct, ends, every)


def score_documents(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """<keep>, n_tokens, n_known, base_score, score of each row of ``documents`` (text and the columns to ``keep``)."""
    log = f"log{model.exponent}"
    is_frequent = F.col("n") * FREQUENT >= model.every
    frequent = model.words.where(is_frequent).select("key", "c", F.col(log).alias("log")).toArrow()
    keys = [k.encode() for k in frequent["key"].to_pylist()]
    known, base = frequent["c"].to_numpy(), model.base(frequent["c"].to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast({k: v for k, *v in zip(keys, (known > 0).tolist(), base.tolist(), frequent["log"].to_pylist(), strict=True)})
    end, end_base, end_known = model.end, float(model.base(model.ends)), int(model.ends > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in _in_parts(batches):
            n_tokens, n_known, bases, logs, offsets, rest, times = [], [], [], [], [0], [], []
            for words in _split(batch["text"]):
                have, by_base, by_log = end_known, end_base, end
                for word, n in Counter(words).items():
                    key = key_of(word)
                    if key in common:
                        is_known, b, p = common[key]
                        have += n * is_known
                        by_base += n * b
                        by_log += n * p
                    else:
                        rest.append(key)
                        times.append(n)
                offsets.append(len(rest))
                for column, value in ((n_tokens, len(words) + 1), (n_known, have), (bases, by_base), (logs, by_log)):
                    column.append(value)
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(rest, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
            numbers = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(logs, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *numbers, *lists], [*keep, "n_tokens", "n_known", "base_score", "score", "keys", "times"])

    own = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    read = own.mapInArrow(score, f"{fields}, n_tokens long, n_known long, base_score double, score double, keys array<string>, times array<long>")
    rows = saved(read.withColumn("row", F.monotonically_increasing_id()), "lattice-rows")
    pairs = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    rare = model.words.where(~is_frequent).select("key", (F.col("c") > 0).cast("long").alias("k"), F.log10((F.col("c") + 0.5) / (model.total + 0.5 * (model.distinct + 1))).alias("b"), F.col(log).alias("p"))
    more = pairs.join(rare, "key").groupBy("row").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in "kbp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.join(more, "row", "left").select(*keep, "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("p")).alias("score"))


def op11_lattice(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's base score and lattice probability, learnt from rows whose crc32(doc_id) mod 5 is not 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out")).withColumn("teaches", ~F.col("held_out"))
    model = fit(documents, "teaches", read_pieces(path or vocabulary_path()), ROUNDS)
    scored = score_documents(documents, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
