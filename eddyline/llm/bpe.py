"""Byte-level BPE by speculation and verification.

Each distinct word is cut by greedy longest match, a guess that is mostly right and needs no merging. The
guess is BPE's own result just if every token builds up from its bytes as a whole and no merge ever crosses
from a token to the next. For a pair of neighbours that is settled from the merge tree alone: go back in
time through the right edge of the left token and the left edge of the right one; at each moment the two
parts that face each other would merge if the vocabulary joins them sooner than either was used up. All
pairs of a batch are checked so at once in numpy. Only words with a failing pair are merged exactly, with a
heap. Words that were encoded are remembered, ``MEMO`` of them at most.

The vocabulary file (the tokenizers library's JSON) is read on the driver and sent to the tasks: its size is
the vocabulary's. Words split as by the file's byte-level splitter; added tokens in a text are found first.

Defined results: a null text is an empty one, with no tokens; repeated rows are encoded each; very long
texts are split a stretch of words at a time; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import table

MEMO = 400_000
LONG_WORD = 64
SHORT = 32
STRETCH = 1 << 20
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Classes of the characters below U+0250, so that Latin text needs no property lookups.
_LATIN_SPACE, _LATIN_LETTER, _LATIN_NUMBER = "\\t-\\r\\x20\\x85\\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"


def _words_pattern(space: str, letter: str, number: str) -> str:
    return f"{_ENDINGS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


_LATIN = re.compile(_words_pattern(_LATIN_SPACE, _LATIN_LETTER, _LATIN_NUMBER))
_BEYOND = re.compile("[^\0-ɏ]")


#: Letters and numbers assigned after Unicode 16, which the tokenizers library's tables end with.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def _any_pattern() -> regex.Pattern:
    """For all characters; those of ``_NEWER`` are neither letters nor numbers."""
    new = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _NEWER)
    letter, number = (f"[\\p{{{k}}}--[{new}]]" for k in "LN")
    return regex.compile(f"(?V1){_ENDINGS}| ?{letter}+| ?{number}+| ?(?:[^\\s\\p{{L}}\\p{{N}}]|[{new}])+|\\s+(?!\\S)|\\s+")


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, the rest
    for those from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merge tree as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in what is around them")
        byte = byte_of_char()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.text = [b""] * size
        for token, i in vocab.items():
            self.text[i] = bytes(byte[c] for c in token)
        for token, i in self.added.items():
            self.text[i] = token.encode()
        self.size = size
        self.left, self.right, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs, ids = [], []
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i = vocab[a + b]
            pairs.append(vocab[a] * size + vocab[b])
            ids.append(i)
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = vocab[a], vocab[b], r
        order = np.argsort(pairs)
        self.pair, self.pair_rank = np.array(pairs)[order], order
        self.by_pair = dict(zip(pairs, zip(range(len(ids)), ids, strict=True), strict=True))
        self.by_bytes = {t: i for i, t in enumerate(self.text) if t and i not in self.added.values()}
        self.longest = max(map(len, self.by_bytes))
        self.of_byte = np.array([self.by_bytes[bytes([b])] for b in range(256)], np.int64)
        self.of_rank = np.array(ids, np.int64)
        # the lengths of tokens that begin with two given bytes, the longest first, by how much is left of the word
        kinds: dict[bytes, set[int]] = {}
        for t in self.by_bytes:
            if len(t) > 1:
                kinds.setdefault(t[:2], set()).add(len(t))
        self.lengths = {k: [[n for n in sorted(v, reverse=True) if n <= most] for most in range(LONG_WORD + 1)] + [sorted(v, reverse=True)] for k, v in kinds.items()}
        # a token is whole if its two parts are and nothing crosses between them before they merge
        whole = self.rank < 0
        made = np.argsort(self.rank, kind="stable")
        made = made[self.rank[made] >= 0]
        fine = ~self.crossed(self.left[made], self.right[made], self.rank[made])
        for i, ok in zip(made.tolist(), fine.tolist(), strict=True):
            whole[i] = ok and whole[self.left[i]] and whole[self.right[i]]
        self.whole = whole

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def crossed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours whether a merge crosses from the one to the other (before ``until``)."""
        end = np.full(len(a), np.iinfo(np.int64).max - 1) if until is None else until
        x, y, x_used, y_used = a.copy(), b.copy(), end.copy(), end.copy()
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        while len(left):
            m = self._merge_rank(x, y)
            hit = (m < x_used) & (m <= y_used)
            out[left[hit]] = True
            later = self.rank[y] >= self.rank[x]  # of two equal parts the left one was made first
            over = hit | ((self.rank[x] < 0) & (self.rank[y] < 0))
            nx, ny = np.where(later, x, self.right[x]), np.where(later, self.left[y], y)
            x_used, y_used = np.where(later, x_used, self.rank[x]), np.where(later, self.rank[y], y_used)
            on = ~over
            x, y, x_used, y_used, left = nx[on], ny[on], x_used[on], y_used[on], left[on]
        return out

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, known, lengths = [], 0, len(word), self.by_bytes, self.lengths
        while at < n:
            kinds = lengths.get(word[at : at + 2])
            if kinds:
                for k in kinds[min(n - at, LONG_WORD + 1)]:
                    i = known.get(word[at : at + k])
                    if i is not None:
                        break
                else:
                    k, i = 1, known[word[at : at + 1]]
            else:
                k, i = 1, known[word[at : at + 1]]
            out.append(i)
            at += k
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank and then from the left, with a heap over a linked list."""
        ids = [self.by_bytes[word[i : i + 1]] for i in range(len(word))]
        n, by_pair, size = len(ids), self.by_pair, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := by_pair.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = by_pair[a * size + b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := by_pair.get(ids[i] * size + ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := by_pair.get(ids[h] * size + ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def exact_many(self, words: list[bytes]) -> list[np.ndarray]:
        """``exact`` for many words of up to ``SHORT`` bytes in step: each round merges every word's best pair."""
        none = np.iinfo(np.int64).max
        width = max(map(len, words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[raw], -1)
        rank = np.where(ids[:, 1:] >= 0, self._merge_rank(ids[:, :-1], ids[:, 1:]), none)
        rank = np.concatenate([rank, np.full((len(words), 1), none)], 1)
        out: list[np.ndarray | None] = [None] * len(words)
        row, column = np.arange(len(words)), np.arange(width)
        while len(row):
            j = rank.argmin(1)
            here = np.arange(len(row))
            r = rank[here, j]
            done = r == none
            for k in np.flatnonzero(done).tolist():
                out[row[k]] = ids[k][ids[k] >= 0]
            on = ~done
            row, j, r, ids, rank = row[on], j[on], r[on], ids[on], rank[on]
            if not len(row):
                break
            here = np.arange(len(row))
            moved = np.minimum(column + (column > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, moved, 1), np.take_along_axis(rank, moved, 1)
            ids[:, -1], rank[:, -1] = -1, none
            ids[here, j] = self.of_rank[r]
            after = np.where(j + 1 < width, ids[here, np.minimum(j + 1, width - 1)], -1)
            rank[here, j] = np.where(after >= 0, self._merge_rank(ids[here, j], np.maximum(after, 0)), none)
            has = np.flatnonzero(j > 0)
            rank[has, j[has] - 1] = self._merge_rank(ids[has, j[has] - 1], ids[has, j[has]])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[list[np.ndarray], int]:
        """Ids of each word, and how many words had to be merged exactly."""
        guesses = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(words))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        fail = np.zeros(len(words), bool)
        fail[of[~self.whole[flat]]] = True
        near = np.flatnonzero(of[1:] == of[:-1]) if len(flat) else np.zeros(0, np.int64)
        pair, inverse = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        fail[of[near[self.crossed(*np.divmod(pair, self.size))[inverse]]]] = True
        ends = np.cumsum(sizes)
        out = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        failed = sorted(np.flatnonzero(fail).tolist(), key=lambda i: len(words[i]))
        short = [i for i in failed if len(words[i]) <= SHORT]
        for at in range(0, len(short), 4096):
            for i, ids in zip(part := short[at : at + 4096], self.exact_many([words[i] for i in part]), strict=True):
                out[i] = ids
        for i in failed[len(short) :]:
            out[i] = np.array(self.exact(words[i]), np.int64)
        return out, int(fail.sum())


class Encoder:
    """Encodes texts with one vocabulary; lives in a task's process."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.memo: dict[str, bytes] = {}
        self.pattern = None
        self.added = re.compile("|".join(map(re.escape, sorted(bpe.added, key=len, reverse=True)))) if bpe.added else None

    def _splitter(self, text: str):
        if not _BEYOND.search(text):
            return _LATIN
        if self.pattern is None:
            self.pattern = _any_pattern()
        return self.pattern

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of words that the memo lacks; those that aren't too long are remembered."""
        new = sorted(words)
        ids, _ = self.bpe.encode_words([w.encode("utf-8", "replace") for w in new])
        found = {w: i.astype("<u4").tobytes() for w, i in zip(new, ids, strict=True)}
        if len(self.memo) + len(found) > MEMO:
            self.memo.clear()
        self.memo.update((w, i) for w, i in found.items() if len(w) <= LONG_WORD)
        return found

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        """Stretches of words, and the ids of added tokens between them."""
        at, found = 0, self.added.finditer(text) if self.added else ()
        for m in found:
            yield from self._words(text[at : m.start()])
            yield np.array([self.bpe.added[m.group()]], "<u4").tobytes()
            at = m.end()
        yield from self._words(text[at:] if at else text)

    def _words(self, text: str) -> Iterator[list[str]]:
        pattern = self._splitter(text)
        if len(text) <= STRETCH:
            yield pattern.findall(text)
        else:
            matches = pattern.finditer(text)
            while some := [m.group() for m in islice(matches, STRETCH // 8)]:
                yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self._parts(text):
                held.append((i, part))
                size += len(part)
                if size >= STRETCH // 4:
                    self._settle(held, out)
                    held, size = [], 0
        self._settle(held, out)
        return [b"".join(x) for x in out]

    def _settle(self, held: list[tuple[int, list[str] | bytes]], out: list[list[bytes]]) -> None:
        words = {w for _, part in held if isinstance(part, list) for w in part}
        look = self.memo
        missing = words.difference(look)
        if missing:
            if len(look) + len(missing) > MEMO or any(len(w) > LONG_WORD for w in missing):
                known = {w: look[w] for w in words if w in look}
                look = known | self._learn(missing)
            else:
                self._learn(missing)
        for i, part in held:
            out[i].append(b"".join([look[w] for w in part]) if isinstance(part, list) else part)

    def decode(self, ids: bytes) -> str:
        text = self.bpe.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.value.size and id(shared.value) not in _encoders:
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, little-endian
    unsigned 32-bit integers)."""
    shared = documents.sparkSession.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            encoder = _encoder(shared)
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                coded = encoder.encode([t.as_py() or "" for t in batch["__text"]])
                sha = [hashlib.sha256(c).hexdigest() for c in coded]
                back = [hashlib.sha256(encoder.decode(c).encode("utf-8", "replace")).hexdigest() for c in coded]
                columns = [*(batch[c] for c in keep), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(sha), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(coded, pa.binary())] * ids, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    inputs = documents.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return inputs.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table with doc_id and ids, as ``encode`` made it."""
    shared = encoded.sparkSession.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _encoder(shared)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([encoder.decode(i.as_py() or b"") for i in batch["ids"]])], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return encode(documents, vocabulary_path(), ids=False)


def encoded_texts(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: each row's ids, ready for training, beside its id, language and source."""
    return encode(documents, vocabulary_path(), keep=("doc_id", "lang", "source"))
