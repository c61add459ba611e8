"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the majority of the XXH64 hashes of its word shingles, bit by bit.
Exact copies and documents with equal fingerprints fold into one fingerprint first, so that a group of
copies is one row whatever its size. Fingerprints within ``DISTANCE`` = 2 bits are found thus:

* The 64 bits are cut in segments of 23, 23 and 18. By pigeonhole one segment of such a pair is equal;
  the others differ in 2 bits at most.
* A 23-bit word decodes to all codewords of the perfect binary Golay code within 4 bits of it, which are
  one or six. Two words that are 2 bits apart share one: the codeword within 3 of a word between them.
* So each choice of the equal segment gives up to six keys: that segment and the codeword's index for
  another. Fingerprints that share a key are candidates, and their distance is counted.
* Keys that more than ``CROWD`` fingerprints share aren't paired. There, each fingerprint goes under the 65
  words within 1 bit of it: two fingerprints are within 2 bits just if they share such a word, so all that
  share one link to the least of them. That is exact, and its rows grow with the fingerprints, not pairs.

Components of the links come from star contraction (see components.py).

Defined results: a null, empty or wordless text has fingerprint 0 and links like any other; fewer than
three words are one shingle; rows with equal ids are one node; a null id never is a component's least
unless it is alone with its fingerprint's component; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import saved, spread_join, table
from eddyline.llm.components import components

DISTANCE = 2
SHINGLE = 3
SEED = 42
CROWD = 64
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None) -> int:
    """The majority of the shingles' hashes, a bit at a time; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII white space and A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for a in range(0, n, 65536):
        b = min(n, a + 65536)
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[a:b].tolist(), ends[a + SHINGLE - 1 : b + SHINGLE - 1].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, code (a hash of the text as it is), fp (the fingerprint's 64 bits as a long), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["code"], pa.array(fp, pa.int64())], ["doc_id", "code", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("code"), "text").mapInArrow(run, "doc_id long, code long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def golay_patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 at most: one, or one of weight 3 and five of 4 (a
    missing one is -1)."""
    bits = 1 << np.arange(23)
    patterns = [np.zeros(1, np.int64)]
    chosen = np.arange(23)[:, None]
    for weight in range(1, 5):
        patterns.append(bits[chosen].sum(1))
        if weight < 4:
            chosen = np.concatenate([np.stack([*np.repeat(chosen[chosen[:, -1] < k], 1, 0).T, np.full((chosen[:, -1] < k).sum(), k)], 1) for k in range(23)])
    errors = np.concatenate(patterns)
    of = _syndrome(errors)
    order = np.argsort(of, kind="stable")  # by syndrome, the lightest first
    errors, of = errors[order], of[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    out = np.full((2048, rank.max() + 1), -1, np.int64)
    out[of, rank] = errors
    return out


_tables: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Row for each 23-bit word: the 12-bit indices of the codewords within 4 bits; -1 where fewer."""
    if not _tables:
        patterns = golay_patterns()
        _tables.extend([patterns, _syndrome(np.arange(1 << 12)), _syndrome(np.arange(1 << 11) << 12)])
    patterns, low, high = _tables
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def _keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key); a key holds which segment is equal, its bits and the codeword."""
    bits = fp.view(np.uint64)
    segment = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owners, keys = [], []
    for equal, other in ((0, 1), (1, 0), (2, 0)):
        index = codeword_indices(segment[other])
        row, col = np.nonzero(index >= 0)
        owners.append(row)
        keys.append((equal << 40) | (segment[equal][row] << 12) | index[row, col])
    return np.concatenate(owners), np.concatenate(keys)


def _exploded(fps: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            for a in range(0, len(fp), 4096):
                row, key = make(fp[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(fp[a : a + 4096][row]), pa.array(key)], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, schema)


def _near_words(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return np.repeat(np.arange(len(fp)), 65), (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints ``fps`` (fp) that connect just what links within ``DISTANCE``
    bits connect: pairs where keys are shared by few, stars around a shared word where by many."""
    keys = _exploded(fps, "fp long, key long", _keys)
    sizes = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("sharing")).where("n > 1"), "simhash-sizes")
    shared = saved(spread_join(keys, sizes, "key").withColumnRenamed("sharing", "n"), "simhash-keys")
    few = shared.where(F.col("n") <= CROWD)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")
    crowded = _exploded(shared.where(F.col("n") > CROWD).select("fp").distinct(), "fp long, key long", _near_words)
    least = saved(crowded.groupBy("key").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-crowds")
    stars = spread_join(crowded, least, "key").where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, code, fp, component_id (least id reachable) and root (a fingerprint that names the component), a row for each
    row of ``documents``."""
    docs = saved(fingerprints(documents), "simhash-fp")
    classes = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-classes")
    roots = components(near_links(classes), "simhash-cc")
    named = saved(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "simhash-named")
    ids = saved(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-roots")
    by_fp = saved(spread_join(named, ids, "root").select("fp", "component_id", "root", F.col("rows").alias("n")), "simhash-components")
    return spread_join(docs, by_fp, "fp").select("doc_id", "code", "fp", "component_id", "root")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, that of least id (of rows with that id and different texts in one
    component the one with the least hash of its text); documents without an id stay. Rows that share an id but not a
    component are documents of their own."""
    found = near_duplicates(documents).where("doc_id is not null")
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "code")).alias("__k")).select(F.col("__k.doc_id").alias("__id"), F.col("__k.code").alias("__code")).distinct()
    coded = documents.where("doc_id is not null").withColumns({"__id": F.col("doc_id").cast("long"), "__code": F.xxhash64("text")})
    one = coded.join(saved(keep, "simhash-keep"), ["__id", "__code"], "left_semi").dropDuplicates(["__id", "__code"])
    return one.select(*documents.columns).unionByName(documents.where("doc_id is null")).select(*documents.columns)
