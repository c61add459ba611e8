"""Images, archives, vectors and the pipeline against brute force and round trips."""

import hashlib
import io
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eddyline.llm import neighbours, quality, secrets, simhash, warc, webp
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


class Writer:
    """A plain writer of lossless image data: every code spends about the same bits on all its symbols."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, size):
        n = (size - 1).bit_length()
        short = (1 << n) - size
        lengths = [n - 1] * short + [n] * (size - short)
        own = [4 if s < 13 else 5 for s in range(19)]
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        of = {s: (c, k) for s, k, c in webp.canonical(own)}
        for x in lengths:
            self.put(*of[x])
        return {s: (c, k) for s, k, c in webp.canonical(lengths)}

    def codes(self, cache_bits):
        return [self.code(s) for s in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]

    def number(self, code, base, value):
        """A length or distance by prefix and extra bits."""
        if value <= 4:
            self.put(*code[base + value - 1])
            return
        high = (value - 1).bit_length() - 1
        self.put(*code[base + 2 * high + (value - 1 >> high - 1 & 1)])
        self.put(value - 1 & (1 << high - 1) - 1, high - 1)

    def literal(self, group, pixel):
        for code, shift in zip(group[:4], (8, 16, 0, 24), strict=True):
            self.put(*code[pixel >> shift & 255])

    def plain(self, pixels, main=False):
        self.put(0, 1)
        if main:
            self.put(0, 1)
        group = self.codes(0)
        for p in pixels:
            self.literal(group, int(p))

    def head(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("cache_bits", [0, 4])
@pytest.mark.parametrize("groups", [False, True])
def test_back_references_cache_and_groups(cache_bits, groups):
    rng = np.random.default_rng(cache_bits)
    width, height = 21, 17
    n, w, out, cache = width * height, Writer(), [], {}
    w.head(width, height)
    w.put(0, 1)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    w.put(int(groups), 1)
    which = np.zeros((5, 6), int)
    if groups:
        w.put(0, 3)  # tiles of 4
        which = rng.integers(0, 3, (5, 6))
        w.plain([(0xFF << 24 | int(g) << 8) for g in which.ravel()])
    sets = [w.codes(cache_bits) for _ in range(which.max() + 1)]
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)

    def emit(p):
        out.append(p)
        if cache_bits:
            cache[slot(p)] = p

    while len(out) < n:
        group = sets[which[len(out) // width // 4, len(out) % width // 4]]
        kind = rng.integers(3)
        if kind == 0 and out:
            length = int(rng.integers(1, min(30, n - len(out)) + 1))
            d = int(rng.integers(1, len(out) + 1))
            near = [k for k, (x, y) in enumerate(webp.NEAR, 1) if max(1, x + y * width) == d]
            w.number(group[0], 256, length)
            w.number(group[4], 0, near[0] if near and rng.integers(2) else d + 120)
            for _ in range(length):
                emit(out[-d])
        elif kind == 1 and cache:
            k, p = list(cache.items())[rng.integers(len(cache))]
            w.put(*group[0][280 + k])
            emit(p)
        else:
            p = int(rng.integers(1 << 32))
            w.literal(group, p)
            emit(p)
    assert webp.decode_stream(w.data())[2].tolist() == out


@pytest.mark.parametrize("size", [(1, 1), (9, 7), (40, 33)])
def test_predictors_and_cross_colour(size):
    (width, height), rng = size, np.random.default_rng(2)
    pixels = rng.integers(0, 1 << 32, width * height, dtype=np.uint32)
    c = webp._channels(pixels).reshape(height, width, 4)
    # colours first: each block takes parts of green and red off
    tiles = (-(-height // 4), -(-width // 4))
    element = rng.integers(0, 256, (*tiles, 4))
    s8 = lambda v: (int(v) & 255 ^ 128) - 128
    turned = c.copy()
    for y in range(height):
        for x in range(width):
            _, rb, gb, gr = element[y // 4, x // 4]
            a, r, g, b = c[y, x]
            turned[y, x] = a, (r - (s8(gr) * s8(g) >> 5)) & 255, g, (b - (s8(gb) * s8(g) >> 5) - (s8(rb) * s8(r) >> 5)) & 255
    mode = rng.integers(0, 14, tiles)
    left = turned.copy()
    for y in range(height):
        for x in range(width):
            at = lambda yy, xx: tuple(turned[yy, xx].tolist())
            if x == y == 0:
                p = (255, 0, 0, 0)
            elif y == 0:
                p = at(0, x - 1)
            elif x == 0:
                p = at(y - 1, 0)
            else:
                p = webp.predicted(int(mode[y // 4, x // 4]), at(y, x - 1), at(y - 1, x), at(y - 1, x + 1) if x + 1 < width else at(y, 0), at(y - 1, x - 1))
            left[y, x] = (turned[y, x] - p) & 255
    w = Writer()
    w.head(width, height)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(0, 3)
    w.plain((0xFF000000 + element[..., 1] * 65536 + element[..., 2] * 256 + element[..., 3]).ravel())
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    w.plain((mode * 256).ravel())
    w.put(0, 1)
    w.plain(webp._packed(left).ravel(), True)
    assert webp.decode_stream(w.data())[2].tolist() == pixels.tolist()


def test_predictor_values():
    l, t, tr, tl = (10,) * 4, (20,) * 4, (31,) * 4, (250,) * 4  # noqa: E741
    got = [webp.predicted(m, l, t, tr, tl)[1] for m in range(14)]
    assert got == [0, 10, 20, 31, 250, 20, 130, 15, 135, 25, 77, 10, 0, 0]
    assert webp.predicted(13, l, t, tr, (3,) * 4)[0] == 21 and webp.predicted(12, l, t, tr, (3,) * 4)[0] == 27


@pytest.mark.parametrize("colours", [1, 2, 4, 11, 200])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4))
    width, height = 13, 5
    index = rng.integers(0, colours, (height, width))
    packing = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across, depth = -(-width >> packing), 8 >> packing
    packed = np.zeros((height, across), int)
    for x in range(width):
        packed[:, x >> packing] |= index[:, x] << (x & (1 << packing) - 1) * depth
    w = Writer()
    w.head(width, height)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    w.plain(webp._packed(np.diff(palette, axis=0, prepend=0)))
    w.put(0, 1)
    w.plain((packed * 256).ravel(), True)
    assert webp.decode_stream(w.data())[2].tolist() == webp._packed(palette)[index].ravel().tolist()


def test_payload_round_trips(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"x" * 576, b"x" * 577, rng.bytes(200_000), "été ß 日本 ".encode() * 5000, b"\xff" * 4000, bytes(range(256)) * 9]
    for t in texts:
        p = webp.payload_of(t)
        assert len(p) % 576 == 0 and len(p) >= 576 and p.startswith(t) and set(p[len(t) :]) <= {255}
        assert webp.decode_payload(webp.encode_payload(p))[0] == p
    monkeypatch.setattr(webp, "MOST_ROWS", 3)
    p = webp.payload_of(rng.bytes(5000))
    assert webp.decode_payload(webp.encode_payload(p))[0] == p and webp.encode_payload(p).count(b"RIFF") == 3


def test_broken_images_are_refused():
    media = webp.encode_payload(webp.payload_of(b"some text"))
    for bad in (media[:40], b"RIFX" + media[4:], media[:20] + b"\0" + media[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_payload(bad)


def test_image_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r for r in webp.digests(webp.store(docs)).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        text = (r.text or "").encode()
        p = text + b"\xff" * (-len(text) % 576 if text else 576)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert webp.op6_webp(spark, SF).count() == docs.count() - 2 and webp.store(docs.limit(0)).count() == 0
    pixels = webp.pixel_arrays(webp.store(docs.where("doc_id = -2"))).first()
    assert (pixels.width, pixels.height, bytes(pixels.samples)) == (576, 1, b"\xff" * 576)


PAGES = [(3, "http://a", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, None), (5, "x\r\ny: z", ""), (4, "u", "é" * 200_000), (None, "n", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (9, "w", "\r\n\r\nWARC/1.1\r\n\x1f")]


@pytest.mark.parametrize("split", [7, 1000, 1 << 20])
def test_archives_round_trip_whatever_the_ranges(spark, tmp_path, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", pa_lit())
    folder = f"file://{tmp_path}/warc"
    files = warc.write_archives(pages.repartition(2), folder)
    rows = warc.read_archives(files, folder, split, payloads=True).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[1]] == ["response"] * 2 and (by[3][0].record_type, by[3][0].refers_to) == ("revisit", 1)
    assert by[None][0].record_type == "response" and by[5][0].refers_to == 2 and by[2][0].payload_bytes == 0
    assert bytes(by[4][0].payload).decode() == "é" * 200_000 and by[3][0].payload is None and by[3][0].payload_bytes == 11
    assert by[3][0].payload_digest == warc.digest32(b"<p>same</p>")


def pa_lit():
    from pyspark.sql import functions as F

    return F.lit("a column with a clashing name")


def test_lookalike_bytes_are_passed_over():
    noise = b"\x1f\x8b\x08" + b"\0" * 20
    inner = zlib.compressobj(9, zlib.DEFLATED, 31)
    other = inner.compress(b"not a record") + inner.flush()
    first, second = (warc.member(i, "u", bytes([97 + i]) * 300, None, "d") for i in (1, 2))
    body = noise + other + first + second

    class Source(io.BytesIO):
        def size(self):
            return len(body)

        def read_at(self, n, at):
            return body[at : at + n]

    found = [at for a in range(0, len(body), 5) for at, _ in warc.read_range(Source(), a, min(a + 5, len(body)))]
    assert found == [len(noise) + len(other), len(noise) + len(other) + len(first)]


def test_archive_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(c.execute(warc.SQL).fetchall())
    got = sorted(tuple(r) for r in warc.op8_warc(spark, SF).collect())
    assert got == want
    empty = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    from eddyline.llm.common import scratch_path

    folder = scratch_path(spark, "none")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0


def brute_links(rows):
    ok = [(i, np.array(v, float) / np.abs(v).max()) for i, v in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = []
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((i, j))
    return links


def test_neighbours_of_groups_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    vectors = [rng.normal(size=16).tolist() for _ in range(150)]
    for group, spread in ((40, 0.05), (25, 0.02), (3, 0.05), (2, 0.01)):
        base = rng.normal(size=16)
        vectors += [(base + spread * rng.normal(size=16)).tolist() for _ in range(group)]
    vectors += [vectors[0], vectors[0], (np.array(vectors[1]) * 1e200).tolist(), None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node string, n_links int")
    links = brute_links(vectors)
    want, parent = np.zeros(len(vectors), int), list(range(len(vectors)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        want[[i, j]] += 1
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    result, recall = neighbours.near_duplicates(df)
    got = {r.vec_id: r for r in result.collect()}
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"] and len(got) == len(vectors) and recall >= 0.9
    mine = np.array([got[i].n_links for i in range(len(vectors))])
    assert (mine <= want).all() and mine.sum() >= 0.95 * want.sum()
    assert all(find(got[i].component_id) == find(i) for i in got) and all(got[i].kept == (got[i].component_id == i) for i in got)
    assert neighbours.near_duplicates(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("tile", [1024, 64])
def test_links_of_a_loose_group_are_all_counted(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile, raising=False)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    spread = np.sqrt(1 / 0.96 - 1) / 8
    vectors = [(base + spread * rng.normal(size=64)).tolist() for _ in range(300)] + [rng.normal(size=64).tolist() for _ in range(100)]
    vectors += [vectors[0]] * 3
    want = np.zeros(len(vectors), int)
    for i, j in brute_links(vectors):
        want[[i, j]] += 1
    got, recall = neighbours.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    by_id = {r.vec_id: r.n_links for r in got.collect()}
    assert want[:300].min() > neighbours.K and [by_id[i] for i in range(len(vectors))] == want.tolist() and recall == 1


def test_audit_counts_nodes_once_and_small_groups_apart():
    assert neighbours.least_mean_recall([(1000, 1000)] * 100 + [(1, 0)] * 20) == 0
    assert neighbours.least_mean_recall([]) == 1
    assert neighbours.orders_needed(4) == neighbours.TABLES and neighbours.orders_needed(19) > 2 * neighbours.TABLES


def test_a_failed_audit_ends_in_a_whole_comparison(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "first_graph", lambda nodes, n, k, seed: spark.createDataFrame([], neighbours._EDGE))
    monkeypatch.setattr(neighbours, "TRIES", 1)
    monkeypatch.setattr(neighbours, "TILE", 32, raising=False)
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for base in rng.normal(size=(60, 16)) for v in base + 0.05 * rng.normal(size=(2, 16))]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    want = np.zeros(len(vectors), int)
    for i, j in brute_links(vectors):
        want[[i, j]] += 1
    got, recall = neighbours.near_duplicates(df)
    got = {r.vec_id: r for r in got.collect()}
    assert recall == 1 and want.sum() > 100 and [got[i].n_links for i in range(len(vectors))] == want.tolist()
    assert all(got[i].component_id == i - 1 for i in range(1, len(vectors), 2) if want[i])


@pytest.mark.parametrize(("dim", "n"), [(3, 700), (5, 700), (8, 700)])
def test_links_of_a_continuum_are_found(spark, dim, n):
    x = np.random.default_rng(dim).normal(size=(n, dim))
    vectors = (x / np.linalg.norm(x, axis=1)[:, None]).tolist()
    want = np.zeros(n, int)
    for i, j in brute_links(vectors):
        want[[i, j]] += 1
    result, recall = neighbours.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.n_links for r in result.collect()}
    found = np.array([got[i] for i in range(n)])
    assert recall >= 0.95 and (found <= want).all() and (found[want > 0] / want[want > 0]).mean() >= 0.95


def test_neighbours_query(spark):
    got = neighbours.op3_neighbours(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_pipeline(spark):
    """Each stage against brute force on what the one before it kept, and the run against the stages."""
    from collections import Counter

    from tokenizers import Tokenizer

    from eddyline.llm import bpe, mixing
    from tests.llm.test_text_operators import brute_spans, union

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    after = {}
    frame = docs
    for name in list(stage)[:-1]:
        frame = corpus_pipeline.saved(stage[name](spark, frame, SF), "test")
        after[name] = {r.doc_id: r for r in frame.collect()} if not name.startswith("mixing") else frame.collect()
    good, one, clean, mixed = after.values()
    assert set(good) == {r.doc_id for r in quality.op1_quality(spark, SF).where("predicted = 1").collect()}

    ids = sorted(good)
    prints = [simhash.fingerprint(good[i].text) for i in ids]
    roots = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(one) == sorted({ids[r] for r in roots}) and len(one) < len(good)

    assert set(clean) == set(one)
    for i, r in clean.items():
        spans = secrets.scan(pa.array([one[i].text]), secrets.BASE + secrets.EXTRA)[0]
        assert not brute_spans(r.text) and (r.text == one[i].text) == (not spans) and (not brute_spans(one[i].text) or spans)
        assert r.n_chars == (len(r.text) if spans else one[i].n_chars)

    frame = spark.createDataFrame(list(clean.values()), docs.schema)
    words, whole = Counter(), {i: r.text.split() for i, r in clean.items()}
    for r in mixed:
        mine, at = r.text.split(), iter(whole[r.doc_id])
        words[r.doc_id] += len(mine)
        assert all(w in at for w in mine)
    plan = mixing.mix(frame).agg({"taken": "sum", "size": "sum"}).first()
    assert abs(sum(words.values()) - plan["sum(taken)"]) <= 0.02 * plan["sum(taken)"] and all(n <= 2 * len(whole[i]) for i, n in words.items())

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = rows.collect()
    encoded = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([r.text for r in mixed], add_special_tokens=False)]
    want = Counter((r.doc_id, len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r, e in zip(mixed, encoded, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in got)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, SF)
        assert out.count() == 0, name
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns


def test_code_lengths_are_complete_and_bounded():
    rng = np.random.default_rng(0)
    for n in (2, 3, 40, 280):
        counts = (1.7 ** rng.uniform(0, 40, n)).astype(np.int64) * rng.integers(0, 2, n)
        counts[:2] = 1, 10**9
        lengths = webp.code_lengths(counts)
        assert max(lengths) <= webp.LONGEST and sum(2.0**-k for k in lengths if k) == 1 and all((k > 0) == (c > 0) for k, c in zip(lengths, counts, strict=True))
    assert webp.code_lengths(np.array([0, 5])) == [0, 1] and webp.code_lengths(np.zeros(3, int)) == [0, 0, 0]


def test_matches_are_repeats():
    rng = np.random.default_rng(5)
    base = rng.bytes(300)
    data = np.frombuffer(base + rng.bytes(50) + base[20:200] + b"z" * 9000 + base[:23], np.uint8)
    found = webp.matches(data)
    end = 0
    for place, length, distance in found:
        assert place >= end and distance <= place and webp.LEAST_MATCH <= length <= 4096 and all(data[i] == data[i - distance] for i in range(place, place + length))
        end = place + length
    assert sum(n for _, n, _ in found) > 9000 + 150


def test_the_encoder_uses_what_is_shorter():
    kinds = {"palette": np.random.default_rng(3).integers(0, 3, 3000).astype(np.uint8).tobytes(), "repeats": b"".join(b"%04d some words that come again and again, line by line\n" % i for i in range(60)), "text": b"short text"}
    heads = {}
    for name, t in kinds.items():
        stream = webp.encode_payload(webp.payload_of(t))[20:]
        bits = webp.Bits(stream, 40)
        heads[name] = bits.read(1) and bits.read(2)
    assert heads == {"palette": webp.PALETTE, "repeats": webp.SUBTRACT_GREEN, "text": webp.SUBTRACT_GREEN}
    long = webp.payload_of(kinds["repeats"])
    assert len(webp.encode_payload(long)) < 0.35 * len(long)


def two_groups(seed, dim, size, bridges, angle):
    """Two tight groups ``angle`` degrees apart, of each ``bridges`` members that lean towards the other, and far vectors."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    centres = a, np.cos(np.radians(angle)) * a + np.sin(np.radians(angle)) * b
    out = []
    for c, other in (centres, centres[::-1]):
        e = rng.normal(size=(size, dim))
        e -= (e @ c)[:, None] * c
        t = np.radians(rng.uniform(0, 3, size))[:, None]
        group = np.cos(t) * c + np.sin(t) * e / np.linalg.norm(e, axis=1)[:, None]
        group[:bridges] = c + 0.21 * (other - c) + rng.normal(size=(bridges, dim)) * 0.002
        out.append(group)
    return np.concatenate([*out, rng.normal(size=(200, dim))])


@pytest.mark.parametrize(("seed", "dim", "size", "bridges", "angle"), [(0, 8, 201, 3, 24), (2, 32, 700, 1, 24), (3, 64, 201, 1, 24), (4, 16, 201, 3, 40)])
def test_dense_groups_meet_where_a_few_of_them_link(spark, seed, dim, size, bridges, angle):
    v = two_groups(seed, dim, size, bridges, angle)
    x = v / np.linalg.norm(v, axis=1)[:, None]
    link = x @ x.T >= neighbours.THRESHOLD
    assert bool(link[:size, size : 2 * size].any()) == (angle < 30) and link[:size, size : 2 * size].sum() < size
    component = np.arange(len(v))
    while True:
        new = np.array([component[row].min() for row in link])
        if (new == component).all():
            break
        component = new
    got = neighbours.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))[0].toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == (link.sum(1) - 1).tolist() and got.component_id.tolist() == component.tolist() and got.kept.tolist() == (component == np.arange(len(v))).tolist()


def test_codes_as_tables_are_those_of_their_symbols():
    rng = np.random.default_rng(5)
    for size, used in ((280, 200), (256, 17), (40, 2), (19, 19), (256, 1), (256, 0)):
        counts = np.zeros(size, int)
        counts[rng.permutation(size)[:used]] = rng.geometric(0.01, used)
        lengths = webp.code_lengths(counts, 15 if used > 19 else 7)
        code = webp.Code(lengths)
        if used < 2:
            assert code.only == (int(np.flatnonzero(counts)[0]) if used else 0) and code.length.tolist() == [0]
            continue
        expected = 0  # codes rise, shorter ones first
        for symbol, n, bits in webp.canonical(lengths):
            assert int(f"{bits:0{n}b}"[::-1], 2) << (15 - n) == expected
            expected += 1 << (15 - n)
            assert (code.symbol[bits :: 1 << n] == symbol).all() and (code.length[bits :: 1 << n] == n).all()
        assert code.only is None and len(code.symbol) == 1 << max(lengths)
    for bad in ([1, 1, 1], [2, 1], [15, 15, 1]):
        with pytest.raises(ValueError, match="complete"):
            webp.Code(bad)


def test_repeats_don_t_depend_on_how_samples_are_held():
    data = np.frombuffer(b"the same words again and again, and then some more of them; " * 20, np.uint8)
    assert webp.matches(data) and webp.matches(data) == webp.matches(data.astype(np.int64)) == webp.matches(np.repeat(data, 2)[::2])


def test_a_text_takes_few_python_calls():
    """A short text's time is its calls, as most arrays are small; what it takes is counted, as seconds depend on the machine."""
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(2, 9, 300)]
    texts = [" ".join(words[i] for i in rng.zipf(1.3, 400) % 300).encode() for _ in range(20)]
    webp.decode_payload(webp.encode_payload(webp.payload_of(texts[0])))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        media = [webp.encode_payload(webp.payload_of(t)) for t in texts]
        back = [webp.decode_payload(m)[0] for m in media]
    finally:
        sys.setprofile(None)
    assert back == [webp.payload_of(t) for t in texts]
    assert calls / len(texts) < 1300  # 1563 before
