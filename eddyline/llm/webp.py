"""Lossless WebP columns: texts' bytes stored as images, and a decoder for any lossless WebP.

The decoder reads the whole format: prefix codes (simple and normal), back-references with the near-pixel
distance map, colour cache, several code groups by meta image, and the predictor, cross-colour,
subtract-green and palette transforms. Where one group of codes has bits in green alone, runs of literals are
decoded in numpy: a table look-up at every bit position gives each position's symbol and successor, successors
are composed eight deep, and only every eighth symbol is walked in Python.

The encoder writes grey images, ``WIDTH`` samples a row. Repeats of ``LEAST_MATCH`` bytes and more become
back-references (found in numpy: each position's last earlier place with the same bytes, runs of one distance
together), and a payload of 16 values or fewer a palette of packed indices. The green and distance codes are
derived from what is left, none longer than ``LONGEST`` bits. Each image is measured with and without a
palette, and with a fixed code that spends its bits alike on common bytes, which saves a short
text its code's description; the shortest is written. Payloads beyond an image's greatest height go into further
images, one file after another.

Defined results: a null or empty text is a payload of one row of padding; equal texts give equal bytes;
repeated rows are stored each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import saved, table

WIDTH = 576
MOST_ROWS = 16384
PAD = 255
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distances 1 to 120 mean near pixels (left, above), the nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_CHUNK = 1 << 15
_STEPS = 512  # of eight symbols, walked before their symbols are looked at
_EIGHT = np.arange(8, dtype=np.intp)
_PLACE = np.arange(8 * _CHUNK, dtype=np.intp)


#: Numbers of 15 bits with the bits turned round.
_TURNED = sum(((np.arange(1 << 15) >> k & 1) << (14 - k) for k in range(15)), np.zeros(1 << 15, np.intp))
_TURNED_LIST = _TURNED.tolist()


class Bits:
    """Reads bits from the least significant on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        low = self.at >> 3
        value = int.from_bytes(self.data[low : low + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image's data end early")
        return value


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of the symbols in use."""
    out, code, before = [], 0, 0
    for n, symbol in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - before
        out.append((symbol, n, _TURNED_LIST[code] >> (15 - n)))
        code, before = code + 1, n
    return out


class Code:
    """A prefix code as a table over its longest code's bits."""

    def __init__(self, lengths: list[int]):
        size = np.array(lengths, np.intp)
        used = np.flatnonzero(size)
        if len(used) < 2:
            used, size = used if len(used) else np.zeros(1, np.intp), np.zeros(max(1, len(size)), np.intp)
        elif (1 << 15 - size[used]).sum() != 1 << 15:
            raise ValueError("a prefix code isn't complete")
        used = used[np.argsort(size[used], kind="stable")]
        size = size[used]
        self.bits = int(size[-1])
        # codes rise with the symbols, so each has the next share of the numbers whose bits are turned round
        turned = np.repeat(np.arange(len(used)), 1 << self.bits - size)[_TURNED[: 1 << self.bits] >> (15 - self.bits)]
        self.symbol, self.length = used[turned].astype(np.int32), size[turned]
        self.only = int(used[0]) if self.bits == 0 else None
        self._table: list[tuple[int, int]] = []

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        low = bits.at >> 3
        if self.bits > 8:  # few symbols are read one by one, not worth a list
            place = int.from_bytes(bits.data[low : low + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)
            bits.at += int(self.length[place])
            return int(self.symbol[place])
        if not self._table:
            self._table = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))
        symbol, n = self._table[int.from_bytes(bits.data[low : low + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)]
        bits.at += n
        return symbol


def _small_table(lengths: list[int]) -> list[tuple[int, int]]:
    """What ``Code`` holds, for a few short codes, as a list of (symbol, length)."""
    used = canonical(lengths)
    if len(used) < 2:
        return [(used[0][0] if used else 0, 0)]
    longest = used[-1][1]
    if sum([1 << (longest - n) for _, n, _ in used]) != 1 << longest:
        raise ValueError("a prefix code isn't complete")
    table = [(0, 0)] * (1 << longest)
    for symbol, n, code in used:
        table[code :: 1 << n] = [(symbol, n)] * (1 << (longest - n))
    return table


_codes: dict[tuple[int, ...], Code] = {}


def _code(lengths: list[int]) -> Code:
    """Codes that were met lately are kept, as many files share theirs."""
    key = tuple(lengths)
    if key not in _codes:
        if len(_codes) >= 64:
            _codes.clear()
        _codes[key] = Code(lengths)
    return _codes[key]


_seen: dict[int, list[tuple[int, int, Code]]] = {}


def _read_code(bits: Bits, size: int) -> Code:
    """A code met lately is known by its bits and isn't parsed again."""
    for n, value, code in _seen.get(size, ()):
        low = bits.at >> 3
        if int.from_bytes(bits.data[low : low + (n + 14) // 8], "little") >> (bits.at & 7) & ((1 << n) - 1) == value:
            bits.at += n
            return code
    first = bits.at
    code = _parse_code(bits, size)
    n, low = bits.at - first, first >> 3
    value = int.from_bytes(bits.data[low : low + (n + 14) // 8], "little") >> (first & 7) & ((1 << n) - 1)
    _seen[size] = [(n, value, code), *_seen.get(size, ())][:8]
    return code


def _parse_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, lengths = bits.read(1), [0] * size
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _code(lengths)
    of_lengths, n_own = [0] * 19, 4 + bits.read(4)
    own = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7)
    bits.at += 3 * n_own
    for i in range(n_own):
        of_lengths[LENGTH_ORDER[i]] = own >> 3 * i & 7
    table = _small_table(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, before = [], 8
    data, mask = bits.data, len(table) - 1
    while len(lengths) < size and left > 0:
        left -= 1
        low = bits.at >> 3
        s, n = table[(data[low] | data[low + 1] << 8 if low + 1 < len(data) else int.from_bytes(data[low:], "little")) >> (bits.at & 7) & mask]
        bits.at += n
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("a prefix code has too many lengths")
    return _code(lengths + [0] * (size - len(lengths)))


def _extended(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _successors(bits: Bits, code: Code) -> tuple:
    """Of the chunk that begins at the reader's byte: that byte, where to stop and, for a code at each bit position, its bits and
    where the first, second, fourth and eighth code behind it starts."""
    low = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, min(_CHUNK, len(bits.data) - low), low).astype(np.intp)
    three = raw.copy()
    three[:-1] |= raw[1:] << 8
    three[:-2] |= raw[2:] << 16
    n = 8 * len(raw)
    window = (three[:, None] >> _EIGHT).ravel()
    window &= (1 << code.bits) - 1
    # near the end of the chunk a code may lack bits: stop there unless the data end too
    last = n if low + _CHUNK >= len(bits.data) else n - 16
    after = np.empty(n + 16, np.intp)
    np.add(code.length.take(window), _PLACE[:n], out=after[:n])
    after[last:] = n
    two = after.take(after, mode="clip")
    four = two.take(two, mode="clip")
    return low, last, window, after, two, four, memoryview(four.take(four, mode="clip"))


def _literals(bits: Bits, code: Code, most: int, ready: list[tuple]) -> np.ndarray:
    """Symbols up to the first that isn't a literal, ``most`` of them at most; bits move behind them. ``ready`` keeps the chunk's
    successors from call to call, as long as the data and the code are the same."""
    out = []
    while most > 0:
        if not ready or bits.at - 8 * ready[0][0] >= ready[0][1]:
            ready[:] = [_successors(bits, code)]
        low, last, window, after, two, four, eight = ready[0]
        walk, at = [], bits.at - 8 * low
        for _ in range(_STEPS):
            if at >= last:
                break
            walk.append(at)
            at = eight[at]
        at = np.array(walk, np.intp)
        one = after[at]
        at = np.stack([at, one, two[at], two[one], four[at], four[one], four[two[at]], four[two[one]]], 1).ravel()
        at = at[at < last][:most]
        found = code.symbol[window[at]]
        stop = np.flatnonzero(found >= 256)
        end = int(stop[0]) if len(stop) else len(at)
        out.append(found[:end])
        most -= end
        if len(stop):
            bits.at = 8 * low + int(at[end])
            break
        if not len(at):
            break
        bits.at = 8 * low + int(after[at[-1]] if at[-1] + 16 < last else at[-1] + code.length[window[at[-1]]])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """A stream of entropy-coded ARGB pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = (_pixels(bits, -(-width >> tile), -(-height >> tile), False) >> 8 & 0xFFFF).astype(np.int64)
        across = -(-width >> tile)
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(1 + (int(meta.max()) if meta is not None else 0))]
    n = width * height
    out = np.zeros(n, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    green, red, blue, alpha, distance = groups[0]
    fixed = None if cache_bits or meta is not None or green.only is not None or None in (red.only, blue.only, alpha.only) else alpha.only << 24 | red.only << 16 | blue.only

    ready: list[tuple] = []

    def remember(a: int, b: int) -> None:
        for v in out[a:b].tolist() if cache_bits else ():
            cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    i = 0
    while i < n:
        if fixed is not None:
            run = _literals(bits, green, n - i, ready)
            out[i : i + len(run)] = run.astype(np.uint32) << np.uint32(8) | np.uint32(fixed)
            i += len(run)
            if i >= n:
                break
        if meta is not None:
            green, red, blue, alpha, distance = groups[meta[(i // width >> tile) * across + (i % width >> tile)]]
        g = green.read(bits)
        if g < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[i] = a << 24 | r << 16 | g << 8 | b
            remember(i, i + 1)
            i += 1
        elif g < 280:
            length = _extended(bits, g - 256)
            d = _extended(bits, distance.read(bits))
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            out[i : i + length] = out[i - d : i] if length == d else np.resize(out[i - d : i], length)
            remember(i, i + length)
            i += length
        else:
            out[i] = cache[g - 280]
            remember(i, i + 1)
            i += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image's data end early")
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Rows of alpha, red, green and blue."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, top_right, top_left):
    """What a predictor mode expects, from (alpha, red, green, blue) of the neighbours."""
    mean = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        p = [x + y - z for x, y, z in zip(left, top, top_left, strict=True)]
        to_left, to_top = (sum(abs(a - b) for a, b in zip(p, o, strict=True)) for o in (left, top))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(x + y - z) for x, y, z in zip(left, top, top_left, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - z) / 2)) for m, z in zip(mean(left, top), top_left, strict=True))
    kinds = {1: left, 2: top, 3: top_right, 4: top_left}
    if mode in kinds:
        return kinds[mode]
    pairs = {5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top), 8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right))}
    return pairs[mode]() if mode in pairs else (255, 0, 0, 0)


def _undo_predictor(pixels: np.ndarray, width: int, height: int, tile: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(pixels).reshape(height, width, 4)
    across = -(-width >> tile)
    mode = (modes >> 8 & 15).reshape(-1, across)
    c[0, 0] += (255, 0, 0, 0)
    c[0] = np.cumsum(c[0], 0) & 255
    for y in range(1, height):
        row = np.repeat(mode[y >> tile], 1 << tile)[:width].tolist()
        kinds = set(row[1:])
        above = c[y - 1]
        c[y, 0] = (c[y, 0] + above[0]) & 255
        if kinds <= {0, 2, 3, 4, 8, 9} and not ({3, 9} & {row[-1]}):  # nothing from the left
            m = np.array(row[1:])[:, None]
            t, tl, tr = above[1:], above[:-1], np.concatenate([above[2:], above[-1:]])
            c[y, 1:] = (c[y, 1:] + np.select([m == 0, m == 2, m == 3, m == 4, m == 8], [np.array([255, 0, 0, 0]), t, tr, tl, (tl + t) >> 1], (t + tr) >> 1)) & 255
            continue
        now, before = list(map(tuple, c[y].tolist())), list(map(tuple, above.tolist()))
        for x in range(1, width):
            p = predicted(row[x], now[x - 1], before[x], before[x + 1] if x + 1 < width else now[0], before[x - 1])
            now[x] = tuple((v + w) & 255 for v, w in zip(now[x], p, strict=True))
        c[y] = now
    return _packed(c).ravel()


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, tile: int, elements: np.ndarray) -> np.ndarray:
    c = _channels(pixels).reshape(height, width, 4)
    e = _channels(elements).reshape(-1, -(-width >> tile), 4)
    e = np.repeat(np.repeat(e, 1 << tile, 0), 1 << tile, 1)[:height, :width]
    signed = lambda v: ((v & 255) ^ 128) - 128
    green = signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (signed(e[..., 3]) * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (signed(e[..., 2]) * green >> 5) + (signed(e[..., 1]) * signed(c[..., 1]) >> 5)) & 255
    return _packed(c).ravel()


def _undo_palette(pixels: np.ndarray, width: int, height: int, packing: int, palette: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    per, depth = 1 << packing, 8 >> packing
    if packing:
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(depth)) & np.uint32((1 << depth) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].ravel()


def decode_stream(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels row by row) of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version of the format")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            part = _pixels(bits, -(-across >> tile), -(-height >> tile), False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, across, tile, part))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = _packed(np.cumsum(_channels(_pixels(bits, n, 1, False)), 0))
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_undo_palette, across, packing, palette))
            across = -(-across >> packing)
        else:
            undo.append((None, across, 0, None))
    pixels = _pixels(bits, across, height, True)
    for how, w, number, part in reversed(undo):
        if how is None:
            green = pixels >> np.uint32(8) & np.uint32(255)
            pixels = pixels & np.uint32(0xFF00FF00) | (pixels + (green << np.uint32(16)) & np.uint32(0xFF0000)) | ((pixels & np.uint32(255)) + green & np.uint32(255))
        else:
            pixels = how(pixels, w, height, number, part)
    return width, height, pixels


def decode_file(data: bytes, at: int = 0) -> tuple[int, int, np.ndarray, int]:
    """(width, height, ARGB pixels, where the file ends) of a WebP file with a lossless image."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[at + 16 : at + 20], "little")
    return *decode_stream(data[at + 20 : at + 20 + size]), at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")


#: Bytes that a repeat must have to be a back-reference, and how many of them are hashed to find one.
LEAST_MATCH, HASHED = 48, 8
LONGEST = 10


def code_lengths(counts: np.ndarray, most: int = LONGEST) -> list[int]:
    """Lengths of a prefix code for symbols that occur so often, 0 for those that don't; a rare symbol counts as if it
    weren't so rare until no length is above ``most``."""
    used = np.flatnonzero(counts)
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves, least, n = counts[used].tolist(), 1, len(used)
    while True:
        # the two lightest of sorted leaves and of the sums so far, which come out sorted, again and again
        weight = [max(least, x) for x in leaves]
        parent, leaf, node = [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, node = node, node + 1
                parent[child] = new
                total += weight[child]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if depth[0] <= most:
            for s, d in zip(used.tolist(), depth[:n], strict=True):
                lengths[s] = d
            return lengths
        least = max(2 * least, sum(leaves) >> (most + 3))


def _described(lengths: list[int]) -> list[tuple[int, int]]:
    """(value, bits) of a code's description."""
    return _description(tuple(lengths))


@lru_cache(1024)
def _description(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        first, second = [*used, 0, 0][:2] if used else (0, 0)
        short = first < 2
        return [(1, 1), (int(len(used) == 2), 1), (int(not short), 1), (first, 1 if short else 8), *([(second, 8)] if len(used) == 2 else [])]
    tokens: list[tuple[int, int, int]] = []  # symbol of the code of lengths, extra, its bits
    before, last = 8, max(used) + 1
    for n, same in groupby(lengths[:last]):
        run = len(list(same))
        if n and n != before:
            tokens.append((n, 0, 0))
            before, run = n, run - 1
        while run >= 3:
            k = min(run, 6 if n else 138)
            tokens.append((16, k - 3, 2) if n else (17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            run -= k
        tokens += [(n, 0, 0)] * run
    own = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    codes = {s: (c, n) for s, n, c in canonical(own)} if sum(map(bool, own)) > 1 else {s: (0, 0) for s in range(19)}
    n_own = max(4, max(k + 1 for k, s in enumerate(LENGTH_ORDER) if own[s]))
    bits = [(0, 1), (n_own - 4, 4), *((own[s], 3) for s in LENGTH_ORDER[:n_own])]
    if last < len(lengths):
        size = max(1, (len(tokens) - 2).bit_length() + 1 >> 1) if len(tokens) > 2 else 1
        bits += [(1, 1), (size - 1, 3), (len(tokens) - 2, 2 * size)] if len(tokens) >= 2 else [(0, 1)]
        if len(tokens) < 2:
            tokens += [(0, 0, 0)] * (len(lengths) - last)
    else:
        bits.append((0, 1))
    for symbol, extra, n in tokens:
        bits += [codes.get(symbol, (0, 0)), *([(extra, n)] if n else [])]
    return bits


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, their number) of lengths or distances from 1 up."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << n) - 1), n


def matches(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeats, rising and apart from one another."""
    n = len(samples) - HASHED + 1
    if n <= LEAST_MATCH:
        return []
    code = np.ndarray(n, f"<u{HASHED}", np.ascontiguousarray(samples, np.uint8), strides=(1,)).astype(np.uint64)
    order = np.argsort((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    in_order = code[order]
    same = np.flatnonzero(in_order[1:] == in_order[:-1])
    if not len(same):
        return []
    back, later = np.zeros(n, np.int64), order[same + 1]
    back[later] = later - order[same]
    edge = np.append(0, np.flatnonzero(back[1:] != back[:-1]) + 1)
    size = np.append(edge[1:], n) - edge + HASHED - 1
    out, at = [], 0
    good = (back[edge] > 0) & (size >= LEAST_MATCH)
    for place, length, distance in zip(edge[good].tolist(), size[good].tolist(), back[edge][good].tolist(), strict=True):
        begin = max(place, at)
        while place + length - begin >= LEAST_MATCH:
            part = min(place + length - begin, 4096)
            out.append((begin, part, distance))
            begin += part
        at = max(at, begin)
    return out


def _size(bits: list[tuple[int, int]]) -> int:
    return sum([n for _, n in bits])


def _table(lengths: list[int]) -> np.ndarray:
    """(code, its bits) by symbol."""
    out = np.zeros((len(lengths), 2), np.int64)
    used = canonical(lengths)
    if len(used) > 1:
        used = np.array(used)
        out[used[:, 0]] = used[:, [2, 1]]
    return out


class _Tokens:
    """Literals and back-references of an image, in order, and what each code for them costs."""

    def __init__(self, samples: np.ndarray, found: list[tuple[int, int, int]]):
        self.green = samples.astype(np.int64)
        self.at, self.more = np.zeros(0, np.int64), np.zeros((0, 3, 2), np.int64)
        far_counts = np.zeros(40, np.int64)
        if found:
            place, length, distance = (np.array(x, np.int64) for x in zip(*found, strict=True))
            k, (symbol, extra, extra_n) = len(found), _prefixed(np.concatenate([length, distance + 120]))
            symbol, far = symbol[:k], symbol[k:]
            literal = np.ones(len(samples), bool)
            for begin, n, _ in found:
                literal[begin : begin + n] = False
            self.green[place] = 256 + symbol
            literal[place] = True
            self.at = np.cumsum(literal)[place] - 1
            self.green = self.green[literal]
            far_counts = np.bincount(far, minlength=40)
            # behind a length: its extra bits, the distance's symbol (whose code comes later) and its extra bits
            self.more = np.zeros((k, 3, 2), np.int64)
            self.more[:, 0, 0], self.more[:, 0, 1] = extra[:k], extra_n[:k]
            self.more[:, 1, 0] = far
            self.more[:, 2, 0], self.more[:, 2, 1] = extra[k:], extra_n[k:]
        self.counts = np.bincount(self.green, minlength=280)
        self.far = code_lengths(far_counts)
        self.rest = [*_PLAIN_HEADS, *_described(self.far)]
        far_bits = int((far_counts * self.far).sum()) if sum(map(bool, self.far)) > 1 else 0
        self.fixed_bits = _size(self.rest) + far_bits + int(self.more[:, :, 1].sum())

    def priced(self, lengths: list[int], head: list[tuple[int, int]]) -> int:
        """Bits that the image takes with a green code of these lengths, described by ``head``."""
        return self.fixed_bits + _size(head) + (int(self.counts @ np.array(lengths)) if len(lengths) - lengths.count(0) > 1 else 0)

    def written(self, lengths: list[int], head: list[tuple[int, int]]) -> np.ndarray:
        pairs = _table(lengths).take(self.green, 0)
        if len(self.at):
            more = self.more.copy()
            more[:, 1] = _table(self.far)[more[:, 1, 0]]
            literal, place = np.ones(len(pairs) + 3 * len(self.at), bool), (self.at + 1 + 3 * np.arange(len(self.at)))[:, None] + np.arange(3)
            literal[place] = False
            whole = np.empty((len(literal), 2), np.int64)
            whole[literal], whole[place] = pairs, more
            pairs = whole
        return np.concatenate([np.array([*head, *self.rest], np.int64), pairs])


def _packed_bits(pairs: np.ndarray) -> bytes:
    """Values of so many bits (32 at most) one after another, in 32-bit words: bits don't overlap, so sums put them together."""
    value, size = pairs[:, 0].astype(np.uint64), pairs[:, 1]
    end = np.cumsum(size)
    at = end - size
    word, moved = at >> 5, value << (at & 31).astype(np.uint64)
    total = int(end[-1])
    n = (total >> 5) + 2
    words = np.bincount(word, (moved & np.uint64(0xFFFFFFFF)).astype(float), n) + np.bincount(word + 1, (moved >> np.uint64(32)).astype(float), n)
    return words.astype("<u4").tobytes()[: (total + 7) >> 3]


#: Descriptions of the red, blue and alpha codes of a grey image: 0, 0 and 255.
_PLAIN_HEADS = [*_described([0] * 256), *_described([0] * 256), *_described([*[0] * 255, 1])]
#: Fixed code of short texts: bytes that text in Latin letters uses most are short, and every symbol has a code.
_PLAIN = code_lengths(np.array([*(64 if chr(b) in " etaoinshrdlu" else 16 if chr(b).islower() and b < 128 else 4 if 32 <= b < 127 or b in (10, 255) or 0x80 <= b < 0xC4 else 1 for b in range(256)), *[4] * 24]))
_PLAIN_CODE = (_PLAIN, _described(_PLAIN))


def _packed_samples(samples: np.ndarray, height: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(indices, packed, row by row; bits of the palette's transform) of an image of 16 values or fewer."""
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    packing = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    index = np.zeros(256, np.int64)
    index[values] = np.arange(len(values))
    per, depth = 1 << packing, 8 >> packing
    rows = index[samples].reshape(height, -1, per)
    packed = (rows << np.arange(per) * depth).sum(2).ravel()
    steps = np.diff(values, prepend=0) & 255
    # the palette's colours, each the difference from the last: grey of opaque alpha, then steps with none
    channel = code_lengths(np.bincount(steps, minlength=280)), code_lengths(np.bincount(steps, minlength=256)), code_lengths(np.bincount([255, *[0] * (len(values) - 1)], minlength=256))
    bits = [(1, 1), (PALETTE, 2), (len(values) - 1, 8), (0, 1)]
    for lengths in (channel[0], channel[1], channel[1], channel[2], [0] * 40):
        bits += _described(lengths)
    codes = [{s: (c, n) for s, n, c in canonical(x)} if sum(map(bool, x)) > 1 else {} for x in channel]
    for k, step in enumerate(steps.tolist()):
        bits += [codes[0].get(step, (0, 0)), codes[1].get(step, (0, 0)), codes[1].get(step, (0, 0)), codes[2].get(255 if k == 0 else 0, (0, 0))]
    return packed, bits


def encoded_stream(samples: np.ndarray, height: int) -> bytes:
    """The shortest of the ways to write an image of grey ``samples``."""
    grey = [(1, 1), (SUBTRACT_GREEN, 2), (0, 1)]
    tokens = _Tokens(samples, matches(samples))
    own = code_lengths(tokens.counts)
    ways = [(grey, tokens, own, _described(own)), (grey, tokens, *_PLAIN_CODE)]
    if np.count_nonzero(tokens.counts[:256]) <= 16:
        packed, head = _packed_samples(samples, height)
        small = _Tokens(packed, matches(packed))
        own = code_lengths(small.counts)
        ways.append(([*head, (0, 1)], small, own, _described(own)))
    head, tokens, lengths, described = min(ways, key=lambda w: _size(w[0]) + w[1].priced(w[2], w[3]))
    first = np.array([(0x2F, 8), (WIDTH - 1, 14), (height - 1, 14), (0, 4), *head, (0, 1), (0, 1)], np.int64)
    return _packed_bits(np.concatenate([first, tokens.written(lengths, described)]))


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def encode_payload(payload: bytes) -> bytes:
    """One or more WebP files, one after another; the payload's length is a multiple of ``WIDTH``."""
    out, samples = [], np.frombuffer(payload, np.uint8)
    for at in range(0, len(samples), WIDTH * MOST_ROWS):
        part = samples[at : at + WIDTH * MOST_ROWS]
        data = encoded_stream(part, len(part) // WIDTH)
        body = b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        out.append(b"RIFF" + len(body).to_bytes(4, "little") + body)
    return b"".join(out)


def decode_payload(media: bytes) -> tuple[bytes, int, int]:
    """(grey samples, width, rows) of the files that ``encode_payload`` wrote."""
    at, rows, width, parts = 0, 0, 0, []
    while at < len(media):
        width, height, pixels, at = decode_file(media, at)
        samples = (pixels & np.uint32(255)).astype(np.uint8)
        if (pixels != np.uint32(0xFF000000) + samples * np.uint32(0x010101)).any():
            raise ValueError("the image isn't grey")
        parts.append(samples.tobytes())
        rows += height
    return b"".join(parts), width, rows


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch["text"]]
                media = [encode_payload(payload_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """doc_id, width, height and samples (binary, row by row) of stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                found = [decode_payload(m.as_py()) for m in batch["media"]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([w for _, w, _ in found], pa.int64()), pa.array([h for _, _, h in found], pa.int64()), pa.array([s for s, _, _ in found], pa.binary())], ["doc_id", "width", "height", "samples"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, width long, height long, samples binary")


def digests(media: DataFrame) -> DataFrame:
    """What the stored images hold, decoded: lengths, digests and a feature, a row for each row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, stored in zip(*(batch[c] for c in ("doc_id", "n_bytes", "media")), strict=True):
                data = stored.as_py()
                samples, width, height = decode_payload(data)
                grey = np.frombuffer(samples, np.uint8)
                bins = np.bincount(grey >> 5, minlength=8)
                feature = f"{width}x{height};mean={int(grey.sum(dtype=np.int64)) * 1000 // len(grey)}/1000;bins={','.join(map(str, bins.tolist()))}"
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(saved(store(table(spark, sf_dir, "documents")), "webp"))
