"""Hashed n-gram and word features of text, vectorised over the bytes of many texts at once.

Texts come as Arrow string columns; their UTF-8 bytes are read in blocks of about ``BLOCK`` bytes, so
memory is bounded whatever a text's length. A text longer than a block is cut at white space (or, where
a block holds none, at the block's end), which no feature spans anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_PRIME = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Letters, digits and all bytes of characters beyond ASCII.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; a null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes
        valid = np.asarray(column.is_valid())
        return body, np.stack([at[:-1], np.where(valid, at[1:], at[:-1])])
    return body, np.stack([at[:-1], at[1:]])


def blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased bytes with a space before, between and after pieces, and of each piece its row, its start
    there and its start in its text)."""
    body, (begin, end) = utf8(column)
    rows: list[int] = []
    origins: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    gap = np.array([32], np.uint8)

    def made():
        starts = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
        buf = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        return _LOWER[buf], np.array(rows), starts, np.array(origins)

    for row, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        first = a
        while a < b:
            stop = b
            if b - a > block:
                spaces = np.flatnonzero(SPACE[body[a : a + block]])
                stop = a + (int(spaces[-1]) + 1 if len(spaces) else block)
            rows.append(row)
            origins.append(a - first)
            parts.append(body[a:stop])
            size += stop - a
            a = stop
            if size >= block:
                yield made()
                rows, origins, parts, size = [], [], [], 0
    if parts:
        yield made()


def _mixed(code: np.ndarray, bits: int) -> np.ndarray:
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(13)
    code *= np.uint32(0x297A2D39)
    return code >> np.uint32(32 - bits)


def gram_ids(buf: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes (1 to 4) from each position but the last n-1, and whether they count: only
    the first and last may be white space, as a word's edge, and not all of them."""
    size = len(buf) - n + 1
    code = buf[:size].astype(np.uint32)
    for i in range(1, n):
        code |= buf[i : i + size].astype(np.uint32) << np.uint32(8 * i)
    space = SPACE[buf]
    ok = ~(space[:size] & space[n - 1 :]) if n < 3 else np.ones(size, bool)
    if n == 1:
        ok = ~space[:size]
    for i in range(1, n - 1):
        ok &= ~space[i : i + size]
    code += np.uint32(n * 0x01000193 & 0xFFFFFFFF) if n < 4 else np.uint32(0)
    return _mixed(code, bits), ok


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (size - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(_PRIME, -1, 1 << 64))
        up = np.full(size, _PRIME, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def word_hashes(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each longest run of bytes for which ``inside`` (a table of 256) holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[buf], [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    code = (total[end] - total[start]) * down[start]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    return code, start


def prefix_hashes(buf: np.ndarray, inside: np.ndarray, lengths: range) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of the first n bytes of each such run, for each n of ``lengths`` that it reaches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[buf], [False]]).view(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    codes, at = [], []
    for n in lengths:
        begin = start[size >= n]
        code = np.full(len(begin), n, np.uint64)
        for i in range(n):
            code = (code + buf[begin + i]) * np.uint64(_PRIME)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xD6E8FEB86659FD93)
        codes.append(code ^ (code >> np.uint64(32)))
        at.append(begin)
    return np.concatenate(codes), np.concatenate(at)


def piece_sums(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` (one for each position, perhaps fewer than ``size``) within each piece."""
    if len(values) < size:
        values = np.concatenate([values, np.zeros(size - len(values), values.dtype)])
    return np.add.reduceat(values, starts, dtype=np.float64)
