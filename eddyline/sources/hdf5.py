"""Reads what tasks need of an HDF5 file: attributes, and boxes of datasets by positional reads.

Versions 0 to 3 of the superblock, both kinds of object headers, symbol-table and compact groups, compact, contiguous and chunked
datasets (by B-tree, or of a single chunk), the deflate, shuffle and Fletcher filters; numbers and fixed or global-heap
strings. What else there is (dense groups and attributes, other chunk indices, other filters) is an error that names it.
Nothing is read but the metadata on the way and the bytes of the box that is asked for.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np

from eddyline.sources.vtk import _opened

NOWHERE = 0xFFFFFFFFFFFFFFFF
PAGE = 1 << 14


class Hdf5Error(ValueError):
    pass


class _Pages:
    """Positional reads of a source, small ones from pages that are kept."""

    def __init__(self, source):
        self.source, self.pages, self.bytes_read = source, {}, 0

    def raw(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.source.read_at(n, at)

    def __call__(self, at: int, n: int) -> bytes:
        if n > PAGE:
            return self.raw(at, n)
        out = b""
        for page in range(at // PAGE, (at + n - 1) // PAGE + 1):
            if page not in self.pages:
                self.pages[page] = self.raw(page * PAGE, PAGE)
            out += self.pages[page]
        begin = at % PAGE
        return out[begin : begin + n]


def _int(raw: bytes, at: int, n: int) -> int:
    return int.from_bytes(raw[at : at + n], "little")


@dataclass(frozen=True)
class _Kind:
    """A datatype: numpy's for numbers and fixed strings, ``heap`` for strings in the global heap."""

    dtype: np.dtype
    heap: bool = False


def _kind(raw: bytes) -> _Kind:
    number, bits, size = raw[0] & 15, _int(raw, 1, 3), _int(raw, 4, 4)
    order = ">" if bits & 1 else "<"
    if number == 0:
        return _Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
    if number == 1:
        return _Kind(np.dtype(f"{order}f{size}"))
    if number == 3:
        return _Kind(np.dtype(f"S{size}"))
    if number == 9 and bits & 15 == 1:
        return _Kind(np.dtype(f"V{size}"), True)
    raise Hdf5Error(f"datatype of class {number} isn't read")


def _shape(raw: bytes) -> tuple[int, ...]:
    version, rank = raw[0], raw[1]
    at = 8 if version == 1 else 4
    return tuple(_int(raw, at + 8 * i, 8) for i in range(rank))


def _padded(n: int) -> int:
    return (n + 7) // 8 * 8


@dataclass
class Node:
    """A group or dataset: its messages by type."""

    file: File
    messages: list[tuple[int, bytes]]
    _children: dict[str, int] | None = field(default=None, repr=False)

    def _first(self, kind: int) -> bytes | None:
        return next((raw for k, raw in self.messages if k == kind), None)

    @property
    def attrs(self) -> dict[str, np.ndarray | bytes]:
        out = {}
        for kind, raw in self.messages:
            if kind != 0x0C:
                continue
            version = raw[0]
            sizes = [_int(raw, 2 + 2 * i, 2) for i in range(3)]
            at, step = (9 if version == 3 else 8), (_padded if version == 1 else int)
            parts = []
            for size in sizes:
                parts.append(raw[at : at + size])
                at += step(size)
            name, kind_of, shape = parts[0].split(b"\0")[0].decode(), _kind(parts[1]), _shape(parts[2])
            value = self.file.decoded(raw[at : at + math.prod(shape) * kind_of.dtype.itemsize], kind_of, shape)
            out[name] = value if shape else value[()]
        info = self._first(0x15)
        if info is not None and _int(info, 2 + 2 * (info[1] & 1), 8) != NOWHERE:
            raise Hdf5Error("attributes in dense storage aren't read")
        return out

    @property
    def children(self) -> dict[str, int]:
        """Names and header addresses of a group's members."""
        if self._children is None:
            self._children = {}
            table, info = self._first(0x11), self._first(0x02)
            if table is not None:
                heap = self.file.at(_int(table, 8, 8), 32)
                names = self.file.at(_int(heap, 24, 8), _int(heap, 8, 8))
                self._collect(_int(table, 0, 8), names)
            elif info is not None and _int(info, 2 + 8 * (info[1] & 1), 8) != NOWHERE:
                raise Hdf5Error("groups in dense storage aren't read")
            for kind, raw in self.messages:
                if kind == 0x06:
                    flags, at = raw[1], 2
                    soft = flags & 8 and raw[at]
                    at += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
                    width = 1 << (flags & 3)
                    size = _int(raw, at, width)
                    if not soft:
                        self._children[raw[at + width : at + width + size].decode()] = _int(raw, at + width + size, 8)
        return self._children

    def _collect(self, address: int, names: bytes) -> None:
        head = self.file.at(address, 24)
        n = _int(head, 6, 2)
        if head[:4] == b"TREE":
            body = self.file.at(address + 24, 16 * n + 8)
            for i in range(n):
                self._collect(_int(body, 8 + 16 * i, 8), names)
        elif head[:4] == b"SNOD":
            body = self.file.at(address + 8, 40 * n)
            for i in range(n):
                at = _int(body, 40 * i, 8)
                self._children[names[at : names.index(b"\0", at)].decode()] = _int(body, 40 * i + 8, 8)
        else:
            raise Hdf5Error(f"neither a tree nor a symbol node at {address}")

    @property
    def is_dataset(self) -> bool:
        return self._first(0x08) is not None

    @property
    def shape(self) -> tuple[int, ...]:
        return _shape(self._first(0x01))

    def read(self, *box: tuple[int, int] | int) -> np.ndarray:
        """The values of a box: for each leading axis an index or (first, behind last); further axes whole."""
        shape, kind = self.shape, _kind(self._first(0x03))
        spans = [(b, b + 1) if isinstance(b, int) else b for b in box] + [(0, n) for n in shape[len(box) :]]
        if any(not 0 <= a <= b <= n for (a, b), n in zip(spans, shape, strict=True)):
            raise Hdf5Error(f"box {box} isn't in {shape}")
        values = self._box(spans, shape, kind)
        return values.reshape([b - a for i, (a, b) in enumerate(spans) if not (i < len(box) and isinstance(box[i], int))])

    def _box(self, spans, shape, kind: _Kind) -> np.ndarray:
        raw, size = self._first(0x08), kind.dtype.itemsize
        version = raw[0]
        if version in (1, 2):
            rank, layout = raw[1], raw[2]
            at = 8 + 8 * (layout != 0)
            address, dims = _int(raw, 8, 8), [_int(raw, at + 4 * i, 4) for i in range(rank)]
            at += 4 * rank
            compact = raw[at + 4 : at + 4 + _int(raw, at, 4)] if layout == 0 else b""
        elif version == 3:
            layout = raw[1]
            compact = raw[4 : 4 + _int(raw, 2, 2)] if layout == 0 else b""
            address = _int(raw, 3, 8) if layout == 2 else _int(raw, 2, 8)
            dims = [_int(raw, 11 + 4 * i, 4) for i in range(raw[2])] if layout == 2 else []
        elif version == 4 and raw[1] < 2:
            layout, address, dims, compact = raw[1], _int(raw, 2, 8), [], raw[4 : 4 + _int(raw, 2, 2)]
        elif version == 4 and raw[1] == 2:
            flags, rank, width = raw[2], raw[3], raw[4]
            dims, at = [_int(raw, 5 + width * i, width) for i in range(rank)], 5 + width * rank
            if raw[at] != 1:
                raise Hdf5Error(f"chunk index of kind {raw[at]} isn't read")
            filtered = _int(raw, at + 1, 8) if flags & 2 else math.prod(dims)
            address = _int(raw, at + 1 + 12 * (flags >> 1 & 1), 8)
            out = np.zeros([b - a for a, b in spans], kind.dtype)
            self._paste(out, spans, [0] * (rank - 1), dims[:-1], address, filtered, 0, kind)
            return out
        else:
            raise Hdf5Error(f"layout of version {version} isn't read")
        if layout == 0:
            whole = self.file.decoded(compact[: math.prod(shape) * size], kind, shape)
            return whole[tuple(slice(a, b) for a, b in spans)]
        out_shape = [b - a for a, b in spans]
        if address == NOWHERE or not math.prod(out_shape):  # nothing was ever written there
            return np.zeros(out_shape, kind.dtype if not kind.heap else object)
        if layout == 1:
            return self._contiguous(spans, shape, kind, address)
        out = np.zeros(out_shape, kind.dtype)
        self._chunks(address, out, spans, dims[:-1], kind)
        return out

    def _contiguous(self, spans, shape, kind: _Kind, address: int) -> np.ndarray:
        """Runs of a box that lie together are one read each."""
        size = kind.dtype.itemsize
        tail = len(shape)
        while tail and spans[tail - 1] == (0, shape[tail - 1]):
            tail -= 1
        whole = math.prod(shape[tail:])  # axes that are read whole
        if not tail:
            return self.file.decoded(self.file.raw(address, whole * size), kind, shape)
        a, b = spans[tail - 1]
        parts = []
        for lead in np.ndindex(*(y - x for x, y in spans[: tail - 1])):
            at = 0
            for (x, _), i, n in zip(spans[: tail - 1], lead, shape[: tail - 1], strict=True):
                at = at * n + x + i
            first = (at * shape[tail - 1] + a) * whole
            parts.append(self.file.raw(address + first * size, (b - a) * whole * size))
        return self.file.decoded(b"".join(parts), kind, tuple(y - x for x, y in spans))

    def _chunks(self, address: int, out: np.ndarray, spans, dims, kind: _Kind) -> None:
        rank = len(dims)
        head = self.file.at(address, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise Hdf5Error(f"no tree of chunks at {address}")
        n, width = _int(head, 6, 2), 8 + 8 * (rank + 1)
        body = self.file.at(address + 24, n * (width + 8) + width)
        key = lambda i: [_int(body, i * (width + 8) + 8 + 8 * a, 8) for a in range(rank)]
        low, high = [a // c * c for (a, _), c in zip(spans, dims, strict=True)], [b - 1 for _, b in spans]
        for i in range(n):
            first = key(i)
            if first > high or (head[5] and i + 1 <= n and key(i + 1) < low):  # keys rise in the order of offsets
                continue
            child = _int(body, i * (width + 8) + width, 8)
            if head[5]:
                self._chunks(child, out, spans, dims, kind)
            elif all(f < b and f + c > a for f, c, (a, b) in zip(first, dims, spans, strict=True)):
                self._paste(out, spans, first, dims, child, _int(body, i * (width + 8), 4), _int(body, i * (width + 8) + 4, 4), kind)

    def _paste(self, out, spans, first, dims, address: int, size: int, skipped: int, kind: _Kind) -> None:
        chunk = self._unfiltered(self.file.raw(address, size), skipped, kind.dtype.itemsize)
        values = np.frombuffer(chunk, kind.dtype, math.prod(dims)).reshape(dims)
        here = tuple(slice(max(a - f, 0), min(b - f, c)) for f, c, (a, b) in zip(first, dims, spans, strict=True))
        there = tuple(slice(max(f - a, 0), max(f - a, 0) + s.stop - s.start) for f, s, (a, _) in zip(first, here, spans, strict=True))
        out[there] = values[here]

    def _unfiltered(self, raw: bytes, skipped: int, size: int) -> bytes:
        pipeline = self._first(0x0B)
        if pipeline is None:
            return raw
        version, at = pipeline[0], 8 if pipeline[0] == 1 else 2
        filters = []
        for _ in range(pipeline[1]):
            number = _int(pipeline, at, 2)
            named = version == 1 or number >= 256
            name = _int(pipeline, at + 2, 2) if named else 0
            n = _int(pipeline, at + 6 if named else at + 4, 2)
            at += (8 if named else 6) + (_padded(name) if version == 1 else name)
            filters.append(number)
            at += 4 * n + (4 * (n % 2) if version == 1 else 0)
        for i, number in reversed(list(enumerate(filters))):
            if skipped >> i & 1:
                continue
            if number == 1:
                raw = zlib.decompress(raw)
            elif number == 2:
                raw = np.frombuffer(raw[: len(raw) // size * size], np.uint8).reshape(size, -1).T.tobytes() + raw[len(raw) // size * size :]
            elif number == 3:
                raw = raw[:-4]
            else:
                raise Hdf5Error(f"filter {number} isn't read")
        return raw


class File:
    """An open file; ``file["a/b"]`` is a node."""

    def __init__(self, path: str):
        self.path, self._source = path, _opened(path)
        self.pages = _Pages(self._source)
        self._nodes: dict[int, Node] = {}
        at = 0
        while self.pages(at, 8) != b"\x89HDF\r\n\x1a\n":
            at = max(512, 2 * at)
            if at >= self._source.size():
                raise Hdf5Error(f"{path}: not an HDF5 file")
        head = self.pages(at, 128)
        version = head[8]
        widths = head[13:15] if version < 2 else head[9:11]
        if version > 3 or tuple(widths) != (8, 8):
            raise Hdf5Error(f"{path}: superblock {version} with offsets of {widths[0]} bytes isn't read")
        if version < 2:
            start = 24 + 4 * version
            self.base, root = _int(head, start, 8), _int(head, start + 40, 8)
        else:
            self.base, root = _int(head, 12, 8), _int(head, 36, 8)
        self.root = self.node(root)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self._source.close()

    def at(self, address: int, n: int) -> bytes:
        return self.pages(self.base + address, n)

    def raw(self, address: int, n: int) -> bytes:
        return self.pages.raw(self.base + address, n)

    def node(self, address: int) -> Node:
        if address not in self._nodes:
            self._nodes[address] = Node(self, self._messages(address))
        return self._nodes[address]

    def __getitem__(self, path: str) -> Node:
        node = self.root
        for name in path.strip("/").split("/"):
            if name not in node.children:
                raise KeyError(f"{self.path}: no {path}")
            node = self.node(node.children[name])
        return node

    def __contains__(self, path: str) -> bool:
        try:
            self[path]
        except KeyError:
            return False
        return True

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        head = self.at(address, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            width = 1 << (flags & 3)
            size = _int(self.at(address + at, width), 0, width)
            blocks, lead = [(address + at + width, size)], 4 + 2 * (flags >> 2 & 1)
        elif head[0] == 1:
            blocks, lead = [(address + 16, _int(head, 8, 4))], 8
        else:
            raise Hdf5Error(f"{self.path}: no object header at {address}")
        while blocks:
            begin, size = blocks.pop(0)
            raw, at = self.at(begin, size), 0
            if raw[:4] == b"OCHK":
                raw, at = raw[:-4], 4
            while at + lead <= len(raw):
                kind, n = (_int(raw, at, 2), _int(raw, at + 2, 2)) if lead == 8 else (raw[at], _int(raw, at + 1, 2))
                body = raw[at + lead : at + lead + n]
                if kind == 0x10:
                    blocks.append((_int(body, 0, 8), _int(body, 8, 8)))
                elif kind:
                    out.append((kind, body))
                at += lead + n
        return out

    def decoded(self, raw: bytes, kind: _Kind, shape: tuple[int, ...]) -> np.ndarray:
        if not kind.heap:
            return np.frombuffer(raw, kind.dtype, math.prod(shape)).reshape(shape)
        texts = []
        for at in range(0, len(raw), kind.dtype.itemsize):
            texts.append(self._heap(_int(raw, at + 4, 8), _int(raw, at + 12, 4))[: _int(raw, at, 4)])
        out = np.empty(len(texts), object)
        out[:] = texts
        return out.reshape(shape)

    def _heap(self, address: int, index: int) -> bytes:
        size = _int(self.at(address, 16), 8, 8)
        raw, at = self.at(address, size), 16
        while at + 16 <= size:
            number, n = _int(raw, at, 2), _int(raw, at + 8, 8)
            if number == index:
                return raw[at + 16 : at + 16 + n]
            if not number:
                break
            at += 16 + _padded(n)
        raise Hdf5Error(f"{self.path}: object {index} isn't in the heap at {address}")
