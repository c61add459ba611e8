"""Writes HDF5 files for tests by the published format, in its older style (symbol tables, version 1 headers) or, with ``new``, with
version 2 headers and compact links. Groups are dictionaries; datasets arrays or ``Chunked``; attributes of the root group only."""

import struct
import zlib
from dataclasses import dataclass

import numpy as np

NOWHERE = 0xFFFFFFFFFFFFFFFF


@dataclass
class Chunked:
    values: np.ndarray
    chunks: tuple
    filters: tuple = ("shuffle", "deflate")


@dataclass
class Heap:
    """Strings of any length."""

    texts: list


def padded(raw, n=8):
    return raw + b"\0" * (-len(raw) % n)


def datatype(dtype):
    dtype, big = np.dtype(dtype), np.dtype(dtype).byteorder == ">"
    if dtype.kind == "S":
        return struct.pack("<B3sI", 0x13, b"\0\0\0", dtype.itemsize)
    if dtype.kind in "iu":
        return struct.pack("<B3sIHH", 0x10, bytes([big | 8 * (dtype.kind == "i"), 0, 0]), dtype.itemsize, 0, 8 * dtype.itemsize)
    e, m, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[dtype.itemsize]
    return struct.pack("<B3sIHHBBBBI", 0x11, bytes([0x20 | big, 8 * dtype.itemsize - 1, 0]), dtype.itemsize, 0, 8 * dtype.itemsize, m, e, 0, m, bias)


def dataspace(shape):
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


class Writer:
    def __init__(self, tree, attrs, new=False, shift=0):
        self.new, self.shift = new, shift
        self.out = bytearray(96)
        self.attrs = attrs
        root = self.group(tree, attrs)
        if new:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, shift, NOWHERE, len(self.out), root, 0)
        else:
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, shift, NOWHERE, len(self.out), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.out[: len(head)] = head

    def put(self, raw):
        at = len(self.out)
        self.out += padded(raw)
        return at

    def header(self, messages):
        if self.new:
            body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)
        packed = [struct.pack("<HHB3x", k, len(padded(m)), 0) + padded(m) for k, m in messages]
        if len(packed) > 3:  # what is left comes in a block of its own
            more = b"".join(packed[2:])
            packed = packed[:2] + [struct.pack("<HHB3xQQ", 0x10, 16, 0, self.put(more), len(more))]
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, sum(map(len, packed))) + b"".join(packed))

    def attribute(self, name, value):
        name = name.encode() + b"\0"
        if isinstance(value, Heap):
            objects, places = b"", []
            for n, text in enumerate(value.texts, 1):
                objects += struct.pack("<HHIQ", n, 1, 0, len(text)) + padded(text)
                places.append((len(text), n))
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(objects) + 16) + objects + b"\0" * 16)
            kind = struct.pack("<B3sI", 0x19, b"\1\0\0", 16) + struct.pack("<B3sI", 0x13, b"\0\0\0", 1)
            shape, raw = (len(places),), b"".join(struct.pack("<IQI", size, heap, n) for size, n in places)
        else:
            value = np.asarray(value)
            kind, shape, raw = datatype(value.dtype), value.shape, value.tobytes()
        space = dataspace(shape)
        if self.new:
            return 0x0C, struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + raw
        return 0x0C, struct.pack("<BxHHH", 1, len(name), len(kind), len(space)) + padded(name) + padded(kind) + padded(space) + raw

    def group(self, tree, attrs=()):
        children = {name: self.group(x) if isinstance(x, dict) else self.dataset(x) for name, x in sorted(tree.items())}
        messages = [self.attribute(*a) for a in dict(attrs).items()]
        if self.new:
            links = [(0x06, struct.pack("<BBB", 1, 0, len(n.encode())) + n.encode() + struct.pack("<Q", at)) for n, at in children.items()]
            return self.header([(0x02, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), *links, *messages])
        names, offsets = b"\0" * 8, {}
        for n in children:
            offsets[n] = len(names)
            names = padded(names + n.encode() + b"\0")
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(names)))
        nodes, ordered = [], list(children.items())
        for i in range(0, max(1, len(ordered)), 4):
            part = ordered[i : i + 4]
            entries = b"".join(struct.pack("<QQII16x", offsets[n], at, 0, 0) for n, at in part)
            nodes.append((self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + entries), offsets[part[-1][0]] if part else 0))
        tree_at = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NOWHERE, NOWHERE) + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", at, key) for at, key in nodes))
        return self.header([(0x11, struct.pack("<QQ", tree_at, heap)), *messages])

    def dataset(self, x):
        values = x.values if isinstance(x, Chunked) else np.asarray(x)
        messages = [(0x01, dataspace(values.shape)), (0x03, datatype(values.dtype))]
        if not isinstance(x, Chunked):
            return self.header([*messages, (0x08, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes))])
        rank, entries = values.ndim, []
        for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, x.chunks))):
            first = [i * c for i, c in zip(at, x.chunks)]
            chunk = np.zeros(x.chunks, values.dtype)
            part = values[tuple(slice(f, f + c) for f, c in zip(first, x.chunks))]
            chunk[tuple(slice(n) for n in part.shape)] = part
            raw = chunk.tobytes()
            for name in x.filters:
                if name == "shuffle":
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, values.itemsize).T.tobytes()
                elif name == "deflate":
                    raw = zlib.compress(raw)
                else:
                    raw += b"\1\2\3\4"
            entries.append((struct.pack(f"<II{rank + 1}Q", len(raw), 0, *first, 0), self.put(raw)))
        end = struct.pack(f"<II{rank + 1}Q", 0, 0, *(-(-n // c) * c for n, c in zip(values.shape, x.chunks)), 0)
        leaves = []
        for i in range(0, len(entries), 3):
            part = entries[i : i + 3]
            after = entries[i + 3][0] if i + 3 < len(entries) else end
            leaves.append((part[0][0], self.tree(0, part, after)))
        root = leaves[0][1] if len(leaves) == 1 else self.tree(1, leaves, end)
        numbers = {"deflate": (1, [6]), "shuffle": (2, [values.itemsize]), "fletcher": (3, [])}
        pipeline = struct.pack("<BB6x", 1, len(x.filters)) + b"".join(struct.pack("<HHHH", numbers[f][0], 0, 1, len(numbers[f][1])) + b"".join(struct.pack("<I4x", v) for v in numbers[f][1]) for f in x.filters)
        layout = struct.pack("<BBBQ", 3, 2, rank + 1, root) + b"".join(struct.pack("<I", n) for n in (*x.chunks, values.itemsize))
        return self.header([*messages, (0x0B, pipeline), (0x08, layout)])

    def tree(self, level, entries, end):
        return self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(entries), NOWHERE, NOWHERE) + b"".join(key + struct.pack("<Q", at) for key, at in entries) + end)


def write(path, tree, attrs=(), new=False, shift=0):
    """``shift`` bytes of something else come first."""
    with open(path, "wb") as f:
        f.write(b"\0" * shift + bytes(Writer(tree, dict(attrs), new, shift).out))
