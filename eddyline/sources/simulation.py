"""Snapshots in HDF5 files as tables: refined blocks, and surfaces radius by radius.

``blocks_hdf5`` gives a row a block, its nodes and the wanted variables as arrays; ``surface_hdf5`` a row a radius and variable.
A file is read by as many tasks as ``split`` bytes fit in it: each takes its share of the blocks or radii and reads, of the wanted
variables only, the bytes that hold them. Options: ``keys`` (variables, by comma), ``headers`` (a row a file with no values),
``split``, and ``layout`` (of blocks: a digest that every file's refinement must have).
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eddyline.functions.octree import Octree, faces
from eddyline.sources.hdf5 import File
from eddyline.sources.vtk import list_files

SPLIT = 64 << 20
#: Blocks of a batch of rows.
BATCH = 32
#: Coordinates whose velocities are known, raw velocities, and the file's own fields among a surface's.
COORDINATES = ("schwarzschild", "spherical_polar")
RAW_VELOCITY = ("vel1", "vel2", "vel3")
OWN = ("r", "th", "ph", "time")
#: Ghost layers that a cubic stencil needs.
GHOSTS = 2


def _text(value) -> str:
    return value.split(b"\0")[0].decode() if isinstance(value, bytes | np.bytes_) else str(value)


def variables(f: File) -> dict[str, tuple[str, int]]:
    """(dataset, index in it) of each variable of a file of blocks."""
    a = f.root.attrs
    names, sets, counts = (np.atleast_1d(a[n]) for n in ("VariableNames", "DatasetNames", "NumVariables"))
    out, at = {}, 0
    for name, n in zip(sets, counts, strict=True):
        for i in range(int(n)):
            out[_text(names[at + i])] = (_text(name), i)
        at += int(n)
    return out


def layout_digest(f: File) -> str:
    return hashlib.sha256(f["Levels"].read().astype("<i8").tobytes() + f["LogicalLocations"].read().astype("<i8").tobytes()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    octree: Octree
    ghosts: int
    digest: str


def read_layout(path: str) -> Layout:
    """The refinement that a file of blocks has, checked."""
    with File(path) as f:
        a = f.root.attrs
        kind = _text(a["Coordinates"])
        if kind not in COORDINATES:
            raise ValueError(f"{path}: coordinates {kind!r}, not one of {', '.join(COORDINATES)}")
        size, root = np.asarray(a["MeshBlockSize"]).astype(int), np.asarray(a["RootGridSize"]).astype(int)
        specs = [np.asarray(a[f"RootGridX{n}"]).astype(float) for n in (1, 2, 3)]
        x1f = f["x1f"].read().astype(float)
        inner = x1f[int(np.argmin(x1f[:, 0]))]
        ghosts = int(np.argmin(np.abs(inner - specs[0][0])))  # what lies before the domain's first face
        if ghosts < GHOSTS:
            raise ValueError(f"{path}: blocks have {ghosts} ghost layers, {GHOSTS} are needed")
        levels, places = f["Levels"].read().astype(int), f["LogicalLocations"].read().astype(int)
        blocks = tuple((n, int(level), *map(int, place)) for n, (level, place) in enumerate(zip(levels, places, strict=True)))
        interior = tuple(int(n) - 2 * ghosts for n in size)
        if min(interior) <= 0:
            raise ValueError(f"{path}: blocks of {tuple(size)} with {ghosts} ghost layers have no cells")
        tree = Octree(tuple(faces(*map(float, spec), int(n)) for spec, n in zip(specs, root, strict=True)), interior, blocks)
        return Layout(tree, ghosts, layout_digest(f))


@dataclass
class _Part(InputPartition):
    path: str
    share: int
    of: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
        self.headers = str(self.options.get("headers", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        directory, pattern = posixpath.split(self.options["path"])
        if directory.endswith("/**"):
            directory, pattern = directory[:-3], f"**/{pattern}"
        split, out = int(self.options.get("split", SPLIT)), []
        for path in list_files(directory, pattern):
            store, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")
            of = 1 if self.headers else max(1, -(-store.get_file_info(inner).size // split))
            out += [_Part(path, n, of) for n in range(of)]
        return out


def _arrays(rows: np.ndarray) -> pa.Array:
    """A row of ``rows`` (n, ...) each as an array of doubles, last axis fastest."""
    flat = np.ascontiguousarray(rows, float).reshape(len(rows), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


class _BlocksReader(_Reader):
    def read(self, p: _Part) -> Iterator[pa.RecordBatch]:
        with File(p.path) as f:
            table, time, n = variables(f), float(f.root.attrs["Time"]), int(f.root.attrs["NumMeshBlocks"])
            if self.headers:
                yield pa.RecordBatch.from_arrays([pa.array([p.path]), pa.array([time]), pa.array([sorted(table)], pa.list_(pa.string())), pa.array([layout_digest(f)])], ["path", "time", "keys", "layout"])
                return
            if "layout" in self.options and layout_digest(f) != self.options["layout"]:
                raise ValueError(f"{p.path}: its blocks are refined otherwise than the first file's")
            levels, places = f["Levels"].read(), f["LogicalLocations"].read()
            stop = (p.share + 1) * n // p.of
            for a in range(p.share * n // p.of, stop, BATCH):
                b = min(a + BATCH, stop)
                columns = {"path": pa.array([p.path] * (b - a)), "time": pa.array(np.full(b - a, time)), "block_id": pa.array(np.arange(a, b)), "level": pa.array(levels[a:b].astype(np.int32))}
                columns |= {f"l{i + 1}": pa.array(places[a:b, i].astype(np.int64)) for i in range(3)}
                columns |= {c: _arrays(f[c].read((a, b))) for c in ("x1v", "x2v", "x3v", "x2f")}
                for key in self.keys:
                    if key in table:
                        name, i = table[key]
                        columns[key] = _arrays(f[name].read(i, (a, b)))  # x3, x2, x1: x1 fastest
                    else:
                        columns[key] = pa.array([None] * (b - a), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class BlocksHdf5(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks_hdf5"

    def schema(self) -> str:
        if str(self.options.get("headers", "false")).lower() == "true":
            return "path string, time double, keys array<string>, layout string"
        own = "path string, time double, block_id long, level int, l1 long, l2 long, l3 long, x1v array<double>, x2v array<double>, x3v array<double>, x2f array<double>"
        return ", ".join([own, *(f"`{k.strip()}` array<double>" for k in self.options.get("keys", "").split(",") if k.strip())])

    def reader(self, schema) -> _BlocksReader:
        return _BlocksReader(self.options)


@dataclass(frozen=True)
class _Surface:
    """How one file keeps its radii: of each radius its key and value; of each variable, by its short name, where it lies."""

    time: float
    keys: list[str]
    radii: list[float]
    theta: np.ndarray
    phi: np.ndarray
    names: dict[str, str]  # short name: group and dataset below a radius, or the dataset of all radii
    whole: bool


def _surface(f: File) -> _Surface:
    coordinates = f["coordinates"]
    if "r" in coordinates.children and f["coordinates/r"].is_dataset:
        radii = f["coordinates/r"].read().astype(float)
        names = {k: k for k in f.root.children if k != "coordinates"}
        time = float(np.ravel(f["coordinates/time"].read())[0])
        return _Surface(time, [str(i) for i in range(len(radii))], radii.tolist(), f["coordinates/th"].read().astype(float), f["coordinates/ph"].read().astype(float), names, True)
    keys = sorted(coordinates.children, key=int)
    first = f"coordinates/{keys[0]}"
    radii = [float(np.ravel(f[f"coordinates/{k}/R"].read())[0]) for k in keys]
    names = {}
    for group in f[f"fields/{keys[0]}"].children:
        for name in f[f"fields/{keys[0]}/{group}"].children:
            short = name.split(".")[-1]
            if name in OWN:
                continue
            if short in names:
                raise ValueError(f"{f.path}: two variables are {short}")
            names[short] = f"{group}/{name}"
    return _Surface(float(np.ravel(f[f"{first}/T"].read())[0]), keys, radii, f[f"{first}/th"].read().astype(float), f[f"{first}/ph"].read().astype(float), names, False)


class _SurfaceReader(_Reader):
    def read(self, p: _Part) -> Iterator[pa.RecordBatch]:
        with File(p.path) as f:
            s = _surface(f)
            if self.headers:
                yield pa.RecordBatch.from_arrays([pa.array([p.path]), pa.array([s.time]), pa.array([sorted(s.names)], pa.list_(pa.string()))], ["path", "time", "keys"])
                return
            n = len(s.keys)
            for i in range(p.share * n // p.of, (p.share + 1) * n // p.of):
                wanted = {k: v for k, v in s.names.items() if not self.keys or k in self.keys}
                values = [f[where].read(i) if s.whole else f[f"fields/{s.keys[i]}/{where}"].read() for where in wanted.values()]
                if not values:
                    continue
                m = len(values)
                columns = [pa.array([p.path] * m), pa.array([s.time] * m), pa.array([i] * m, pa.int32()), pa.array([s.radii[i]] * m), pa.array(list(wanted)), _arrays(np.stack(values))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "time", "i", "r", "key", "values"])


class SurfaceHdf5(DataSource):
    @classmethod
    def name(cls) -> str:
        return "surface_hdf5"

    def schema(self) -> str:
        if str(self.options.get("headers", "false")).lower() == "true":
            return "path string, time double, keys array<string>"
        return "path string, time double, i int, r double, key string, values array<double>"

    def reader(self, schema) -> _SurfaceReader:
        return _SurfaceReader(self.options)


def read_axes(path: str) -> tuple[list[float], np.ndarray, np.ndarray]:
    """r, theta and phi of a file of surfaces."""
    with File(path) as f:
        s = _surface(f)
    if len(s.theta) < 2 or len(s.phi) < 2:
        raise ValueError(f"{path}: fewer than two angles")
    return s.radii, s.theta, s.phi


def read_files(spark: SparkSession, path: str, source: type[DataSource]) -> DataFrame:
    """FILES(path, time, keys) of the headers."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("headers", "true").load(path)


def latest(files: DataFrame, keys: list[str]) -> DataFrame:
    """(time, path, keys) of the lexically last file that has each of ``keys`` at each time."""
    last = files.select("time", "path", F.explode("keys").alias("key")).where(F.col("key").isin(keys)).groupBy("time", "key").agg(F.max("path").alias("path"))
    return last.groupBy("time", "path").agg(F.collect_set("key").alias("mine"))
