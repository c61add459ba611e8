"""Fields cut in tiles, and what needs a field's values at points: gathering and advancing particles.

TILE(time_idx, tile, p array<int>, <key> array<double>...) holds a box of ``size`` cells an axis and a halo around it,
ghosts beyond poles and the seam included; ``p`` is each cell's place in the box. Points meet the tile of their cell in a
cogroup, one row a point, all keys at once; tiles without points aren't sent, and a tile with many points is
dealt in shares, each with its own copy of the tile. A particle whose stage lies in another tile
goes on in the tile that owns the point (``staged``), so boxes are as wide as stencils.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.geometry import ghost_cell
from eddyline.functions.grid import Block, Grid
from eddyline.functions.spline import DEGREES

SIZE = 16
#: Nodes around a tile that stencils of its own points take: splines' reach farther at an axis' end.
HALO, SPLINE_HALO = 2, 4
#: Points of one tile that a task takes together.
SHARE = 50_000
#: Snapshots that are named one by one when a field is read.
FEW_TIMES = 1000


def halo_of(method: str) -> int:
    return SPLINE_HALO if method in DEGREES else HALO


@dataclass(frozen=True)
class Space:
    """Tiles as the ``space`` that ``staged`` takes."""

    grid: Grid
    size: int
    method: str

    @property
    def halo(self) -> int:
        return halo_of(self.method)

    def coordinates(self, p: np.ndarray) -> np.ndarray:
        return self.grid.coordinates(p)

    def find(self, x: np.ndarray) -> np.ndarray:
        return tile_of(self.grid, self.size, x)

    def columns(self, names: list[str]) -> list[str]:
        return ["p", *names]

    def readers(self, table: pa.Table, names: list[str]) -> dict:
        return {i: (lambda x, b=b: _own(b, x, self.method)) for i, b in blocks_of(table, self.grid, self.size, self.halo, names).items()}


def _own(block: Block, x: np.ndarray, method: str) -> np.ndarray:
    values, stray = block.at(x, method)
    assert not stray.any(), "a stencil reaches beyond the halo"
    return values


def counts(grid: Grid, size: int) -> list[int]:
    """Tiles on each axis; the outermost take the ghosts."""
    return [max(1, math.ceil(n / size)) for n in grid.shape]


def tile_of(grid: Grid, size: int, q: np.ndarray) -> np.ndarray:
    """The tile of each point in grid coordinates (3, n); -1 outside the grid."""
    cell, inside = grid.cells(q)
    n = counts(grid, size)
    t = [np.clip(cell[a] // size, 0, n[a] - 1) for a in range(3)]
    return np.where(inside, (t[0] * n[1] + t[1]) * n[2] + t[2], -1)


def box(grid: Grid, size: int, halo: int, tile: int) -> tuple[list[int], list[int]]:
    """(first node, nodes) of a tile's box on each axis."""
    n = counts(grid, size)
    t = (tile // (n[1] * n[2]), tile // n[2] % n[1], tile % n[2])
    low = [t[a] * size - halo if t[a] else -grid.ghosts(a) for a in range(3)]
    high = [(t[a] + 1) * size + halo if t[a] < n[a] - 1 else grid.shape[a] + grid.ghosts(a) for a in range(3)]
    low = [max(x, -grid.ghosts(a)) for a, x in enumerate(low)]
    high = [min(x, grid.shape[a] + grid.ghosts(a)) for a, x in enumerate(high)]
    return low, [b - a for a, b in zip(low, high, strict=True)]


def _images(field: DataFrame, grid: Grid) -> DataFrame:
    """``field`` with a row for each node that a cell stands for, ghosts too: ei, ej, ek (which it may have already)."""
    if "ei" in field.columns:
        return field
    if not grid.spherical:
        return field.withColumns({"ei": F.col("i"), "ej": F.col("j"), "ek": F.col("k")})
    _, n_j, n_k = grid.shape
    g, shift = grid.ghosts(1), 0 if grid.node_centred else 1
    mirrored = F.array(F.col("j"), -F.col("j") - shift, 2 * (n_j - 1) + shift - F.col("j"))
    out = field.withColumn("ej", F.explode(F.array_distinct(mirrored))).where((F.col("ej") >= -g) & (F.col("ej") < n_j + g))
    beyond = (F.col("ej") < 0) | (F.col("ej") >= n_j)
    k = F.pmod(F.col("k") - F.when(beyond, F.lit(n_k // 2)).otherwise(F.lit(0)), F.lit(n_k))
    out = out.withColumn("ek", F.explode(F.array(*(k + m * n_k for m in (-1, 0, 1))))).where((F.col("ek") >= -g) & (F.col("ek") < n_k + g))
    row, column = ghost_cell(F.col("ej"), F.col("ek"), n_j, n_k, grid.node_centred)
    return out.where((row == F.col("j")) & (column == F.col("k"))).withColumn("ei", F.col("i"))


def tiled(field: DataFrame, grid: Grid, keys: list[str], size: int = SIZE, halo: int = HALO, only: DataFrame | None = None) -> DataFrame:
    """TILE of FIELD(time_idx, i, j, k, <keys>): each cell goes to the boxes that hold it, one shuffle; with ``only`` (tile and
    perhaps time_idx, a row each) to those."""
    n = counts(grid, size)
    index = ("ei", "ej", "ek") if "ei" in field.columns else ("i", "j", "k")
    out = _images(field.select("time_idx", *index, *keys), grid)

    def of(a: int, e: str) -> Column:
        low, high = F.floor((F.col(e) - halo) / size), F.floor((F.col(e) + halo) / size)
        return F.sequence(F.least(F.greatest(low, F.lit(0)), F.lit(n[a] - 1)), F.least(F.greatest(high, F.lit(0)), F.lit(n[a] - 1)))

    for a, (e, t) in enumerate((("ei", "ti"), ("ej", "tj"), ("ek", "tk"))):
        out = out.withColumn(t, F.explode(of(a, e)))
        first, ghosts = F.when(F.col(t) == 0, F.lit(-grid.ghosts(a))).otherwise(F.greatest(F.col(t) * size - halo, F.lit(-grid.ghosts(a)))), grid.ghosts(a)
        last = F.when(F.col(t) == n[a] - 1, F.lit(grid.shape[a] + ghosts)).otherwise(F.least((F.col(t) + 1) * size + halo, F.lit(grid.shape[a] + ghosts)))
        out = out.withColumn(f"l{a}", F.col(e) - first).withColumn(f"n{a}", last - first).where((F.col(f"l{a}") >= 0) & (F.col(f"l{a}") < F.col(f"n{a}")))
    place = ((F.col("l0") * F.col("n1") + F.col("l1")) * F.col("n2") + F.col("l2")).cast("int")
    tile = ((F.col("ti") * n[1] + F.col("tj")) * n[2] + F.col("tk")).cast("long")
    out = out.withColumn("tile", tile)
    if only is not None:
        out = out.join(only, only.columns, "left_semi")
    cells = out.groupBy("time_idx", "tile").agg(F.collect_list(F.struct(place.alias("p"), *(F.col(k).cast("double").alias(f"v{m}") for m, k in enumerate(keys)))).alias("cells"))
    return cells.select("time_idx", "tile", F.col("cells.p").alias("p"), *(F.col(f"cells.v{m}").alias(k) for m, k in enumerate(keys)))


def _dealt(points: DataFrame, tiles: DataFrame, by: list[str], since: tuple[Column, Column] | None = None, rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points and tiles with a ``share``; only tiles that a point is in and, with ``since`` (a number of a point, one of a tile's
    row), of those the rows from the least of their points on. A point leaves at most ``rows`` rows and counts as so many."""
    least = [F.min(since[0]).alias("least")] if since else []
    crowd = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * max(rows, 1) / SHARE).alias("shares"), *least)
    code = F.xxhash64(*points.columns)
    dealt = points.join(crowd.where("shares > 1").drop("least"), by, "left").withColumn("share", F.pmod(code, F.coalesce("shares", F.lit(1)))).drop("shares")
    sent = tiles.join(crowd, by)
    if since:
        sent = sent.where(since[1] >= F.col("least")).drop("least")
    sent = sent.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return dealt.toDF(*dealt.columns), sent.toDF(*sent.columns)  # columns of their own, should one come from the other


def blocks_of(table: pa.Table, grid: Grid, size: int, halo: int, keys: list[str]) -> dict[int, Block]:
    """By time_idx the block of each of a tile's rows, with the keys in the given order."""
    out = {}
    for row in range(table.num_rows):
        low, n = box(grid, size, halo, table["tile"][row].as_py())
        values = np.full((len(keys), n[0] * n[1] * n[2]), np.nan)
        place = np.asarray(table["p"][row].values)
        for m, k in enumerate(keys):
            if table[k][row].is_valid:
                values[m, place] = np.asarray(table[k][row].values, float)
        out[table["time_idx"][row].as_py()] = Block(grid, tuple(low), values.reshape(len(keys), *n))
    return out


def located(points: DataFrame, grid: Grid, size: int, place: list[str], kind: str) -> DataFrame:
    """``points`` with their tile; ``place`` names three columns, which are ``positions`` or grid ``coordinates``."""
    fields = points.schema

    def run(batches):
        for batch in batches:
            p = np.stack([np.asarray(batch[c], float) for c in place]) if len(batch) else np.zeros((3, 0))
            tile = tile_of(grid, size, grid.coordinates(p) if kind == "positions" else p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile, pa.int64())], [*batch.schema.names, "tile"])

    return points.mapInArrow(run, f"{_ddl(fields)}, tile long")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def gather(points: DataFrame, field: DataFrame, grid: Grid, keys: list[str], method: str = "pchip", point: str = "point_id", place: tuple[str, str, str] = ("x", "y", "z"), kind: str = "positions", size: int = SIZE, tiles: DataFrame | None = None) -> DataFrame:
    """point, time_idx, <keys>: a row for each point (point, time_idx, its place), NaN outside the grid. ``tiles`` are
    those of ``tiled(field, grid, keys, size)``, if they are at hand; else the snapshots that points name are read, and of them
    the tiles that points are in cut."""
    names = [point, "time_idx", *place]
    inside = located(points.select(*names), grid, size, list(place), kind)
    if tiles is None:
        named = [r[0] for r in points.select("time_idx").distinct().limit(FEW_TIMES + 1).collect()]
        if len(named) <= FEW_TIMES:  # beyond, one join does it
            field = field.where(F.col("time_idx").isin([n for n in named if n is not None]))
        tiles = tiled(field, grid, keys, size, halo_of(method), only=inside.select("time_idx", "tile").distinct())
    tiles = tiles.select("time_idx", "tile", "p", *keys)
    left, right = _dealt(inside, tiles, ["time_idx", "tile"])

    def run(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        q = np.stack([mine[c].to_numpy().astype(float) for c in place])
        q = grid.coordinates(q) if kind == "positions" else q
        values = np.full((len(keys), mine.num_rows), np.nan)
        if theirs.num_rows:
            (block,) = blocks_of(theirs, grid, size, halo_of(method), keys).values()
            values = _own(block, q, method)
        return pa.table([mine[point], mine["time_idx"], *map(pa.array, values)], names=[point, "time_idx", *keys])

    on = ["time_idx", "tile", "share"]
    schema = ", ".join([_ddl(points.select(point, "time_idx").schema), *(f"`{k}` double" for k in keys)])
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)
