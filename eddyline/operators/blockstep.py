"""Refined blocks as parts of a field: gathering from BLOCK tables, and what stepping through them needs.

BLOCK(time_idx, block_id, x1v, x2v, x3v, <keys>) has the nodes and values of each block, with two ghost layers or more and x1
fastest. Blocks are read as they are; none are copied for their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions.octree import Octree
from eddyline.operators import staged, tiles as tiling
from eddyline.operators.meshblock import block_values

NODES = ("x1v", "x2v", "x3v")


@dataclass(frozen=True)
class Space:
    """The ``space`` that ``staged`` takes."""

    octree: Octree

    def coordinates(self, p: np.ndarray) -> np.ndarray:
        return self.octree.coordinates(p)

    def find(self, x: np.ndarray) -> np.ndarray:
        return self.octree.find(x)

    def columns(self, names: list[str]) -> list[str]:
        return [*NODES, *names]

    def readers(self, table: pa.Table, names: list[str]) -> dict[int, Callable]:
        held = {table["time_idx"][row].as_py(): _read_block(table, row, names) for row in range(table.num_rows)}
        return {i: (lambda x, b=b: block_values(*b, x)) for i, b in held.items()}


def parts(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("tile", F.col("block_id").cast("long"))


def _read_block(table: pa.Table, row: int, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    axes = [np.asarray(table[c][row].values, float) for c in NODES]
    shape = [len(a) for a in axes[::-1]]
    empty = np.full(shape, np.nan)
    return axes, np.stack([np.asarray(table[k][row].values, float).reshape(shape) if table[k][row].is_valid else empty for k in names])


def gather(points: DataFrame, blocks: DataFrame, octree: Octree, keys: list[str], point: str = "point_id") -> DataFrame:
    """point, time_idx, <keys>: a row for each of ``points`` (point, time_idx, x, y, z), NaN outside."""
    inside = staged.located(points.select(point, "time_idx", "x", "y", "z"), Space(octree), ["x", "y", "z"])
    right = blocks.select("time_idx", F.col("block_id").cast("long").alias("tile"), *NODES, *keys)
    named = [r[0] for r in points.select("time_idx").distinct().limit(tiling.FEW_TIMES + 1).collect()]
    if len(named) <= tiling.FEW_TIMES:
        right = right.where(F.col("time_idx").isin([n for n in named if n is not None]))
    left, right = tiling._dealt(inside, right, ["time_idx", "tile"])

    def run(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        values = np.full((len(keys), mine.num_rows), np.nan)
        if theirs.num_rows:
            axes, data = _read_block(theirs, 0, keys)
            values = block_values(axes, data, octree.coordinates(np.stack([mine[c].to_numpy().astype(float) for c in "xyz"])))
        return pa.table([mine[point], mine["time_idx"], *map(pa.array, values)], names=[point, "time_idx", *keys])

    on = ["time_idx", "tile", "share"]
    schema = ", ".join([tiling._ddl(points.select(point, "time_idx").schema), *(f"`{k}` double" for k in keys)])
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)
