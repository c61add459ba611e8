"""Coefficients of tensor-product splines of gridded fields.

Solving along an axis takes whole lines of it, so cells are dealt as slabs: those of one j, for the lines along i, and then,
after the one shuffle that transposes them, those of one i, for the lines along j and k. A slab is a group, as large as two axes of
a grid. Coefficients come as a FIELD in extended indices, ghosts of a spherical grid included, which ``tiles`` cuts and
``Block.at`` evaluates by the methods ``cubic`` and ``quintic``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions.grid import Grid
from eddyline.functions.spline import DEGREES, coefficients
from eddyline.operators import tiles as tiling


def fitted(field: DataFrame, grid: Grid, keys: list[str], method: str) -> DataFrame:
    """FIELD(time_idx, ei, ej, ek, <keys>) of the coefficients of FIELD(time_idx, i, j, k, <keys>) for ``cubic`` or ``quintic``
    gathers. Coefficients in which a cell that lacks, or is NaN, has a part are NaN."""
    degree = DEGREES[method]
    cells = tiling._images(field.select("time_idx", "i", "j", "k", *keys), grid).select("time_idx", *(F.col(f"e{a}").cast("int").alias(f"e{a}") for a in "ijk"), *(F.col(k).cast("double").alias(k) for k in keys))
    schema = "time_idx int, ei int, ej int, ek int, " + ", ".join(f"`{k}` double" for k in keys)

    def solved(slab: pa.Table, axes: tuple[int, ...]) -> pa.Table:
        """``slab`` with coefficients along ``axes`` in place of values; the axis that is not of the slab has one index."""
        index = [slab[f"e{a}"].to_numpy() + grid.ghosts(n) for n, a in enumerate("ijk")]
        whole = [len(grid.nodes(a)) for a in range(3)]
        flat = 1 if axes == (0,) else 0  # the slab's own axis
        place = [np.zeros_like(x) if a == flat else x for a, x in enumerate(index)]
        shape = [1 if a == flat else n for a, n in enumerate(whole)]
        values = np.full((*shape, len(keys)), np.nan)
        values[*place] = np.stack([slab[k].to_numpy() for k in keys], 1)
        for a in axes:
            values = np.moveaxis(coefficients(grid.nodes(a), np.moveaxis(values, a, 0), degree), 0, a)
        where = np.meshgrid(*(np.arange(n) for n in shape), indexing="ij")
        out = [(w.ravel() + (index[a][0] if a == flat else 0) - grid.ghosts(a)).astype(np.int32) for a, w in enumerate(where)]
        time = pa.array(np.full(len(out[0]), slab["time_idx"][0].as_py(), np.int32))
        return pa.table([time, *map(pa.array, out), *(pa.array(values[..., n].ravel()) for n in range(len(keys)))], names=["time_idx", "ei", "ej", "ek", *keys])

    along = cells.groupBy("time_idx", "ej").applyInArrow(lambda slab: solved(slab, (0,)), schema)
    return along.groupBy("time_idx", "ei").applyInArrow(lambda slab: solved(slab, (1, 2)), schema)
