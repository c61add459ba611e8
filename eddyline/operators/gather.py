"""Values of a gridded field at points in DataFrame functions: the stencil's cells are computed and joined by index.

FIELD(time_idx, i, j, k, <keys>) is a table of cells; points carry fractional grid coordinates (fi, fj, fk: 2.25 is
a quarter of the way from cell 2 to cell 3). Cells beyond a pole or the seam are the stored ones they mirror
(``ghost_cell``), so nothing is copied. The join is an equi-join on the cell's index, which Spark broadcasts
while the field is small and shuffles otherwise; points outside the grid come out as NaN. For many points or the
cubic stencils of 64 cells see ``tiles.gather``, which moves a row a point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions.geometry import ghost_cell
from eddyline.functions.stencil import searchsorted


def _corner_rows(points: DataFrame, width: int) -> DataFrame:
    """A row for each point and cell of its stencil of ``width`` nodes an axis."""
    offsets = F.array(*(F.lit(d) for d in (range(-1, 3) if width == 4 else range(2))))
    out = points
    for axis in "ijk":
        out = out.withColumn("__d", F.explode(offsets)).withColumn(f"__{axis}", (F.floor(f"f{axis}") + F.col("__d")).cast("int")).drop("__d")
    return out


def _cells(rows: DataFrame, field: DataFrame, keys: list[str], n_theta: int | None, n_phi: int | None, node_centred: bool) -> DataFrame:
    j, k = F.col("__j"), F.col("__k")
    if n_phi:
        row, column = ghost_cell(j, k, n_theta, n_phi, node_centred)
        rows = rows.withColumn("__row", row.cast("int")).withColumn("__col", column.cast("int"))
    else:
        rows = rows.withColumn("__row", j).withColumn("__col", k)
    cells = field.select(F.col("time_idx"), F.col("i").alias("__i"), F.col("j").alias("__row"), F.col("k").alias("__col"), *keys)
    return rows.join(cells, ["time_idx", "__i", "__row", "__col"])


def gather_linear(points: DataFrame, field: DataFrame, keys: list[str], point: str = "point_id", n_theta: int | None = None, n_phi: int | None = None, node_centred: bool = False) -> DataFrame:
    """point, <keys>: trilinear; a point whose stencil leaves the grid is NaN."""
    weight = F.lit(1.0)
    for axis in "ijk":
        f = F.col(f"f{axis}") - F.floor(F.col(f"f{axis}"))
        weight = weight * F.when(F.col(f"__{axis}") == F.floor(F.col(f"f{axis}")), 1 - f).otherwise(f)
    rows = _corner_rows(points.select(point, "time_idx", "fi", "fj", "fk"), 2).withColumn("__w", weight).where("__w > 0")
    found = _cells(rows, field, keys, n_theta, n_phi, node_centred).groupBy(point).agg(F.sum("__w").alias("__w"), *(F.sum(F.col("__w") * F.col(c)).alias(c) for c in keys))
    whole = points.select(point).join(found, point, "left")
    return whole.select(point, *(F.when(F.col("__w") > 1 - 1e-9, F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in keys))


def gather_nearest(points: DataFrame, field: DataFrame, keys: list[str], point: str = "point_id") -> DataFrame:
    rows = points.select(point, "time_idx", *(F.floor(F.col(f"f{a}") + 0.5).cast("int").alias(f"__{a}") for a in "ijk"))
    return points.select(point).join(_cells(rows, field, keys, None, None, False).select(point, *keys), point, "left")


def locate_blocks(points: DataFrame, block_map: DataFrame, faces: dict[str, list[float]], level: int, interior: dict[str, int]) -> DataFrame:
    """``points`` (x1, x2, x3) and the block_id that holds each: the root cell by its faces, the slot of the
    finest level in it, and an equi-join with BLOCK_MAP(s1, s2, s3, block_id). Outside: null."""
    out = points
    for n, axis in enumerate(("x1", "x2", "x3"), 1):
        edges = faces[axis]
        array = F.array(*map(F.lit, map(float, edges)))
        cell = searchsorted(array, F.col(axis)) - 1
        cell = F.when(F.col(axis) == edges[-1], F.lit(len(edges) - 2)).otherwise(cell)
        low, high = F.try_element_at(array, cell + 1), F.try_element_at(array, cell + 2)
        inside = (F.col(axis) >= edges[0]) & (F.col(axis) <= edges[-1])
        fine = F.least(F.floor((F.col(axis) - low) / (high - low) * (1 << level)).cast("int"), F.lit((1 << level) - 1))
        out = out.withColumn(f"s{n}", F.when(inside, F.floor((cell * (1 << level) + fine) / interior[axis]).cast("int")))
    return out.join(block_map.select("s1", "s2", "s3", "block_id"), ["s1", "s2", "s3"], "left")
