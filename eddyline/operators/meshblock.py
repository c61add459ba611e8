"""Values of a block-refined field at points: each block brings its own nodes, ghost layers included.

BLOCK(block_id, x1v, x2v, x3v arrays of node positions, <key> arrays, x1 fastest) and points meet in a cogroup by block_id,
so a block is sent once to each share of the points in it (``SHARE`` at most), not with each of them. All points of a
share are contracted together, the four nodes around them along each axis with the monotone cubic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions.stencil import pchip4_np

SHARE = 50_000


def stencil_starts(nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """First of the four nodes around each q, -1 where q isn't among them; at a block's ends, round-off is forgiven by a node."""
    at = np.searchsorted(nodes, q, "right") - 2
    ok = np.isfinite(q) & (at >= -1) & (at <= len(nodes) - 3)
    return np.where(ok, np.clip(at, 0, len(nodes) - 4), -1)


def block_values(axes: list[np.ndarray], values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(keys, n) at points (3, n) of values (keys, x3, x2, x1); NaN outside the block."""
    starts = np.stack([stencil_starts(a, x) for a, x in zip(axes, q, strict=True)])
    out = np.full((len(values), q.shape[1]), np.nan)
    ok = np.flatnonzero((starts >= 0).all(0))
    if len(ok):
        at = starts[:, None, ok] + np.arange(4)[None, :, None]
        v = values[:, at[2][None, None, :], at[1][None, :, None], at[0][:, None, None]]  # keys, x1, x2, x3, n
        v = np.moveaxis(v, 0, 3)
        for a in range(3):
            nodes = axes[a][at[a]].reshape(4, *[1] * (v.ndim - 2), -1)
            v = pchip4_np(np.broadcast_to(nodes, v.shape), v, q[a, ok])
        out[:, ok] = v
    return out


def gather_blocks(points: DataFrame, blocks: DataFrame, point: str = "point_id", keys: tuple[str, ...] = ("data",)) -> DataFrame:
    """point, <keys> of ``points`` (block_id, x1, x2, x3), a row for each; NaN outside every block."""
    mine = points.select(point, "block_id", "x1", "x2", "x3")
    crowd = mine.groupBy("block_id").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    dealt = mine.join(crowd.where("shares > 1"), "block_id", "left").withColumn("share", F.pmod(F.xxhash64(*mine.columns), F.coalesce("shares", F.lit(1)))).drop("shares")
    copies = blocks.select("block_id", "x1v", "x2v", "x3v", *keys).join(crowd, "block_id").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def run(key, p: pa.Table, b: pa.Table) -> pa.Table:
        values = np.full((len(keys), p.num_rows), np.nan)
        if b.num_rows:
            axes = [np.asarray(b[f"x{d}v"][0].values, float) for d in (1, 2, 3)]
            data = np.stack([np.asarray(b[k][0].values, float).reshape([len(a) for a in axes[::-1]]) for k in keys])
            values = block_values(axes, data, np.stack([p[f"x{d}"].to_numpy().astype(float) for d in (1, 2, 3)]))
        return pa.table([p[point], *map(pa.array, values)], names=[point, *keys])

    kind = points.schema[point].dataType.simpleString()
    on = ["block_id", "share"]
    dealt, copies = dealt.toDF(*dealt.columns), copies.toDF(*copies.columns)  # columns of their own, should one come from the other
    return dealt.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(run, f"`{point}` {kind}, " + ", ".join(f"`{k}` double" for k in keys))


def landed(blocks: DataFrame, ghosts: int, mass: float = 1.0) -> DataFrame:
    """``blocks`` (block_id, x1v, x2v, x3v, x2f, u1, u2, u3 and more) with monotone polar nodes and, for the velocities
    u1, u2, u3 of the normal observer, Cartesian transport velocities V_u_x, V_u_y and V_u_z. Ghost rows that come back over
    a pole are mirrored at the pole's face, and the sign of their u3, which files flip, is flipped back. A block
    whose nodes don't rise strictly after that is an error."""
    names = [c for c in blocks.columns if c not in ("u1", "u2", "u3", "x2f")]

    def run(batches):
        for batch in batches:
            out = {c: batch[c] for c in names}
            nodes, speed = [], [[], [], []]
            for n in range(len(batch)):
                x1, x2, x3, faces = (np.array(batch[c][n].values, float) for c in ("x1v", "x2v", "x3v", "x2f"))
                low, high = np.any(np.diff(x2[: ghosts + 1]) <= 0), np.any(np.diff(x2[-ghosts - 1 :]) <= 0)
                u = [np.array(batch[c][n].values, float).reshape(len(x3), len(x2), len(x1)) for c in ("u1", "u2", "u3")]
                if low:
                    x2[:ghosts] = 2 * faces[ghosts] - x2[ghosts : 2 * ghosts][::-1]
                    u[2][:, :ghosts] *= -1
                if high:
                    x2[-ghosts:] = 2 * faces[-ghosts - 1] - x2[-2 * ghosts : -ghosts][::-1]
                    u[2][:, -ghosts:] *= -1
                if any(np.any(np.diff(x) <= 0) for x in (x1, x2, x3)):
                    raise ValueError(f"nodes of block {batch['block_id'][n]} don't rise")
                nodes.append(x2)
                for mine, v in zip(speed, transport_velocity(*u, x1, x2[:, None], x3[:, None, None], mass), strict=True):
                    mine.append(v.ravel())
            arrays = lambda rows: pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))
            out["x2v"] = arrays(nodes)
            yield pa.RecordBatch.from_arrays([*out.values(), *map(arrays, speed)], [*out, "V_u_x", "V_u_y", "V_u_z"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*names).schema)
    return blocks.mapInArrow(run, f"{fields}, V_u_x array<double>, V_u_y array<double>, V_u_z array<double>")


def transport_velocity(u1, u2, u3, r, theta, phi, mass: float):
    """The numpy twin of ``geometry.transport_velocity``."""
    lapse2 = np.where(r > 0, 1 - 2 * mass / np.where(r > 0, r, 1), np.nan)
    sin, cos = np.sin(theta), np.cos(theta)
    with np.errstate(invalid="ignore", divide="ignore"):
        lorentz = np.sqrt(1 + u1 * u1 / lapse2 + (r * u2) ** 2 + (r * sin * u3) ** 2)
        factor = np.where(lapse2 > 0, np.sqrt(lapse2) / lorentz, np.nan)
    vr, vt, vp = factor * u1, factor * r * u2, factor * r * sin * u3
    across = vr * sin + vt * cos
    return across * np.cos(phi) - vp * np.sin(phi), across * np.sin(phi) + vp * np.cos(phi), vr * cos - vt * sin


def block_map(geometry: DataFrame, level: int) -> DataFrame:
    """BLOCK_MAP(s1, s2, s3, block_id) of blocks (block_id, level, l1, l2, l3): the slots of the finest level ``level``
    that each covers."""
    out = geometry.withColumn("__span", F.pow(F.lit(2.0), F.lit(level) - F.col("level")).cast("int"))
    for n in (1, 2, 3):
        out = out.withColumn(f"s{n}", F.explode(F.sequence(F.col(f"l{n}") * F.col("__span"), (F.col(f"l{n}") + 1) * F.col("__span") - 1)))
    return out.select("s1", "s2", "s3", "block_id")
