"""Refined blocks: which block holds a point, and particles whose stages cross faces, levels and a pole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions.flows import DiskWind, Uniform
from eddyline.functions.octree import Octree, faces
from eddyline.operators import advance, blockstep, tiles
from eddyline.shared import OtherRun

GHOSTS, INTERIOR, KEYS = 2, 8, ["vx", "vy", "vz"]


def octree(refined=((0, 0, 0), (1, 1, 2)), spherical=True):
    """2 x 2 x 4 root blocks of 8 cells, some of them cut in eight."""
    root = faces(0.5, 4.0, 1.05, 16), faces(0.0, np.pi, 1.0, 16), faces(0.0, 2 * np.pi, 1.0, 32)
    blocks = []
    for place in np.ndindex(2, 2, 4):
        if place in refined:
            blocks += [(1, *(2 * np.array(place) + d)) for d in np.ndindex(2, 2, 2)]
        else:
            blocks.append((0, *place))
    return Octree(root, (INTERIOR,) * 3, tuple((n, *map(int, b)) for n, b in enumerate(blocks)), spherical)


def nodes(tree, level, place):
    """Cell centres of a block along each axis, ghosts beyond its faces included."""
    out = []
    for a in range(3):
        f = np.array(tree.root[a])
        fine = np.concatenate([f[:-1, None] + (f[1:] - f[:-1])[:, None] * np.arange(1 << level) / (1 << level)], axis=0).ravel()
        fine = np.append(fine, f[-1])
        low, high = fine[1] - fine[0], fine[-1] - fine[-2]
        fine = np.concatenate([fine[0] - low * np.arange(GHOSTS, 0, -1), fine, fine[-1] + high * np.arange(1, GHOSTS + 1)])
        first = place[a] * INTERIOR
        mine = fine[first : first + INTERIOR + 2 * GHOSTS + 1]
        out.append((mine[1:] + mine[:-1]) / 2)
    return out


def block_rows(tree, times, flow):
    for n, t in enumerate(times):
        for block_id, level, *place in tree.blocks:
            x1, x2, x3 = nodes(tree, level, place)
            c, b, a = (m.ravel() for m in np.meshgrid(x3, x2, x1, indexing="ij"))  # x1 fastest
            p = np.stack([a * np.sin(b) * np.cos(c), a * np.sin(b) * np.sin(c), a * np.cos(b)]) if tree.spherical else np.stack([a, b, c])
            v = flow.velocity_np(p, t)
            yield {"time_idx": n, "block_id": block_id, "x1v": x1.tolist(), "x2v": x2.tolist(), "x3v": x3.tolist(), **{k: x.tolist() for k, x in zip(KEYS, v, strict=True)}, "rho": a.tolist()}


SCHEMA = "time_idx int, block_id long, " + ", ".join(f"{c} array<double>" for c in ("x1v", "x2v", "x3v", *KEYS, "rho"))
TIMES = [0.0, 0.1, 0.22, 0.3, 0.4]


@pytest.fixture(scope="module")
def wind(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('blocks')}/wind"
    spark.createDataFrame(list(block_rows(octree(), TIMES, DiskWind())), SCHEMA).write.partitionBy("time_idx").parquet(path)
    return octree(), spark.read.parquet(path)


def through(spark, tree, blocks, points, folder, scheme="expl_trap", start=0, end=4, **more):
    seeds = spark.createDataFrame([(i, *map(float, p), TIMES[start]) for i, p in enumerate(points)], "tracer_id long, x double, y double, z double, t0 double")
    got = advance.advance_snapshots(seeds, blocks, tree, TIMES, start, end, folder, ["rho"], KEYS, scheme, **more)
    return got.toPandas().sort_values(["tracer_id", "time_idx"]).reset_index(drop=True)


def test_each_point_has_the_block_whose_cells_hold_it():
    tree = octree()
    rng = np.random.default_rng(0)
    q = np.stack([rng.uniform(0.4, 4.1, 3000), rng.uniform(-0.1, 3.3, 3000), rng.uniform(-0.1, 6.4, 3000)])
    q[:, 0], q[:, 1], q[0, 2] = (4.0, np.pi, 2 * np.pi), (0.5, 0.0, 0.0), np.nan
    got = tree.find(q)
    for i in range(q.shape[1]):
        want = -1
        for block_id, level, *place in tree.blocks:
            inside = True
            for a in range(3):
                f, n = tree.root[a], INTERIOR >> level
                low, high = f[place[a] * n], f[(place[a] + 1) * n]
                inside &= bool(low <= q[a, i] < high or (q[a, i] == high == f[-1]))
            want = block_id if inside else want
        assert got[i] == want
    with pytest.raises(ValueError, match="once"):
        Octree(tree.root, tree.interior, tree.blocks[1:])
    with pytest.raises(ValueError, match="fit"):
        Octree(tree.root, (7, 8, 8), tree.blocks)


def test_steps_through_blocks_taken_together(spark, wind, tmp_path):
    tree, blocks = wind
    for scheme in ("impl_trap", "rk4"):
        alone = through(spark, tree, blocks, POINTS, f"{tmp_path}/{scheme}1", scheme)
        for together in (2, 4):
            pd.testing.assert_frame_equal(alone, through(spark, tree, blocks, POINTS, f"{tmp_path}/{scheme}{together}", scheme, together=together), check_exact=True)


def finely(flow, p, start, end, n=400):
    p = np.array(p, float).T
    for i in range(n):
        p = advance.runge_kutta(flow.velocity_np, p, start + (end - start) * i / n, (end - start) / n)
    return p


POINTS = [(1, 0, 0), (0.8, 0.3, 0.05), (-1.2, 0.4, 0.3), (0.1, -1, 0.01), (50, 0, 0), (0.9, 0.9, 0.9), (3.99, 0.1, 0)]


@pytest.mark.parametrize("scheme", ["expl_trap", "impl_trap", "rk4"])
def test_steps_through_blocks_follow_the_flow(spark, wind, tmp_path, monkeypatch, scheme):
    tree, blocks = wind
    got = through(spark, tree, blocks, POINTS, f"{tmp_path}/a", scheme)
    last = got[got.time_idx == 4].set_index("tracer_id")
    inside = [0, 1, 2, 3, 5]
    assert set(inside) <= set(last.index) and 4 not in last.index
    assert np.allclose(last.loc[inside, ["x", "y", "z"]].to_numpy().T, finely(DiskWind(), np.array(POINTS)[inside], 0, 0.4), atol=2e-3)
    read = got[got.rho.notna()]
    assert np.allclose(read.rho, np.sqrt(read.x**2 + read.y**2 + read.z**2), atol=1e-9) and len(read) >= 25
    monkeypatch.setattr(tiles, "SHARE", 1)
    pd.testing.assert_frame_equal(got, through(spark, tree, blocks, POINTS, f"{tmp_path}/b", scheme), check_exact=True)


def test_stages_cross_levels_and_a_pole(spark, tmp_path):
    tree, flow = octree(((0, 0, 0), (0, 0, 2), (1, 0, 0))), Uniform((4.0, 0.3, 0.1))
    blocks = spark.createDataFrame(list(block_rows(tree, TIMES, flow)), SCHEMA)
    points = [(-0.9, 0.01, 1.5), (-0.5, 0.0, 1.0), (-0.7, -0.2, 1.9), (0.8, 0.05, 1.0), (2.9, 0.1, 0.2)]
    for scheme in ("expl_trap", "rk4"):
        got = through(spark, tree, blocks, points, f"{tmp_path}/{scheme}", scheme)
        for i, p in enumerate(points):
            mine = got[got.tracer_id == i]
            want = np.array(p) + np.outer(mine.time, (4.0, 0.3, 0.1))
            assert np.allclose(mine[["x", "y", "z"]].to_numpy(), want, atol=1e-9)
        assert got.groupby("tracer_id").size().to_dict()[0] == 5 and got.groupby("tracer_id").size().to_dict()[4] < 5
    parts = spark.read.parquet(f"{tmp_path}/expl_trap/steps").where("status = 'again'")
    assert parts.count() > 0  # a predictor's velocity came from another block


def test_backward_and_in_another_folder(spark, wind, tmp_path):
    tree, blocks = wind
    ends = finely(DiskWind(), POINTS[:4], 0, 0.4).T
    got = through(spark, tree, blocks, ends, f"{tmp_path}/back", "rk4", 4, 0)
    assert np.allclose(got[got.time_idx == 0][["x", "y", "z"]].to_numpy(), np.array(POINTS)[:4], atol=2e-3)
    with pytest.raises(OtherRun, match="seeds"):
        through(spark, tree, blocks, ends[:2], f"{tmp_path}/back", "rk4", 4, 0)


def test_values_of_blocks_at_points(spark, wind):
    tree, blocks = wind
    points = spark.createDataFrame([(i, i % 5, *map(float, p)) for i, p in enumerate(POINTS)], "point_id long, time_idx int, x double, y double, z double")
    got = blockstep.gather(points, blocks, tree, ["rho", "vx"]).toPandas().set_index("point_id")
    r = np.sqrt((np.array(POINTS) ** 2).sum(1))
    for i, p in enumerate(POINTS):
        if r[i] < 4 and r[i] > 0.5:
            assert got.rho[i] == pytest.approx(r[i]) and got.vx[i] == pytest.approx(DiskWind().velocity_np(np.array(p, float)[:, None], TIMES[i % 5])[0, 0], abs=0.05)
        else:
            assert np.isnan(got.rho[i])
    plan = blockstep.gather(points.where("time_idx = 3"), blocks, tree, ["rho"])._jdf.queryExecution().toString()
    assert "time_idx" in plan.split("PartitionFilters: [")[-1].split("]")[0] and "x1v" in plan and "vy" not in plan.split("ReadSchema")[-1]
    assert blockstep.gather(points.where("false"), blocks, tree, ["rho"]).count() == 0
