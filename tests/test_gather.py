import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions import geometry as g
from eddyline.functions.keys import key_specs, renamed
from eddyline.functions.grid import Block, Grid
from eddyline.operators import catalog, gather, history, meshblock, tiles
N = 8
AXIS = [float(i) for i in range(N)]


@pytest.fixture(scope="module")
def field(spark):
    place = [(F.floor(F.col("id") / d) % N).cast("int").alias(n) for n, d in (("i", N * N), ("j", N), ("k", 1))]
    return spark.range(N**3).select(F.lit(0).alias("time_idx"), *place).withColumn("v", (F.col("i") + 2 * F.col("j") + 3 * F.col("k")).cast("double"))


def points(spark, rows):
    return spark.createDataFrame([(n, 0, *map(float, r), *map(float, r)) for n, r in enumerate(rows)], "point_id long, time_idx int, fi double, fj double, fk double, q_i double, q_j double, q_k double")


def test_linear_field_is_met_exactly_and_outside_is_nan(spark, field):
    rows = [(2.3, 3.9, 4.1), (1, 2, 3), (5.99, 1.01, 3.5), (0.2, 3, 3), (9.5, 3, 3), (-3, 1, 1)]
    p = points(spark, rows)
    want = [a + 2 * b + 3 * c for a, b, c in rows]
    linear = gather.gather_linear(p, field, ["v"]).orderBy("point_id").toPandas().v
    grid = Grid((tuple(AXIS),) * 3, spherical=False)
    by = lambda method: tiles.gather(p, field, grid, ["v"], method, place=("fi", "fj", "fk"), kind="coordinates", size=3).orderBy("point_id").toPandas().v
    assert np.allclose(linear[:4], want[:4]) and np.isnan(linear[4:]).all()
    assert np.allclose(by("pchip")[:4], want[:4]) and np.isnan(by("pchip")[4:]).all()
    assert np.allclose(by("linear")[:4], want[:4]) and np.allclose(by("regular_pchip")[:4], want[:4]) and by("nearest")[0] == 2 + 8 + 12
    assert gather.gather_nearest(p, field, ["v"]).orderBy("point_id").toPandas().v[0] == 2 + 8 + 12


def test_periodic_and_polar_stencils_need_no_copies(spark):
    n_th, n_ph = 6, 12
    f = lambda j, k: np.sin((j + 0.5) * np.pi / n_th) * np.cos(2 * np.pi * k / n_ph)
    cells = [(0, i, j, k, float(f(j, k))) for i in range(4) for j in range(n_th) for k in range(n_ph)]
    df = spark.createDataFrame(cells, "time_idx int, i int, j int, k int, v double")
    rows = [(1.0, -0.5, 0.0), (1.0, 2.0, 11.5), (1.0, 5.4, 3.0)]
    got = gather.gather_linear(points(spark, rows), df, ["v"], n_theta=n_th, n_phi=n_ph).orderBy("point_id").toPandas().v
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx((f(2, 11) + f(2, 0)) / 2) and not np.isnan(got[2])


def test_cubic_end_cells_by_hand():
    grid = Grid(((0.0, 1.0, 3.0, 4.0), (0.0, 1.0, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0)), spherical=False)
    v = np.array([1.0, 2.0, 8.0, 9.0])[None, :, None, None] * np.ones((1, 4, 4, 4))
    block = Block(grid, (0, 0, 0), v)
    m = np.array([1.0, 3.0, 1.0])
    d0 = ((2 * 1 + 2) * m[0] - 1 * m[1]) / 3
    d1 = 3 * (1 + 2) / ((2 * 2 + 1) / m[0] + (2 + 2 * 1) / m[1])
    want = 1 * (1 + 2 * 0.5) * 0.25 + 2 * (3 - 1) * 0.25 + 1 * (d0 * 0.125 - d1 * 0.125)
    got, stray = block.at(np.array([[0.5, 3.5, 0.0, 4.0, 4.1], [1.5] * 5, [1.5] * 5]))
    assert got[0, 0] == pytest.approx(want) and got[0, 2] == 1 and got[0, 3] == 9 and np.isnan(got[0, 4]) and not stray.any()
    assert got[0, 0] + got[0, 1] == pytest.approx(10)  # the mirror image


@pytest.mark.parametrize("node", [False, True])
@pytest.mark.parametrize("polar", ["theta", "mu"])
def test_spherical_gather_over_poles_and_seam(spark, node, polar):
    n_th, n_ph = 24, 48
    at = np.arange(n_th) / (n_th - 1) if node else (np.arange(n_th) + 0.5) / n_th
    grid = Grid((tuple(np.linspace(0.5, 2.5, 9)), tuple(np.pi * at if polar == "theta" else 2 * at - 1), tuple(np.arange(n_ph) * 2 * np.pi / n_ph)), polar=polar, node_centred=node)
    i, j, k = (m.ravel() for m in np.meshgrid(*map(range, grid.shape), indexing="ij"))
    r, b, c = (np.array(grid.axes[a])[x] for a, x in enumerate((i, j, k)))
    th = b if polar == "theta" else np.arccos(b)
    f = lambda r, th, ph: r * (1 + 0.3 * np.sin(th) * np.cos(ph))
    field = spark.createDataFrame(pd.DataFrame({"time_idx": np.int32(0), "i": i.astype(np.int32), "j": j.astype(np.int32), "k": k.astype(np.int32), "v": f(r, th, c), "r": r}))
    rng = np.random.default_rng(3)
    q = np.stack([rng.uniform(0.5, 2.5, 60), rng.uniform(0.5 if polar == "mu" else 0.01, 2.6 if polar == "mu" else 3.13, 60), rng.uniform(0, 2 * np.pi, 60)])
    q[0, 0], q[0, 1] = 0.4, 2.6
    p = pd.DataFrame({"point_id": range(60), "time_idx": np.int32(0), "x": q[0] * np.sin(q[1]) * np.cos(q[2]), "y": q[0] * np.sin(q[1]) * np.sin(q[2]), "z": q[0] * np.cos(q[1])})
    got = tiles.gather(spark.createDataFrame(p), field, grid, ["v", "r"], size=6).orderBy("point_id").toPandas()
    assert np.isnan(got.v[:2]).all() and np.allclose(got.v[2:], f(*q)[2:], atol=2e-2) and np.allclose(got.r[2:], q[0, 2:])


def test_crowded_tiles_are_dealt_in_shares(spark, field, monkeypatch):
    monkeypatch.setattr(tiles, "SHARE", 7)
    p = points(spark, [(2 + 0.01 * n, 3, 4) for n in range(60)] + [(99, 0, 0)] * 20)
    got = tiles.gather(p, field, Grid((tuple(AXIS),) * 3, spherical=False), ["v"], "linear", place=("fi", "fj", "fk"), kind="coordinates", size=4).toPandas()
    assert len(got) == 80 and np.isnan(got.v[got.point_id >= 60]).all() and np.allclose(got[got.point_id < 60].sort_values("point_id").v, [20 + 0.01 * n for n in range(60)])


def test_blocks(spark):
    blocks = spark.createDataFrame([(0, AXIS, AXIS, AXIS, [1.0] * N**3)], "block_id int, x1v array<double>, x2v array<double>, x3v array<double>, data array<double>")
    p = spark.createDataFrame([(0, 0, 3.5, 3.5, 3.5), (1, 0, 30.0, 3.5, 3.5), (2, 7, 3.5, 3.5, 3.5), (3, None, 3.5, 3.5, 3.5)], "point_id long, block_id int, x1 double, x2 double, x3 double")
    got = meshblock.gather_blocks(p, blocks).orderBy("point_id").toPandas().data
    assert len(got) == 4 and got[0] == 1 and np.isnan(got[1:]).all()


def test_landed_blocks_are_monotone_and_flow_evenly_over_the_pole(spark):
    g, x1, x3 = 2, [10.0, 11.0, 12.0, 13.0], [0.1, 0.2, 0.3, 0.4]
    faces = [(n - g) * 0.1 for n in range(9)]
    true = [(n - g + 0.5) * 0.1 for n in range(8)]
    stored = [0.15, 0.05, *true[2:]]
    v = (0.1, -0.2, 0.15)
    u = [[], [], []]
    for ph in x3:
        for n, th in enumerate(true):
            for r in x1:
                er, et, ep = (np.sin(th) * np.cos(ph), np.sin(th) * np.sin(ph), np.cos(th)), (np.cos(th) * np.cos(ph), np.cos(th) * np.sin(ph), -np.sin(th)), (-np.sin(ph), np.cos(ph), 0)
                w = 1 / np.sqrt(1 - np.dot(v, v))
                parts = w * np.dot(v, er), w * np.dot(v, et) / r, w * np.dot(v, ep) / (r * np.sin(th)) * (-1 if n < g else 1)
                for mine, x in zip(u, parts, strict=True):
                    mine.append(float(x))
    df = spark.createDataFrame([(0, x1, stored, x3, faces, *u)], "block_id int, x1v array<double>, x2v array<double>, x3v array<double>, x2f array<double>, u1 array<double>, u2 array<double>, u3 array<double>")
    row = meshblock.landed(df, g, 0.0).first()
    assert np.allclose(row.x2v, true) and all(np.allclose(row[k], x) for k, x in zip(("V_u_x", "V_u_y", "V_u_z"), v, strict=True))
    with pytest.raises(Exception, match="don't rise"):
        meshblock.landed(df.withColumn("x1v", F.reverse("x1v")), g).collect()


def test_block_map_of_an_octree(spark):
    roots = [(n, 0, n // 4, n // 2 % 2, n % 2) for n in range(1, 8)]
    fine = [(8 + n, 1, n // 4, n // 2 % 2, n % 2) for n in range(8)]
    got = {(r.s1, r.s2, r.s3): r.block_id for r in meshblock.block_map(spark.createDataFrame(roots + fine, "block_id int, level int, l1 int, l2 int, l3 int"), 1).collect()}
    assert len(got) == 64 and got[(0, 0, 0)] == 8 and got[(1, 1, 1)] == 15 and got[(2, 2, 2)] == got[(3, 3, 3)] == 7


def test_slot_windows(spark):
    times = spark.createDataFrame([(n, float(t)) for n, t in enumerate((0, 1, 2, 4, 5, 8, 9))], "time_idx int, time double")
    make = lambda ts: spark.createDataFrame([(n, float(t)) for n, t in enumerate(ts)], "order long, t_start double")
    ahead = [tuple(r) for r in catalog.slot_windows(times, make([0.2, 2.9, 9])).orderBy("slot", "time_idx").collect()]
    assert ahead == [(0, 0, 0, 2, 2.0), (0, 0, 1, 2, 2.0), (1, 2, 2, 4, 7.0), (1, 2, 3, 4, 7.0), (1, 2, 4, 4, 7.0), (1, 2, 5, 4, 7.0)]
    back = [tuple(r) for r in catalog.slot_windows(times, make([9, 3.2, 0])).orderBy("slot", "time_idx").collect()]
    assert [r[:3] for r in back] == [(0, 6, 4), (0, 6, 5), (0, 6, 6), (1, 3, 1), (1, 3, 2), (1, 3, 3)]
    for bad, what in (([0.1, 0.2], "one snapshot"), ([-3, 2], "outside"), ([0, 9.5], "outside")):
        with pytest.raises(Exception, match=what):
            catalog.slot_windows(times, make(bad)).collect()


def test_equal_seeds_stay_apart(spark):
    times = spark.createDataFrame([(0, 0.0), (1, 1.0)], "time_idx int, time double")
    s = spark.createDataFrame([(1, 0.2), (1, 0.2), (2, None), (3, 9.0)], "tracer_id long, t0 double")
    assert sorted((r.tracer_id, r.time_idx) for r in catalog.nearest_time(s, times, 1.0).collect() if r.time_idx is not None) == [(1, 0), (1, 0)] and catalog.nearest_time(s, times, 1.0).count() == 4


def test_transforms_and_errors(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (100.0,)], "r double")
    log = [r[0] for r in df.select(g.transformed(F.col("r"), "log")).collect()]
    assert np.isnan(log[0]) and np.isnan(log[1]) and log[2] == 2
    with pytest.raises(ValueError):
        g.transformed(F.col("r"), "cube")
    with pytest.raises(ValueError):
        g.transformed(F.col("r"), "asinh")
    faces = spark.range(1).select(g.root_faces(1.0, 16.0, 2.0, 4).alias("a"), g.root_faces(0.0, 1.0, 1.0, 4).alias("b")).first()
    assert np.allclose(faces.a, [1, 2, 4, 8, 16]) and np.allclose(faces.b, [0, 0.25, 0.5, 0.75, 1])


def test_transport_velocity_is_flat_without_a_mass(spark):
    df = spark.createDataFrame([(0.3, 0.0, 0.0, 2.0, np.pi / 2, 0.0), (0.1, 0.0, 0.0, 1.0, 1.0, 1.0)], "u1 double, u2 double, u3 double, r double, th double, ph double")
    v = g.transport_velocity(*map(F.col, ("u1", "u2", "u3", "r", "th", "ph")), 0.0)
    row = df.select(*(c.alias(n) for c, n in zip(v, "xyz", strict=True))).first()
    assert row.x == pytest.approx(0.3 / np.sqrt(1.09)) and row.y == pytest.approx(0)
    inside = df.select(g.transport_velocity(*map(F.col, ("u1", "u2", "u3", "r", "th", "ph")), 5.0)[0].alias("x")).first()
    assert np.isnan(inside.x)


def test_key_specs():
    keys = ["rho", "other", "F_nux", "F_anux", "eps_nux", "eps_anux"]
    kinds = {h: [(s.key, s.kind) for s in key_specs(keys, heavy=h)] for h in ("sum", "drop", "separate")}
    assert kinds["sum"] == [("rho", "direct"), ("other", "direct"), ("F_nux", "sum"), ("eps_nux", "weighted_mean")]
    assert kinds["drop"] == [("rho", "direct"), ("other", "direct")] and kinds["separate"] == [(k, "direct") for k in keys]
    assert key_specs(["eps_nux"])[0].raw == ("|F|:2", "e:2", "|F|:3", "e:3") and key_specs(["other"])[0].raw == ("other",)
    with pytest.raises(ValueError):
        key_specs([], heavy="both")


def test_combined_columns(spark):
    df = spark.createDataFrame([(1.0, 10.0, 3.0, 20.0), (0.0, 5.0, 0.0, 7.0)], "`|F|:2` double, `e:2` double, `|F|:3` double, `e:3` double")
    rows = df.select(*(s.column() for s in key_specs(["F_nux", "eps_nux"]))).collect()
    assert [tuple(r) for r in rows] == [(4.0, 17.5), (0.0, 0.0)]


def test_renamed(spark):
    df = renamed(spark.createDataFrame([(1.0, 2.0)], "`e:0` double, other double"))
    assert df.columns == ["eps_nue", "other"]


@pytest.fixture(scope="module")
def traj(spark):
    return spark.createDataFrame([(0, 0.0, 0.5, 9.0), (0, 1.0, 2.5, 4.0), (0, 2.0, 3.0, 1.0), (1, 0.0, 5.0, 3.0), (1, 1.0, 1.0, 7.0), (2, 0.0, 0.1, 1.0)], "tracer_id long, time double, r double, temp double")


def test_crossings_and_cooling(traj):
    c = {r.tracer_id: r.t_cross for r in history.first_crossing(traj, 1.5).collect()}
    assert c == {0: 0.5, 1: 0.0}
    v = {r.tracer_id: r.value for r in history.value_when_cooled(traj, 5.0, "r").collect()}
    assert v == {0: pytest.approx(0.5 + 2.0 * 0.8)}
    tau = history.expansion_time(traj.withColumnRenamed("temp", "rho")).where("tracer_id = 2").first().tau
    assert np.isnan(tau)


def test_mass_outside_agrees_with_the_grid(spark, traj):
    props = spark.createDataFrame([(0, 1.0), (1, 10.0), (2, 100.0)], "tracer_id long, mass double")
    grid = history.held_to_times(traj, traj).join(props, "tracer_id").groupBy("time").agg(F.sum(F.when(F.col("r") >= 1.0, F.col("mass")).otherwise(0.0)).alias("mass"))
    assert {r.time: r.mass for r in history.mass_outside(traj, props, 1.0).collect()} == {r.time: r.mass for r in grid.collect()} == {0.0: 10.0, 1.0: 11.0, 2.0: 11.0}


def test_latest_density_mass(spark):
    t = spark.createDataFrame(pd.DataFrame({"tracer_id": [0, 0, 0, 1, 1, 1], "time": [0.0, 1, 2, 2, 1, 0], "rho": [1.0, 2, 4, 1, 2, 4]}))
    p = spark.createDataFrame([(0, 1.0, 10.0), (1, 1.0, 10.0), (2, 1.234, None)], "tracer_id long, mass double, dV double")
    assert {r.tracer_id: (r.mass, r.mass_quad) for r in history.latest_density_mass(t, p).collect()} == {0: (40.0, 1.0), 1: (10.0, 1.0), 2: (1.234, 1.234)}


def test_masses_read_the_snapshots_and_cut_the_tiles_that_nodes_are_in(spark, tmp_path):
    from eddyline.functions.grid import Grid
    from eddyline.operators import seeding, tiles
    from tests.test_advance import sampled

    side = tuple(float(i) for i in range(24))
    grid = Grid((side,) * 3, spherical=False)
    spark.createDataFrame(sampled(grid, [0.0, 1.0, 2.0], lambda p, t: {"rho": 1 + p[0] + t, "vx": p[1]})).write.partitionBy("time_idx").parquet(f"{tmp_path}/field")
    field = spark.read.parquet(f"{tmp_path}/field")
    nodes = spark.createDataFrame([(7, 1, 5.0, 5.0, 5.0, 2.0), (7, 1, 6.0, 5.0, 5.0, 1.0)], "tracer_id long, time_idx int, x double, y double, z double, w double")
    mass = seeding.summed(nodes, field, grid, "rho", method="linear", size=8)
    plan = mass._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("time_idx" in line.split("PartitionFilters: [")[1].split("]")[0].replace("isnotnull(time_idx", "") for line in scans) and not any("vx" in line for line in scans)
    assert mass.first()["mass"] == pytest.approx(2 * 7 + 8)
    only = spark.createDataFrame([(1, 0)], "time_idx int, tile long")
    cut = tiles.tiled(field, grid, ["rho"], 8, only=only).select("time_idx", "tile", F.size("p").alias("n")).collect()
    assert [(r.time_idx, r.tile, r.n) for r in cut] == [(1, 0, 10**3)]
