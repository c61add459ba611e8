import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions import geometry as g
from eddyline.operators import seeding
from eddyline.sources import vtk
from eddyline.sources.ascii import read_trajectories, write_trajectories


def snapshot(path, time, seed):
    r, th, ph = np.linspace(10, 50, 5), np.arccos(np.linspace(1, -1, 4)), np.linspace(0, 2 * np.pi, 6, endpoint=False)
    f = seed + r + 0.1 * th[:, None] + 0.01 * ph[:, None, None]
    vtk.write_snapshot(path, time, (r, th, ph), {"rho": f, "temp": 2 * f})
    return f


def test_snapshot_source_reads_only_wanted_keys(spark, tmp_path):
    fields = [snapshot(f"{tmp_path}/s{i}.vtk", float(i), i) for i in range(3)]
    spark.dataSource.register(vtk.SnapshotVtk)
    df = spark.read.format("snapshot_vtk").option("keys", "temp").load(f"{tmp_path}/*.vtk")
    assert df.count() == 3 * 120 and df.select("key").distinct().count() == 1
    row = df.where("time = 2.0 and i = 3 and j = 2 and k = 5").first()
    assert row.value == pytest.approx(2 * fields[2][5, 2, 3], rel=1e-6)


def test_snapshot_header_errors(tmp_path):
    p = tmp_path / "bad.vtk"
    p.write_bytes(b"# vtk DataFile Version 2.0\nx\nASCII\n")
    with pytest.raises(ValueError):
        vtk.read_header(str(p))
    with pytest.raises(FileNotFoundError):
        vtk.list_files(str(tmp_path), "*.none")
    snapshot(f"{tmp_path}/a.vtk", 1.0, 0)
    h = vtk.read_header(f"{tmp_path}/a.vtk")
    assert h.dims == (5, 4, 6) and h.time == 1.0 and [per for *_, per in h.scalars.values()] == [1, 1]


def test_scalars_of_several_components(spark, tmp_path):
    path = f"{tmp_path}/m.vtk"
    v = np.arange(4 * 2 * 2 * 2, dtype=">f4").reshape(16, 2)
    with open(path, "wb") as f:
        f.write(b"# vtk DataFile Version 2.0\ns\nBINARY\nDATASET STRUCTURED_GRID\nFIELD FieldData 1\nTIME 1 1 double\n" + np.array([2.0], ">f8").tobytes() + b"\nDIMENSIONS 4 2 2\nPOINT_DATA 16\n")
        f.write(b"SCALARS pair float 2\nLOOKUP_TABLE default\n" + v.tobytes() + b"\nVECTORS w float\n" + np.zeros(48, ">f4").tobytes() + b"\nSCALARS one double\nLOOKUP_TABLE default\n" + np.arange(16, dtype=">f8").tobytes() + b"\n")
    spark.dataSource.register(vtk.SnapshotVtk)
    rows = spark.read.format("snapshot_vtk").load(path).toPandas()
    assert sorted(set(rows.key)) == ["one", "pair:0", "pair:1"] and rows[rows.key == "pair:1"].sort_values(["k", "j", "i"]).value.tolist() == v[:, 1].tolist()
    assert rows[rows.key == "one"].sort_values(["k", "j", "i"]).value.tolist() == list(range(16))


def test_landing(spark, tmp_path):
    from eddyline.jobs.land import grid_of, insane, land

    n_r, n_th, n_ph = 5, 4, 6
    r, th, ph = np.geomspace(10, 50, n_r), np.arccos(np.linspace(1, -1, n_th)), np.linspace(0, 2 * np.pi, n_ph, endpoint=False)
    base = lambda t: t + r + 0.1 * th[:, None] + 0.01 * ph[:, None, None]
    (tmp_path / "in").mkdir()
    for n, t in enumerate((0.0, 1.0)):
        bad = base(t).copy()
        bad[0, 0, :2] = np.inf, np.nan
        vtk.write_snapshot(f"{tmp_path}/in/a{n}.vtk", t, (r, th, ph), {"dens": bad, "|F|:2": base(t), "e:2": base(t)})
        vtk.write_snapshot(f"{tmp_path}/in/b{n}.vtk", t, (r, th, ph), {"|F|:3": 0 * base(t), "e:3": base(t) * 1e6})
    vtk.write_snapshot(f"{tmp_path}/in/c1.vtk", 1.0, (r, th, ph), {"e:2": base(1.0) + 7})
    path = f"{tmp_path}/in/*.vtk"
    grid, flipped = grid_of(spark, path)
    assert (grid.polar, grid.node_centred, flipped, grid.shape) == ("mu", True, True, (n_r, n_th, n_ph)) and np.allclose(grid.axes[1], np.linspace(-1, 1, n_th))
    keys = ["rho", "F_nux", "eps_nux"]
    times, field = land(spark, path, keys, f"{tmp_path}/field", flipped=flipped, n_theta=n_th)
    assert [tuple(x) for x in times.orderBy("time_idx").collect()] == [(0, 0.0), (1, 1.0)] and field.count() == 2 * n_r * n_th * n_ph
    at = lambda t, i, j, k: field.where((F.col("time_idx") == t) & (F.col("i") == i) & (F.col("j") == j) & (F.col("k") == k)).first()
    row = at(1, 3, 1, 5)
    want = base(1.0)[5, n_th - 2, 3]
    assert row.rho == pytest.approx(want, rel=1e-6) and row.F_nux == pytest.approx(want, rel=1e-6) and row.eps_nux == pytest.approx(want + 7, rel=1e-6)
    assert at(0, 0, n_th - 1, 0).rho == at(0, 1, n_th - 1, 0).rho == 0
    bad = {(r.path[-6:], r.key): r.n for r in insane(spark, path, keys).collect()}
    assert bad[("a0.vtk", "dens")] == 2 and bad[("b1.vtk", "e:3")] == n_r * n_th * n_ph
    with pytest.raises(KeyError):
        land(spark, path, ["T"], f"{tmp_path}/none")


@pytest.mark.parametrize("kind", ["volume", "surface"])
def test_command_line_from_files_to_histories(spark, tmp_path, kind):
    from eddyline.jobs import run as job

    n_th, n_ph = 8, 16
    r, th, ph = np.geomspace(1, 6, 16), (np.arange(n_th) + 0.5) * np.pi / n_th, np.linspace(0, 2 * np.pi, n_ph, endpoint=False)
    one = np.ones((n_ph, n_th, len(r)))
    sin, cos = np.sin(th)[:, None], np.cos(th)[:, None]
    v = {"win_Vx": 0.5 * sin * np.cos(ph)[:, None, None] * one, "win_Vy": 0.5 * sin * np.sin(ph)[:, None, None] * one, "win_Vz": 0.5 * cos * one}
    (tmp_path / "in").mkdir()
    for n in range(4):
        vtk.write_snapshot(f"{tmp_path}/in/s{n}.vtk", 0.5 * n, (r, th, ph), {"dens": one * (2 if kind == "volume" else 1), **v})
    more = ["--r-min", "1.5", "--r-max", "3", "--n-r", "2"] if kind == "volume" else ["--r-surf", "2"]
    common = ["--start-t", "0", "--end-t", "1.5", "--keys", "rho", "V_u_x", "V_u_y", "V_u_z", "--integrator", "expl_trap", kind, *more, "--n-th", "3", "--n-ph", "4"]
    a = job.parsed(["--data-dir", f"{tmp_path}/in", "--output-dir", f"{tmp_path}/out", *common])
    traj, props = job.run(spark, a)
    n = 24 if kind == "volume" else 36
    assert props.count() == n and {r.status for r in props.collect()} <= {"active", "done"}
    ends = traj.withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).groupBy("tracer_id").agg(F.min_by("r", "time").alias("a"), F.max_by("r", "time").alias("b"), (F.max("time") - F.min("time")).alias("t")).toPandas()
    assert len(ends) == n and np.allclose(ends.b - ends.a, 0.5 * ends.t, atol=0.05)
    total = props.agg(F.sum("mass_quad")).first()[0]
    assert total == pytest.approx(2 * 4 / 3 * np.pi * (27 - 1.5**3) if kind == "volume" else 16 * np.pi * 0.5 * 1.5, rel=1e-2)
    if kind == "surface":  # seeds that start at three snapshots, all steps in one job
        again, _ = job.run(spark, job.parsed(["--data-dir", f"{tmp_path}/in", "--output-dir", f"{tmp_path}/together", "--steps-a-job", "3", *common]))
        by = ["tracer_id", "time_idx"]
        pd.testing.assert_frame_equal(traj.toPandas().sort_values(by, ignore_index=True), again.toPandas().sort_values(by, ignore_index=True), check_exact=True)
    with pytest.raises(SystemExit):
        job.parsed(["--data-dir", "x", "--steps-a-job", "0", *common])
    with pytest.raises(SystemExit):
        job.parsed(["--data-dir", "x", "--start-t", "0", "--end-t", "1", "--keys", "rho", "volume", *more, "--n-th", "3", "--n-ph", "4"])


def test_polar_axis_kinds():
    n = 8
    half = vtk.polar_axis((np.arange(n) + 0.5) * np.pi / n)
    assert (half.kind, half.flipped, half.node_centred) == ("theta", False, False) and np.diff(half.nodes) == pytest.approx(np.pi / n)
    mu = vtk.polar_axis(np.arccos(np.linspace(1, -1, n)))
    assert (mu.kind, mu.flipped, mu.node_centred) == ("mu", True, True) and mu.nodes[0] == -1 and mu.nodes[-1] == pytest.approx(1)
    assert vtk.polar_axis(np.linspace(np.pi, 0, n)).flipped
    for bad in ([0.1, 0.5, 0.6, 2.0], np.linspace(0.3, 2.0, 5)):
        with pytest.raises(ValueError):
            vtk.polar_axis(np.array(bad))
    with pytest.raises(ValueError):
        vtk.even_azimuth([0.0, 1.0, 2.0])


def test_grids_that_arent_made_of_lines(spark):
    rows = [(k, i, j, m, float((i, j, m)[n] + (0.1 * j if k == "@r" else 0))) for n, k in enumerate(("@r", "@theta", "@phi")) for i in range(2) for j in range(2) for m in range(2)]
    df = spark.createDataFrame(rows, "key string, i int, j int, k int, value double")
    with pytest.raises(ValueError, match="r depends"):
        vtk.grid_axes(df)
    assert vtk.grid_axes(df.withColumn("value", F.floor("value").cast("double"))) == ([0.0, 1.0],) * 3


def test_trajectory_text_round_trip(spark, tmp_path):
    traj = spark.createDataFrame(pd.DataFrame({"tracer_id": [1, 1, 2], "time": [1.0, 0.5, 0.0], "x": [0.1, 0.2, np.nan], "rho": [1e-30, 2.0, 3.0]}))
    props = spark.createDataFrame([(1, 2.5, "done"), (2, 1.0, "active")], "tracer_id long, mass double, status string")
    files = write_trajectories(traj, props, str(tmp_path), ["x", "rho"])
    assert sorted(r["rows"] for r in files.collect()) == [1, 2]
    (tmp_path / "tracer_000009.dat").write_text("broken")
    back = read_trajectories(spark, f"{tmp_path}/*.dat", ["x", "rho"], ["done"]).orderBy("time").collect()
    from eddyline.sources.ascii import broken_files

    assert [r.filename[-17:] for r in broken_files(spark, f"{tmp_path}/*.dat", ["x", "rho"]).collect()] == ["tracer_000009.dat"]
    with pytest.raises(ValueError, match="no trajectory"):
        read_trajectories(spark, f"{tmp_path}/*.dat", ["nothing"], some=True)
    assert [(r.time, r.x, r.rho) for r in back] == [(0.5, 0.2, 2.0), (1.0, 0.1, 1e-30)] and back[0].props["mass"] == "2.5"


def test_shell_mass_and_surface_flux(spark):
    specs = spark.createDataFrame([(0, 1.0, 3.0)], "spec_id long, r_min double, r_max double")
    cells = seeding.volume_cells(specs, 4, 5, 6)
    for density, want in [(lambda r, t, p: r * 0 + 1, 4 / 3 * np.pi * 26), (lambda r, t, p: r, np.pi * 80), (lambda r, t, p: r * r, 4 / 5 * np.pi * 242)]:
        total = seeding.volume_masses(cells, density, 4).agg({"mass": "sum"}).first()[0]
        assert total == pytest.approx(want, rel=1e-5)
    sphere = seeding.surface_cells(spark.createDataFrame([(0, 2.0)], "spec_id long, radius double"), 4, 6)
    slots = spark.createDataFrame([(0, 0, 0.0, 2, 1.0), (0, 0, 1.0, 2, 1.0)], "spec_id long, slot int, time double, n_files int, dt double")
    total = seeding.surface_masses(sphere, slots, lambda r, m, p, t: r * 0 + 1, 5).agg({"mass": "sum"}).first()[0]
    assert total == pytest.approx(16 * np.pi, rel=1e-10)


@pytest.mark.parametrize("node", [False, True])
def test_ghost_cells_continue_a_smooth_function(spark, node):
    n_th, n_ph = 16, 32
    th = np.arange(n_th) * np.pi / (n_th - 1) if node else (np.arange(n_th) + 0.5) * np.pi / n_th
    step = th[1] - th[0]
    rows = spark.range(0, (n_th + 6) * (n_ph + 6)).select((F.floor(F.col("id") / (n_ph + 6)) - 3).alias("j"), (F.col("id") % (n_ph + 6) - 3).alias("k"))
    rows = rows.select("j", "k", *(c.alias(n) for c, n in zip(g.ghost_cell(F.col("j"), F.col("k"), n_th, n_ph, node), ("a", "b")))).toPandas()
    f = lambda t, p: np.sin(t) * np.cos(p) + 0.5 * np.cos(t) + 0.25 * np.sin(t) ** 2 * np.sin(2 * p)
    assert np.allclose(f(th[0] + step * rows.j, 2 * np.pi * rows.k / n_ph), f(th[rows.a.astype(int)], 2 * np.pi * rows.b / n_ph))


def test_field_masses_within_limits(spark):
    from tests.test_advance import sampled
    from eddyline.functions.grid import Grid

    grid = Grid((tuple(np.linspace(0.8, 3.2, 25)), tuple((np.arange(16) + 0.5) * np.pi / 16), tuple(np.arange(32) * 2 * np.pi / 32)))
    er = lambda p: p / np.sqrt((p * p).sum(0))
    field = spark.createDataFrame(sampled(grid, [0.0, 1.0, 2.0], lambda p, t: {"rho": np.sqrt((p * p).sum(0)), **dict(zip(("vx", "vy", "vz"), er(p), strict=True))}))
    spec = spark.createDataFrame([(0, 1.0, 3.0)], "spec_id long, r_min double, r_max double")
    total = lambda **k: seeding.summed(seeding.volume_nodes(seeding.volume_cells(spec, 4, 5, 6, **k), 4).withColumn("time_idx", F.lit(0)), field, grid, "rho").agg(F.sum("mass")).first()[0]
    assert total() == pytest.approx(80 * np.pi, rel=1e-5)
    halves = [total(limits=(0.0, 180.0, a, a + 180.0)) for a in (0.0, 180.0)], [total(limits=(a, a + 90.0, 0.0, 360.0)) for a in (0.0, 90.0)]
    assert all(sum(h) == pytest.approx(80 * np.pi, rel=1e-5) and h[0] == pytest.approx(40 * np.pi, rel=1e-5) for h in halves)
    sphere = seeding.surface_cells(spark.createDataFrame([(0, 2.0)], "spec_id long, radius double"), 4, 6)
    slots = spark.createDataFrame([(0, 0, 0, 2, 2.0), (0, 0, 1, 2, 2.0)], "slot int, i_start int, time_idx int, n_files int, dt double")
    flux = seeding.summed(seeding.surface_nodes(sphere, slots, 5), field, grid, "rho", ["vx", "vy", "vz"], ("tracer_id", "slot")).agg(F.sum("mass")).first()[0]
    assert flux == pytest.approx(16 * np.pi * 2 * 2, rel=1e-3)
    times = spark.createDataFrame([(0, 0.0), (1, 1.0)], "time_idx int, time double")
    seeds = seeding.surface_seeds(sphere, slots, times, jitter=3).toPandas()
    assert len(seeds) == 24 and set(seeds.t0) == {0.0, 1.0} and np.allclose(np.sqrt(seeds.x**2 + seeds.y**2 + seeds.z**2), 2)
    with pytest.raises(ValueError):
        seeding.volume_cells(spec, 1, 1, 1, (90.0, 10.0, 0.0, 360.0))
