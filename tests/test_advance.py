import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions.flows import BlastWave, DiskWind, Rotation, Uniform
from eddyline.functions.grid import Block, Grid
from eddyline.functions.stencil import end_slope, midpoint_weights, pchip4, pchip4_np
from eddyline.jobs.run import Engine
from eddyline.operators import advance, catalog
from eddyline.operators import tiles as tiling
from eddyline.shared import OtherRun


class Decay:
    def velocity_np(self, p, t):
        return -p


class Wall:
    def velocity_np(self, p, t):
        return np.where(p > 2, np.nan, 1.0)


def seeds(spark, points):
    return spark.createDataFrame([(i, *map(float, p), 0.0, "active") for i, p in enumerate(points)], "tracer_id long, x double, y double, z double, time double, status string")


@pytest.mark.parametrize(("scheme", "least"), [("euler", 0.9), ("expl_trap", 1.9), ("impl_trap", 1.9), ("rk4", 3.9)])
def test_convergence_order(scheme, least):
    errors = []
    for k in range(3, 7):
        p, n = np.ones((3, 1)), 2**k
        for i in range(n):
            p = advance.SCHEMES[scheme](Decay().velocity_np, p, i / n, 1 / n)
        errors.append(abs(p[0, 0] - math.exp(-1)))
    assert all(math.log2(a / b) > least for a, b in zip(errors, errors[1:]))


@pytest.mark.parametrize("mode", ["lagrange", "monotone"])
def test_snapshot_modes_of_runge_kutta_on_uneven_times(mode):
    flow, p = DiskWind(), np.array([[1.0, 0.8], [0.2, -0.9], [0.0, 0.0]])
    q, times = p, [0.0, 0.08, 0.2, 0.31, 0.39, 0.52, 0.6, 0.7, 0.83, 0.9, 1.0]
    for i in range(10):
        q = advance.runge_kutta(flow.velocity_np, q, times[i], times[i + 1] - times[i], mode, advance.around(times, i))
    assert np.allclose(q, flow.exact(p, 1.0), atol=1e-4)
    assert advance.around(times, 0) is None and advance.around(times, 9) is None and advance.around(times, 1) == times[:4]


def test_exact_disk_wind_and_columns_agree_with_tasks(spark):
    flow, points = DiskWind(), [(1, 0, 0), (0.5, 1, 0), (-1.2, 0.4, 0)]
    s, times = seeds(spark, points), [0.1 * i for i in range(11)]
    got = advance.advance_chunk(s, flow, times, "rk4", records_only_last=True).toPandas().sort_values("tracer_id")
    want = flow.exact(np.array(points, float).T, 1.0)
    assert np.allclose(got[["x", "y", "z"]].to_numpy().T, want, atol=1e-7)
    for scheme in ("euler", "expl_trap", "rk4"):
        a = advance.advance_chunk(s, flow, times[:4], scheme, records_only_last=True).toPandas().sort_values("tracer_id")
        b = advance.column_steps(s, flow, scheme, 0.1, 3).toPandas().sort_values("tracer_id")
        assert np.allclose(a[["x", "y", "z"]], b[["x", "y", "z"]], atol=1e-12)


def test_the_adaptive_path_is_exact_where_the_flow_is(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(-1.5, 1.5, (2, 40)), np.zeros((1, 40))])
    p[:, np.hypot(p[0], p[1]) < 0.3] = np.array([[1.0], [0.0], [0.0]])
    assert np.abs(advance.adaptive(DiskWind().velocity_np, p, np.zeros(40), 3.0) - DiskWind().exact(p, 3.0)).max() < 1e-10
    back = advance.adaptive(DiskWind().velocity_np, DiskWind().exact(p, 3.0), np.full(40, 3.0), 0.0)
    assert np.abs(back - p).max() < 1e-9
    got = advance.reference(seeds(spark, p.T), DiskWind(), [0.0, 0.5, 1.0, 3.0]).toPandas()
    for t, rows in got.groupby("time"):
        assert np.abs(rows.sort_values("tracer_id")[["x", "y", "z"]].to_numpy().T - DiskWind().exact(p, t)).max() < 1e-10
    assert len(got) == 160 and advance.reference(seeds(spark, [(1, 0, 0)]).withColumn("time", F.lit(0.7)), DiskWind(), [0.0, 0.5, 1.0]).count() == 1
    wall = advance.reference(seeds(spark, [(0, 0, 0), (-9, 0, 0)]), Wall(), [0.0, 1.0, 3.0, 5.0]).toPandas()
    assert wall.groupby("tracer_id").size().to_dict() == {0: 2, 1: 2}  # y and z rise too


def test_fixed_steps_against_the_adaptive_path_through_a_blast(spark):
    start = seeds(spark, [(0.5 + r * math.cos(a), 0.3 + r * math.sin(a), 0.0) for r in (0.2, 0.9, 1.7, 2.4) for a in (0.1, 2.0, 4.4)]).withColumn("time", F.lit(1.0))
    truth = advance.reference(start, BlastWave(), [2.0, 4.0]).toPandas().set_index(["tracer_id", "time"])[["x", "y", "z"]]
    errors = []
    for n in (30, 60, 120):
        times = [1 + 3 * i / n for i in range(n + 1)]
        got = advance.advance_chunk(start, BlastWave(), times, "rk4").where("abs(time - 2) < 1e-9 or abs(time - 4) < 1e-9").toPandas()
        got["time"] = got.time.round(6)
        errors.append(np.abs(got.set_index(["tracer_id", "time"])[["x", "y", "z"]] - truth).to_numpy().max())
    assert errors[0] < 1e-3 and errors[1] < errors[0] / 8 and errors[2] < errors[1] / 8


def test_partitions_and_chunks_change_nothing(spark, tmp_path):
    points = [(math.cos(a), math.sin(a), 0.1) for a in np.linspace(0, 6, 20)]
    s = seeds(spark, points).drop("time", "status")
    out = []
    for n, (parts, chunk) in enumerate([(1, 10), (5, 10), (3, 4), (2, 1)]):
        t = Engine(spark, f"{tmp_path}/{n}").integrate(s.repartition(parts), DiskWind(), 0.0, 1.0, 0.1, "impl_trap", chunk)
        out.append(t.toPandas().sort_values(["tracer_id", "time"]).reset_index(drop=True))
    for other in out[1:]:
        pd.testing.assert_frame_equal(out[0], other, check_exact=True)
    assert len(out[0]) == 20 * 11


def test_forward_then_backward(spark):
    s = seeds(spark, [(1, 0.5, 0.2)])
    ahead = advance.advance_chunk(s, Rotation(), [0.05 * i for i in range(21)], "rk4", records_only_last=True)
    back = advance.advance_chunk(ahead, Rotation(), [1 - 0.05 * i for i in range(21)], "rk4", records_only_last=True).first()
    assert np.allclose([back.x, back.y, back.z], [1, 0.5, 0.2], atol=1e-6)


def test_late_seeds_and_ends(spark, tmp_path):
    s = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, "active"), (1, 0.0, 0.0, 0.0, 2.0, "active"), (2, 0.0, 0.0, 0.0, 9.0, "active")], "tracer_id long, x double, y double, z double, time double, status string")
    rows = advance.advance_chunk(s, Uniform((1, 0, 0)), [0.0, 1.0, 2.0, 3.0], "euler").toPandas()
    assert rows.groupby("tracer_id").size().to_dict() == {0: 3, 1: 1}
    end = advance.advance_chunk(seeds(spark, [(0, 0, 0)]), Wall(), [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "euler", records_only_last=True).first()
    assert end.status == "done" and end.time == 3.0
    near = s.where("tracer_id < 2").withColumn("t0", F.col("time") + 1e-9).drop("time", "status")
    got = advance.advance(near, Uniform((1, 0, 0)), [0.0, 1.0, 2.0, 3.0], f"{tmp_path}/near", "euler", 2)
    last = {r.tracer_id: r.x for r in got.where("time = 3").collect()}
    assert last == {0: 3.0, 1: 1.0}
    state = {r.tracer_id: r.status for r in advance.statuses(s, got, 3.0).collect()}
    assert state == {0: "active", 1: "active", 2: "not started"}
    with pytest.raises(Exception, match="no snapshot at a seed's time"):
        advance.advance(near.withColumn("t0", F.lit(0.5)), Uniform((1, 0, 0)), [0.0, 1.0], f"{tmp_path}/far", "euler").count()


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    s = seeds(spark, [(1, 0, 0), (0.5, 1, 0)]).drop("time", "status").withColumn("t0", F.lit(0.0))
    times = [0.1 * i for i in range(9)]
    whole = advance.advance(s, DiskWind(), times, f"{tmp_path}/a", "rk4", 2).toPandas().sort_values(["tracer_id", "time"]).reset_index(drop=True)
    advance.advance(s, DiskWind(), times[:5], f"{tmp_path}/b", "rk4", 2).count()
    again = advance.advance(s, DiskWind(), times, f"{tmp_path}/b", "rk4", 2).toPandas().sort_values(["tracer_id", "time"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, again, check_exact=True)


def test_a_folder_of_another_run_is_an_error(spark, tmp_path):
    s = seeds(spark, [(1, 0, 0), (0.5, 1, 0)]).drop("time", "status").withColumn("t0", F.lit(0.0))
    times, at = [0.1 * i for i in range(5)], f"{tmp_path}/a"
    first = advance.advance(s, DiskWind(), times, at, "rk4", 2).count()
    assert advance.advance(s, DiskWind(), times, at, "rk4", 2).count() == first
    for change in (
        {"seeds": s.withColumn("x", F.col("x") * 100)}, {"flow": Rotation()}, {"times": times[:3]}, {"times": [0.2 * i for i in range(5)]}, {"scheme": "euler"}, {"chunk": 4},
    ):
        call = {"seeds": s, "flow": DiskWind(), "times": times, "folder": at, "scheme": "rk4", "chunk": 2} | change
        with pytest.raises(OtherRun, match="was .*, is "):
            advance.advance(**call)
    advance.advance(s, DiskWind(), times[:4], f"{tmp_path}/b", "rk4", 2)
    with pytest.raises(OtherRun, match="within a chunk"):
        advance.advance(s, DiskWind(), times, f"{tmp_path}/b", "rk4", 2)


def sampled(grid, times, values):
    """FIELD rows of ``values(positions (3, n), t)``, a dictionary of keys, on a grid's nodes."""
    index = np.stack([m.ravel() for m in np.meshgrid(*map(range, grid.shape), indexing="ij")])
    a, b, c = (np.array(grid.axes[n])[index[n]] for n in range(3))
    sin, cos = (np.sin(b), np.cos(b)) if grid.polar == "theta" else (np.sqrt(np.maximum(0, 1 - b * b)), b)
    p = np.stack([a * sin * np.cos(c), a * sin * np.sin(c), a * cos]) if grid.spherical else np.stack([a, b, c])
    return pd.concat([pd.DataFrame({"time_idx": np.int32(n), **{k: index[m].astype(np.int32) for m, k in enumerate("ijk")}, **values(p, t)}) for n, t in enumerate(times)])


@pytest.fixture(scope="module")
def wind(spark, tmp_path_factory):
    n_th, n_ph = 16, 32
    grid = Grid((tuple(np.geomspace(0.5, 4, 32)), tuple((np.arange(n_th) + 0.5) * np.pi / n_th), tuple(np.arange(n_ph) * 2 * np.pi / n_ph)), transform="log")
    times = [0.0, 0.1, 0.22, 0.3, 0.4]
    path = f"{tmp_path_factory.mktemp('field')}/wind.parquet"
    make = lambda p, t: {**dict(zip(("vx", "vy", "vz"), DiskWind().velocity_np(p, t), strict=True)), "rho": np.sqrt((p * p).sum(0))}
    sampled(grid, times, make).to_parquet(path)
    return grid, times, spark.read.parquet(path)


def through(spark, wind, points, t0, start, end, folder, scheme, size=8, **more):
    grid, times, field = wind
    s = spark.createDataFrame([(i, *map(float, p), float(t)) for i, (p, t) in enumerate(zip(points, t0, strict=True))], "tracer_id long, x double, y double, z double, t0 double")
    return advance.advance_snapshots(s, field, grid, times, start, end, folder, ["rho"], ["vx", "vy", "vz"], scheme, size=size, **more).toPandas().sort_values(["tracer_id", "time_idx"]).reset_index(drop=True)


POINTS = [(1, 0, 0), (0.8, 0.3, 0), (-1.2, 0.4, 0), (0.1, -1, 0), (50, 0, 0), (3.99, 0.1, 0)]


@pytest.mark.parametrize("scheme", ["expl_trap", "impl_trap", "rk4"])
def test_snapshots_carry_particles_where_the_flow_does(spark, wind, tmp_path, scheme):
    got = through(spark, wind, POINTS, [0, 0, 0, 0.22, 0, 0], 0, 4, f"{tmp_path}/f", scheme)
    p = np.array(POINTS, float).T
    last = got[got.time_idx == 4].set_index("tracer_id")
    assert sorted(last.index) == [0, 1, 2, 3] and np.allclose(last.loc[[0, 1, 2], ["x", "y", "z"]].to_numpy().T, DiskWind().exact(p[:, :3], 0.4), atol=1.5e-3)
    assert got.groupby("tracer_id").size().to_dict()[3] == 3 and got[got.tracer_id == 3].time.min() == 0.22
    inside = got[got.rho.notna()]
    assert np.allclose(inside.rho, np.sqrt(inside.x**2 + inside.y**2 + inside.z**2), atol=1e-4) and np.isnan(got[got.tracer_id == 4].rho).all()
    assert (got[got.tracer_id == 5].time_idx < 4).all()
    other = through(spark, wind, POINTS, [0, 0, 0, 0.22, 0, 0], 0, 4, f"{tmp_path}/g", scheme, size=64)
    pd.testing.assert_frame_equal(got, other, check_exact=True)
    back = through(spark, wind, last.loc[[0, 1], ["x", "y", "z"]].to_numpy(), [0.4, 0.4], 4, 0, f"{tmp_path}/h", scheme)
    ends = back[back.time_idx == 0].set_index("tracer_id")
    assert np.allclose(ends[["x", "y", "z"]].to_numpy(), np.array(POINTS)[:2], atol=2e-3)


def rounds(folder):
    """Jobs of a run that wrote rows: the parts of its steps."""
    return len(list(Path(folder).glob("steps/step=*/part=*")))


@pytest.mark.parametrize(("scheme", "start", "end", "options"), [("expl_trap", 4, 0, {}), ("impl_trap", 0, 4, {}), ("rk4", 4, 0, {}), ("rk4", 0, 4, {"mode": "lagrange"})])
def test_steps_taken_together_are_those_taken_alone(spark, wind, tmp_path, scheme, start, end, options, monkeypatch):
    points = [*POINTS, *(tuple(p) for p in np.random.default_rng(3).uniform(-1.5, 1.5, (40, 3)))]
    t0 = np.array([0.0, 0.1, 0.22, 0.3, 0.4])[np.arange(len(points)) % 5]  # some start at each snapshot, the last included
    alone = through(spark, wind, points, t0, start, end, f"{tmp_path}/1", scheme, **options)
    assert set(alone.time_idx) == set(range(5)) and alone[alone.tracer_id == 4].shape[0] == 1
    for together, share in ((3, 4), (9, tiling.SHARE)):
        monkeypatch.setattr(tiling, "SHARE", share)
        pd.testing.assert_frame_equal(alone, through(spark, wind, points, t0, start, end, f"{tmp_path}/{together}", scheme, together=together, **options), check_exact=True)
    assert len(list(Path(f"{tmp_path}/9").glob("steps/step=*"))) == 1 and rounds(f"{tmp_path}/9") <= rounds(f"{tmp_path}/1")
    with pytest.raises(ValueError, match="or more"):
        through(spark, wind, points, t0, 0, 4, f"{tmp_path}/none", scheme, together=0)


def test_particles_that_stay_need_one_job_for_all_their_steps(spark, wind, tmp_path):
    points, flown = [(1.5, 1.5, 0.3), (-1.5, 1.4, 0.2)], {}
    for together in (1, 4):
        flown[together] = through(spark, wind, points, [0, 0], 0, 4, f"{tmp_path}/{together}", "expl_trap", size=64, together=together)
    pd.testing.assert_frame_equal(flown[1], flown[4], check_exact=True)
    assert (rounds(f"{tmp_path}/1"), rounds(f"{tmp_path}/4")) == (4, 1)


def test_a_part_is_sent_from_its_latest_particle_on(spark):
    points = spark.createDataFrame([(0, 7, 3), (1, 7, 2), (2, 8, 4)], "tracer_id long, tile long, at int")
    rows = spark.createDataFrame([(t, n) for t in (7, 8, 9) for n in range(6)], "tile long, time_idx int")
    for way, want in ((1, {7: {1, 2, 3, 4, 5}, 8: {3, 4, 5}}), (-1, {7: {0, 1, 2, 3, 4}, 8: {0, 1, 2, 3, 4, 5}})):
        _, sent = tiling._dealt(points, rows, ["tile"], (F.col("at") * way - 1, F.col("time_idx") * way))
        got = {}
        for r in sent.collect():
            got.setdefault(r.tile, set()).add(r.time_idx)
        assert got == want


def test_snapshot_runs_into_a_folder_of_another_run(spark, wind, tmp_path):
    grid, times, field = wind
    s = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0)], "tracer_id long, x double, y double, z double, t0 double")
    call = {"seeds": s, "field": field, "grid": grid, "times": times, "start": 0, "end": 2, "folder": f"{tmp_path}/r", "keys": ["rho"], "vel_keys": ["vx", "vy", "vz"], "scheme": "euler"}
    first = advance.advance_snapshots(**call).toPandas()
    pd.testing.assert_frame_equal(first, advance.advance_snapshots(**call).toPandas(), check_exact=True)
    changes = {"seeds": s.withColumn("x", F.lit(0.8)), "field": field.where("i < 31"), "end": 1, "keys": ["vx"], "scheme": "rk4", "method": "linear", "size": 8, "together": 2}
    for name, value in changes.items():
        if name == "field":
            value = spark.createDataFrame(value.limit(5).toPandas())
        with pytest.raises(OtherRun, match=name):
            advance.advance_snapshots(**call | {name: value})


def test_predictors_that_leave_their_tile_are_done_again(spark, tmp_path):
    side = tuple(float(i) for i in range(48))
    grid, times = Grid((side, (0.0, 1.0), (0.0, 1.0)), spherical=False), [0.0, 1.0, 2.0]
    field = spark.createDataFrame(sampled(grid, times, lambda p, t: {"vx": 20.0 + 0.1 * p[0], "vy": 0 * p[0], "vz": 0 * p[0]}))
    s = spark.createDataFrame([(0, 1.0, 0.5, 0.5, 0.0)], "tracer_id long, x double, y double, z double, t0 double")
    run = lambda size: advance.advance_snapshots(s, field, grid, times, 0, 2, f"{tmp_path}/{size}", ["vx"], ["vx", "vy", "vz"], "expl_trap", "linear", size=size).toPandas().sort_values("time_idx").reset_index(drop=True)
    small, large = run(4), run(64)
    pd.testing.assert_frame_equal(small, large, check_exact=True)
    assert small.x.tolist()[:2] == [1.0, pytest.approx(1 + (20.1 + 20 + 0.1 * 21.1) / 2)]


def test_cubic_forms_agree(spark):
    rng = np.random.default_rng(1)
    x, v = np.cumsum(rng.uniform(0.1, 1, (4, 50)), 0), rng.normal(size=(4, 50))
    q = x[1] + rng.uniform(0, 1, 50) * (x[2] - x[1])
    df = spark.createDataFrame(pd.DataFrame({**{f"x{i}": x[i] for i in range(4)}, **{f"v{i}": v[i] for i in range(4)}, "q": q, "n": range(50)}))
    got = df.select("n", pchip4([F.col(f"x{i}") for i in range(4)], [F.col(f"v{i}") for i in range(4)], F.col("q")).alias("r")).orderBy("n").toPandas()["r"]
    assert np.allclose(got, pchip4_np(x, v, q), atol=1e-12)
    spike = pchip4_np(np.arange(4.0)[:, None], np.array([[4.0, 0, 0, 0]]).T, np.array([1.5]))
    assert spike[0] == 0
    assert np.isnan(pchip4_np(np.arange(4.0)[:, None], np.array([[np.nan, 0, 0, 0]]).T, np.array([1.5])))[0]


def test_weights_and_end_slopes():
    assert np.allclose(midpoint_weights([0, 1, 2, 3]), np.array([-1, 9, 9, -1]) / 16)
    assert abs(sum(midpoint_weights([-0.2, 0, 0.1, 0.3])) - 1) < 1e-12
    assert end_slope(1.0, 1.0, 1.0, 1.0) == 1 and end_slope(1.0, 1.0, 1.0, 4.0) == 0 and end_slope(1.0, 1.0, 1.0, -10.0) == 3


def test_chunks_cover_every_step_once():
    for start, end, size, need in [(0, 50, 10, 2), (50, 0, 10, 2), (0, 7, 3, 2), (3, 20, 6, 4)]:
        steps = [s for a, b in catalog.chunks(start, end, size, need) for s in range(a, b, 1 if end > start else -1)]
        assert set(steps) == set(range(start, end, 1 if end > start else -1))
    with pytest.raises(ValueError):
        catalog.chunks(0, 5, 2, 4)
