"""Reports on runs, against numpy."""

import numpy as np
import pandas as pd
import pytest

from eddyline.functions.grid import Grid
from eddyline.jobs import report
from eddyline.jobs.formats import Landed, keep
from tests.test_advance import sampled


def run_folder(spark, folder, n, seed, t0=0.0):
    """A run as it is written: n tracers that move outwards and cool, some of which end early."""
    rng = np.random.default_rng(seed)
    rows, props = [], []
    for i in range(n):
        d = rng.normal(size=3)
        d /= np.sqrt(d @ d)
        r0, v, steps = rng.uniform(1, 2), rng.uniform(0.5, 1), int(rng.integers(4, 9))
        for k in range(steps):
            t = t0 + 0.5 * k
            x, vel = d * (r0 + v * 0.5 * k), d * v
            rows.append((i, k, t, *x, "active", *vel, 8.0 * np.exp(-0.3 * k), 0.1 + 0.05 * k, 5.0 / (1 + k)))
        props.append((i, float(rng.uniform(1, 3)), "done" if i % 3 else "active"))
    traj = pd.DataFrame(rows, columns=["tracer_id", "time_idx", "time", "x", "y", "z", "status", "V_u_x", "V_u_y", "V_u_z", "T", "r_0", "rho"])
    spark.createDataFrame(traj).write.parquet(f"{folder}/steps/steps")
    props = pd.DataFrame(props, columns=["tracer_id", "mass", "status"])
    spark.createDataFrame(props).write.parquet(f"{folder}/props")
    traj["r"] = np.sqrt(traj.x**2 + traj.y**2 + traj.z**2)
    return traj, props


def test_histograms(spark, tmp_path):
    (a, pa), (b, pb) = run_folder(spark, f"{tmp_path}/a", 30, 1), run_folder(spark, f"{tmp_path}/b", 20, 2)
    report.main(["histograms", "--runs", f"{tmp_path}/a", f"{tmp_path}/b", "--output", f"{tmp_path}/out", "--bins", "7", "--t-ref", "4", "--temperature-gk", "1", "--r-ref", "2.5"])
    got = spark.read.parquet(f"{tmp_path}/out/histograms").toPandas()
    assert {"speed", "theta", "phi", "composition", "temperature", "composition_when_cooled", "expansion_time_when_cooled", "speed@2.5", "temperature@2.5"} <= set(got.panel)
    b = b.assign(tracer_id=b.tracer_id + 1000)
    traj, mass = pd.concat([a, b]), pd.concat([pa, pb.assign(tracer_id=pb.tracer_id + 1000)]).set_index("tracer_id").mass
    last = traj.sort_values("time").groupby("tracer_id").last()
    speed = np.sqrt(last.V_u_x**2 + last.V_u_y**2 + last.V_u_z**2)
    for name, values, log in (("speed", speed, False), ("composition", last.r_0, False), ("temperature", np.log10(last["T"]), True)):
        want, edges = np.histogram(values, 7, weights=mass.loc[values.index])
        mine = got[got.panel == name].set_index("bin").sort_index()
        assert np.allclose(mine.mass.reindex(range(7), fill_value=0), want) and mine.share.sum() == pytest.approx(1)
        assert np.allclose(np.log10(mine.low) if log else mine.low, edges[mine.index])
    crossing = got[got.panel == "composition@2.5"]
    assert crossing.n.sum() == (traj.groupby("tracer_id").r.max() >= 2.5).sum()
    one = report.read_runs(spark, [f"{tmp_path}/a"], ["done"])
    assert one[1].count() == 20 and report.histograms(*(x.where("false") for x in one)).count() == 0


def plain_mass(traj, mass, times, radius):
    out = np.zeros(len(times))
    for i, rows in traj.groupby("tracer_id"):
        r = dict(zip(rows.time, rows.r, strict=True))
        for n, t in enumerate(times):
            here = r[max(r)] if t > max(r) else r.get(t, 0.0)
            out[n] += mass[i] * (here >= radius)
    return out


def test_mass_through_a_sphere(spark, tmp_path):
    (a, pa), (b, pb) = run_folder(spark, f"{tmp_path}/v", 25, 3), run_folder(spark, f"{tmp_path}/s", 15, 4, t0=1.0)
    th, ph = (np.arange(12) + 0.5) * np.pi / 12, np.arange(24) * np.pi / 12
    grid, times = Grid((tuple(np.linspace(1, 4, 13)), tuple(th), tuple(ph))), [0.0, 0.5, 1.0, 1.5]
    er = lambda p: p / np.sqrt((p * p).sum(0))
    field = spark.createDataFrame(sampled(grid, times, lambda p, t: {"rho": (1 + t) / (p * p).sum(0), **dict(zip(("V_u_x", "V_u_y", "V_u_z"), er(p), strict=True))}))
    field.write.partitionBy("time_idx").parquet(f"{tmp_path}/landed/field")
    keep(spark, Landed(spark.createDataFrame(list(enumerate(times)), "time_idx int, time double"), grid, field), f"{tmp_path}/landed")
    report.main(["mass", "--volume-runs", f"{tmp_path}/v", "--surface-runs", f"{tmp_path}/s", "--r-check", "2.4", "--field", f"{tmp_path}/landed", "--output", f"{tmp_path}/out"])
    got = spark.read.parquet(f"{tmp_path}/out/mass").toPandas().sort_values("time").reset_index(drop=True)
    assert got.time.tolist() == sorted(set(a.time) | set(b.time))
    volume, surface = plain_mass(a, pa.set_index("tracer_id").mass, got.time, 2.4), plain_mass(b, pb.set_index("tracer_id").mass, got.time, 2.4)
    assert np.allclose(got.mass, volume + surface) and np.allclose(got.mass_surface, surface)
    assert np.allclose(got.rate[1:], np.diff(volume + surface) / np.diff(got.time)) and got.rate[0] == 0
    flux = got[got.flux.notna()]
    assert (flux.radius == 2.5).all() and np.allclose(flux.flux, 4 * np.pi * (1 + flux.time), rtol=2e-3)
    near = report.mass_check(report.read_runs(spark, [f"{tmp_path}/v"]), report.read_runs(spark, [f"{tmp_path}/s"]), 2.4, innermost=1.5).toPandas().sort_values("time")
    some = lambda x: x[x.tracer_id.isin(x.groupby("tracer_id").r.min().loc[lambda m: m < 1.5].index)]
    assert np.allclose(near.mass, plain_mass(some(a), pa.set_index("tracer_id").mass, near.time, 2.4) + plain_mass(some(b), pb.set_index("tracer_id").mass, near.time, 2.4))
