"""The HDF5 reader and what lands from its files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.functions.flows import Uniform
from eddyline.jobs import formats
from eddyline.jobs.formats import FORMATS, Options
from eddyline.operators import meshblock
from eddyline.sources import simulation
from eddyline.sources.hdf5 import File, Hdf5Error
from tests.hdf5_files import Chunked, Heap, write
from tests.test_blocks import GHOSTS, INTERIOR, nodes, octree

RNG = np.random.default_rng(0)


@pytest.mark.parametrize(("new", "shift"), [(False, 0), (True, 0), (False, 512)])
def test_groups_attributes_and_boxes(tmp_path, new, shift):
    cube = RNG.normal(size=(5, 6, 7, 8))
    tree = {f"g{n}": {"one": np.arange(n + 3, dtype=">i4")} for n in range(11)}
    tree |= {"flat": cube.astype(">f4"), "chunks": Chunked(cube, (2, 4, 3, 8)), "summed": Chunked(cube.astype("<f4"), (5, 1, 7, 8), ("deflate", "fletcher")), "plain": Chunked(cube, (3, 3, 3, 3), ()), "deep": {"a": {"b": {"c": np.array([3.5])}}}}
    attrs = {"Time": np.float32(1.25), "Names": np.array([b"rho", b"press"], "S21"), "Sizes": np.array([4, 5], "<i4"), "Texts": Heap([b"some", b"text of any length"])}
    write(f"{tmp_path}/f", tree, attrs, new, shift)
    with File(f"{tmp_path}/f") as f:
        assert sorted(f.root.children) == sorted(tree) and f["g7/one"].read().tolist() == list(range(10)) and f["deep/a/b/c"].read()[0] == 3.5
        a = f.root.attrs
        assert a["Time"] == 1.25 and a["Names"].tolist() == [b"rho", b"press"] and a["Sizes"].tolist() == [4, 5] and a["Texts"].tolist() == [b"some", b"text of any length"]
        for name, want in (("flat", cube.astype("f4")), ("chunks", cube), ("summed", cube.astype("f4")), ("plain", cube)):
            node = f[name]
            assert node.shape == cube.shape and np.array_equal(node.read(), want)
            assert np.array_equal(node.read(3), want[3]) and np.array_equal(node.read(1, (2, 5)), want[1, 2:5]) and np.array_equal(node.read((0, 5), (1, 2), 6, (3, 8)), want[:, 1:2, 6, 3:8])
            assert node.read((2, 2)).shape == (0, 6, 7, 8)
        with pytest.raises(Hdf5Error, match="isn't in"):
            f["flat"].read((0, 9))
        with pytest.raises(KeyError, match="no g7/two"):
            f["g7/two"]


def test_only_the_bytes_of_a_box_are_read(tmp_path):
    big = RNG.normal(size=(4, 64, 16, 16, 16)).astype("f4")
    write(f"{tmp_path}/f", {"prim": big, "chunks": Chunked(big, (1, 8, 16, 16, 16), ())})
    for name, most in (("prim", 8 * 4096 * 4), ("chunks", 16 * 4096 * 4)):
        with File(f"{tmp_path}/f") as f:
            node = f[name]
            node.read(0, (0, 0))
            before = f.pages.bytes_read
            assert np.array_equal(node.read(2, (12, 20)), big[2, 12:20])
            assert f.pages.bytes_read - before <= most + 3 * 16384


def test_files_that_arent_read(tmp_path):
    (tmp_path / "no").write_bytes(b"something else" * 100)
    with pytest.raises(Hdf5Error, match="not an HDF5 file"):
        File(f"{tmp_path}/no")
    write(f"{tmp_path}/f", {"x": Chunked(np.ones((4, 4)), (2, 2), ("deflate",))})
    raw = bytearray((tmp_path / "f").read_bytes())
    at = raw.index(bytes([1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0]))  # the pipeline's filter: deflate
    raw[at + 8] = 5
    (tmp_path / "f").write_bytes(raw)
    with pytest.raises(Hdf5Error, match="filter 5"):
        File(f"{tmp_path}/f")["x"].read()


def blocks_file(path, tree, time, values, chunked=False, levels=None, ng=GHOSTS, mirrored=True, new=False):
    """A file of refined blocks as a simulation writes it: ``values(name, r, theta, phi)`` on nodes of which those beyond a pole come
    mirrored, with vel2 and vel3 turned there."""
    names = {"prim": ["rho", "vel1", "vel2", "vel3"], "extra": ["Temperature"]}
    axes = [nodes(tree, level, place) for _, level, *place in tree.blocks]
    data = {k: np.stack([[np.broadcast_to(values(n, x1, x2[:, None], x3[:, None, None]), (len(x3), len(x2), len(x1))) for x1, x2, x3 in axes] for n in v]) for k, v in names.items()}
    x2v, x2f = [], []
    for b, (_, level, *place) in enumerate(tree.blocks):
        x2 = axes[b][1].copy()
        h = np.pi / 16 / (1 << level)
        x2f.append(h * (place[1] * INTERIOR + np.arange(-ng, INTERIOR + ng + 1)))
        for beyond in (x2 < 0, x2 > np.pi):
            if mirrored and beyond.any():
                x2[beyond] = np.where(x2[beyond] < 0, -x2[beyond], 2 * np.pi - x2[beyond])
                data["prim"][3, b][:, beyond] *= -1
        x2v.append(x2)
    root = tree.root
    x1f = []
    for _, level, *place in tree.blocks:
        f = np.array(root[0])
        fine = np.append(np.concatenate([f[:-1, None] + np.diff(f)[:, None] * np.arange(1 << level) / (1 << level)]).ravel(), f[-1])
        low, high = fine[1] - fine[0], fine[-1] - fine[-2]
        fine = np.concatenate([fine[0] - low * np.arange(ng, 0, -1), fine, fine[-1] + high * np.arange(1, ng + 1)])
        x1f.append(fine[place[0] * INTERIOR : place[0] * INTERIOR + INTERIOR + 2 * ng + 1])
    n = len(tree.blocks)
    content = {"Levels": np.array([b[1] for b in tree.blocks] if levels is None else levels, "<i4"), "LogicalLocations": np.array([b[2:] for b in tree.blocks], "<i8")}
    content |= {"x1f": np.stack(x1f).astype("<f8"), "x2f": np.stack(x2f), "x1v": np.stack([a[0] for a in axes]), "x2v": np.stack(x2v), "x3v": np.stack([a[2] for a in axes])}
    for k, v in data.items():
        content[k] = Chunked(v.astype("<f8"), (1, 3, *v.shape[2:])) if chunked else v.astype("<f8")
    size = INTERIOR + 2 * ng
    attrs = {"Time": time, "Coordinates": np.bytes_(b"spherical_polar"), "RootGridSize": np.array([16, 16, 32], "<i4"), "MeshBlockSize": np.array([size] * 3, "<i4"), "MaxLevel": np.int32(tree.finest), "NumMeshBlocks": np.int32(n)}
    attrs |= {"RootGridX1": np.array([0.5, 4.0, 1.05]), "RootGridX2": np.array([0.0, np.pi, 1.0]), "RootGridX3": np.array([0.0, 2 * np.pi, 1.0])}
    attrs |= {"VariableNames": np.array([m.encode() for v in names.values() for m in v], "S21"), "DatasetNames": np.array([k.encode() for k in names], "S21"), "NumVariables": np.array([4, 1], "<i4")}
    write(path, content, attrs, new)


def uniform(name, r, th, ph, v=(0.9, 0.2, 0.1)):
    """Raw values of a uniform flow in flat space: the velocities are per coordinate, and their Lorentz factor is undone."""
    sin, cos = np.sin(th), np.cos(th)
    if name == "rho":
        return r + 0 * th + 0 * ph
    if name == "Temperature":
        return 2 + r * cos + 0 * ph
    lorentz = 1 / np.sqrt(1 - sum(x * x for x in v))
    parts = {"vel1": v[0] * sin * np.cos(ph) + v[1] * sin * np.sin(ph) + v[2] * cos, "vel2": (v[0] * cos * np.cos(ph) + v[1] * cos * np.sin(ph) - v[2] * sin) / r, "vel3": (-v[0] * np.sin(ph) + v[1] * np.cos(ph)) / (r * sin)}
    return lorentz * parts[name] + 0 * r + 0 * th + 0 * ph


KEYS = ["rho", "T", "V_u_x", "V_u_y", "V_u_z"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, tree = tmp_path_factory.mktemp("hdf5"), octree()
    for n in range(4):
        blocks_file(f"{folder}/s{n}.athdf", tree, 0.25 * n, uniform, chunked=n % 2 == 1, new=n == 2)
    return folder, tree


def test_blocks_land_as_the_library_wants_them(spark, files, tmp_path):
    folder, tree = files
    layout = simulation.read_layout(f"{folder}/s0.athdf")
    assert layout.octree == tree and layout.ghosts == GHOSTS
    landed = FORMATS["blocks"].land(spark, f"{folder}/*.athdf", KEYS, f"{tmp_path}/field", Options(mass=0.0))
    assert [r.time for r in landed.times.orderBy("time_idx").collect()] == [0.0, 0.25, 0.5, 0.75] and landed.field.count() == 4 * len(tree.blocks)
    for r in landed.field.where("time_idx in (1, 2)").collect():
        _, level, *place = tree.blocks[r.block_id]
        x1, x2, x3 = nodes(tree, level, place)
        assert np.allclose(r.x1v, x1) and np.allclose(r.x2v, x2) and np.allclose(r.x3v, x3)
        shape = (len(x3), len(x2), len(x1))
        assert np.allclose(np.reshape(r.rho, shape), np.broadcast_to(x1, shape)) and np.allclose(np.reshape(r.T, shape), np.broadcast_to(uniform("Temperature", x1, x2[:, None], x3[:, None, None]), shape))
        for k, want in zip(KEYS[2:], (0.9, 0.2, 0.1), strict=True):
            assert np.allclose(r[k], want)
    rows = spark.read.format("blocks_hdf5").options(keys="rho,vel1,vel2,vel3", split="50000").load(f"{folder}/s1.athdf")
    assert rows.rdd.getNumPartitions() > 3 and rows.count() == len(tree.blocks)
    same = meshblock.landed(rows.select("block_id", "x1v", "x2v", "x3v", "x2f", *(F.col(f"vel{n}").alias(f"u{n}") for n in (1, 2, 3)), "rho"), GHOSTS, 0.0).orderBy("block_id").collect()
    mine = landed.field.where("time_idx = 1").orderBy("block_id").collect()
    assert all(a.V_u_x == b.V_u_x and a.x2v == b.x2v and a.rho == b.rho for a, b in zip(same, mine, strict=True))
    stamp = landed.field.inputFiles()
    assert FORMATS["blocks"].land(spark, f"{folder}/*.athdf", KEYS, f"{tmp_path}/field", Options(mass=0.0)).field.inputFiles() == stamp
    formats.keep(spark, landed, f"{tmp_path}")
    back = formats.kept(spark, f"{tmp_path}")
    assert back.grid == tree and back.grid.find(np.array([[1.0], [1.0], [1.0]])) == tree.find(np.array([[1.0], [1.0], [1.0]]))


def test_the_last_path_counts_and_other_refinements_are_errors(spark, tmp_path):
    tree = octree(())
    blocks_file(f"{tmp_path}/a.athdf", tree, 0.0, uniform)
    blocks_file(f"{tmp_path}/b.athdf", tree, 0.0, lambda n, r, th, ph: uniform(n, r, th, ph) * (3 if n == "rho" else 1))
    landed = FORMATS["blocks"].land(spark, f"{tmp_path}/*.athdf", KEYS, f"{tmp_path}/field", Options(mass=0.0))
    assert landed.field.count() == len(tree.blocks) and landed.field.where("abs(element_at(rho, 1) - 3 * element_at(x1v, 1)) > 1e-9").count() == 0
    with pytest.raises(KeyError, match="lacks nothing"):
        FORMATS["blocks"].land(spark, f"{tmp_path}/*.athdf", [*KEYS, "nothing"], f"{tmp_path}/none", Options())
    blocks_file(f"{tmp_path}/c.athdf", octree(), 1.0, uniform)
    with pytest.raises(Exception, match="refined otherwise"):
        FORMATS["blocks"].land(spark, f"{tmp_path}/*.athdf", KEYS, f"{tmp_path}/other", Options()).field.count()
    blocks_file(f"{tmp_path}/d.athdf", tree, 0.0, uniform, ng=GHOSTS, levels=[1] * 16)
    with pytest.raises(ValueError, match="cover"):
        simulation.read_layout(f"{tmp_path}/d.athdf")


def test_a_run_from_files_of_blocks(spark, files, tmp_path):
    from eddyline.jobs import land as landing
    from eddyline.jobs import run as job

    folder, _ = files
    landing.main(["--data-dir", str(folder), "--format", "blocks", "--output", f"{tmp_path}/landed", "--keys", *KEYS, "--bh-mass", "0"])
    common = ["--start-t", "0", "--end-t", "0.75", "--keys", *KEYS, "--integrator", "expl_trap", "volume", "--r-min", "1", "--r-max", "2", "--n-r", "2", "--n-th", "3", "--n-ph", "4", "--no-random-shift"]
    out = []
    for name, source in (("a", ["--data-dir", str(folder), "--bh-mass", "0", "--format", "blocks"]), ("b", ["--field", f"{tmp_path}/landed", "--format", "blocks"])):
        traj, props = job.run(spark, job.parsed([*source, "--output-dir", f"{tmp_path}/{name}", "--text-output", *common]))
        out.append(traj.orderBy("tracer_id", "time_idx").toPandas())
        assert props.count() == 24 and props.agg(F.sum("mass_quad")).first()[0] == pytest.approx(4 * np.pi * 15 / 4, rel=1e-3)
    assert out[0].equals(out[1])
    for _, one in out[0].groupby("tracer_id"):
        start = one[["x", "y", "z"]].to_numpy()[0]
        assert np.allclose(one[["x", "y", "z"]].to_numpy(), start + np.outer(one.time, (0.9, 0.2, 0.1)), atol=1e-6)
    assert len(list((tmp_path / "a" / "text").glob("*.dat"))) == 24
    with pytest.raises(SystemExit):
        job.parsed(["--data-dir", "x", "--format", "blocks", "--interpolator", "pchip", *common])


def surface_file(path, time, radii, th, ph, values, whole=False):
    """Raw (a group a radius) or reduced surfaces; ``values(name, r, theta, phi)``."""
    names = ["rho", "V_u_x", "J_00", "J_01", "J_02", "n_00", "n_01", "n_02", "sc_sqrt_det_g", "s", "st_H_u_t_00"]
    grid = lambda n, r: values(n, r, th[:, None], ph) + 0 * th[:, None] * ph
    if whole:
        tree = {"coordinates": {"r": np.array(radii), "th": th, "ph": ph, "time": np.array([time])}} | {n: np.stack([grid(n, r) for r in radii]) for n in names[:2]}
    else:
        tree = {"coordinates": {f"{i:02d}": {"R": np.array([r]), "T": np.array([time]), "th": th, "ph": ph} for i, r in enumerate(radii)}}
        tree["fields"] = {f"{i:02d}": {"hydro": {f"hydro.{n}": grid(n, r) for n in names[:2]}, "M1": {f"M1.{n}": grid(n, r).astype(">f4") for n in names[2:]}} for i, r in enumerate(radii)}
    write(path, tree)


def level(n, r, th, ph):
    return {"rho": r, "V_u_x": r * np.sin(th) * np.cos(ph), "J_00": 6.0, "J_01": 8.0, "J_02": 10.0, "n_00": 2.0, "n_01": 4.0, "n_02": 5.0, "sc_sqrt_det_g": 0.5}.get(n, 1.0)


@pytest.mark.parametrize("whole", [False, True])
def test_surfaces_land_as_a_field(spark, tmp_path, whole):
    radii, th, ph = [*range(1, 13)], (np.arange(6) + 0.5) * np.pi / 6, np.arange(8) * np.pi / 4
    for n in range(2):
        surface_file(f"{tmp_path}/x{n}.hdf5", 0.5 * n, list(map(float, radii)), th, ph, level, whole)
    landed = FORMATS["surface"].land(spark, f"{tmp_path}/*.hdf5", ["rho", "V_u_x"], f"{tmp_path}/field", Options())
    assert landed.grid.shape == (12, 6, 8) and landed.grid.axes[0] == tuple(map(float, radii))
    got = landed.field.toPandas()
    assert len(got) == 2 * 12 * 6 * 8 and set(got.columns) == {"time_idx", "i", "j", "k", "rho", "V_u_x"}
    assert np.allclose(got.rho, got.i + 1) and np.allclose(got.V_u_x, (got.i + 1) * np.sin(th[got.j]) * np.cos(ph[got.k]))
    if not whole:
        reduced = FORMATS["surface"].land(spark, f"{tmp_path}/*.hdf5", [], f"{tmp_path}/reduced", Options(reduce=True)).field
        assert set(reduced.columns) == {"time_idx", "i", "j", "k", "rho", "V_u_x", *(f"{q}_{s}" for q in ("F", "eps") for s in ("nue", "anue", "nux"))}
        assert reduced.where("F_nue != 4 or F_anue != 8 or F_nux != 10 or eps_nue != 3 or eps_anue != 2 or eps_nux != 2").count() == 0 and reduced.count() == len(got)
    with pytest.raises(KeyError, match="lacks T"):
        FORMATS["surface"].land(spark, f"{tmp_path}/*.hdf5", ["T"], f"{tmp_path}/none", Options())
