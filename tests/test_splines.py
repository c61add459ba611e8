"""Global splines against dense solves, in slabs and across a pole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions.grid import Block, Grid
from eddyline.functions.spline import basis, coefficients, knots
from eddyline.operators import splines, tiles
from tests.test_advance import sampled

RNG = np.random.default_rng(5)


def dense(x, degree, q):
    """All basis functions at q by the recursion's definition."""
    t, n = knots(x, degree), len(x)
    at = np.clip(np.searchsorted(t, q, "right") - 1, degree, n - 1)
    b = (np.arange(len(t) - 1) == at[:, None]).astype(float)
    for d in range(1, degree + 1):
        new = np.zeros((len(q), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            if t[i + d] > t[i]:
                new[:, i] += (q - t[i]) / (t[i + d] - t[i]) * b[:, i]
            if t[i + d + 1] > t[i + 1]:
                new[:, i] += (t[i + d + 1] - q) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1]
        b = new
    return b


@pytest.mark.parametrize("degree", [3, 5])
def test_banded_solves(degree):
    for n in (degree + 1, degree + 2, 12, 40):
        x = np.cumsum(RNG.uniform(0.5, 2, n))
        v = RNG.normal(size=(n, 3, 2))
        want = np.linalg.solve(dense(x, degree, x), v.reshape(n, -1)).reshape(v.shape)
        assert np.allclose(coefficients(x, v, degree), want, rtol=1e-7, atol=1e-7)
        q = np.append(RNG.uniform(x[0], x[-1], 50), x[[0, -1]])
        first, w = basis(x, degree, q)
        polynomial = np.polynomial.Polynomial(RNG.normal(size=degree + 1), domain=[x[0], x[-1]])
        c = coefficients(x, polynomial(x), degree)
        assert np.allclose((w * c[first + np.arange(degree + 1)[:, None]]).sum(0), polynomial(q)) and np.allclose(w.sum(0), 1)
    with pytest.raises(ValueError, match="too few"):
        knots(np.arange(degree + 0.0), degree)


@pytest.mark.parametrize(("method", "degree"), [("cubic", 3), ("quintic", 5)])
def test_slabs_give_what_a_dense_solve_gives(spark, method, degree):
    axes = tuple(tuple(np.cumsum(RNG.uniform(0.5, 2, n))) for n in (12, 9, 10))
    grid, values = Grid(axes, spherical=False), RNG.normal(size=(2, 12, 9, 10))
    index = np.stack([m.ravel() for m in np.meshgrid(*map(range, grid.shape), indexing="ij")])
    field = spark.createDataFrame(pd.DataFrame({"time_idx": np.int32(3), **{a: index[n].astype(np.int32) for n, a in enumerate("ijk")}, "u": values[0].ravel(), "v": values[1].ravel()})).repartition(7)
    whole = values
    for a in range(3):
        whole = np.moveaxis(np.tensordot(np.linalg.inv(dense(np.array(axes[a]), degree, np.array(axes[a]))), whole, (1, a + 1)), 0, a + 1)
    fit = splines.fitted(field, grid, ["u", "v"], method)
    got = fit.toPandas().sort_values(["ei", "ej", "ek"])
    assert len(got) == 12 * 9 * 10 and np.allclose(got[["u", "v"]].to_numpy().T.reshape(values.shape), whole, rtol=1e-6, atol=1e-6)
    q = np.stack([RNG.uniform(a[0] - 0.2, a[-1] + 0.2, 300) for a in axes])
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(300), "time_idx": np.int32(3), **dict(zip("xyz", q, strict=True))}))
    at = tiles.gather(points, fit, grid, ["u", "v"], method, kind="coordinates", size=4).toPandas().sort_values("point_id")
    inside = np.all([(x >= a[0]) & (x <= a[-1]) for x, a in zip(q, axes, strict=True)], axis=0)
    parts = [dense(np.array(a), degree, x[inside]) for a, x in zip(axes, q, strict=True)]
    want = np.einsum("pi,pj,pk,nijk->np", *parts, whole)
    assert np.isnan(at.u.to_numpy()[~inside]).all() and np.allclose(at[["u", "v"]].to_numpy()[inside].T, want, atol=1e-8)
    direct, stray = Block(grid, (0, 0, 0), whole).at(q, method)
    assert not stray.any() and np.allclose(direct[:, inside], want)


def test_splines_continue_over_poles_and_the_seam(spark):
    f = lambda p, t: {"v": np.sin(p[0] + 0.5 * p[1]) * np.cos(p[2])}
    errors = {}
    for n in (12, 24):
        grid = Grid((tuple(np.linspace(1, 3, n)), tuple((np.arange(n) + 0.5) * np.pi / n), tuple(np.arange(2 * n) * np.pi / n)))
        field = spark.createDataFrame(sampled(grid, [0.0], f))
        d = np.random.default_rng(1).normal(size=(3, 400))
        p = np.random.default_rng(2).uniform(1.05, 2.95, 400) * d / np.sqrt((d * d).sum(0))
        p[:2, :40] *= 0.02  # near the axis
        points = spark.createDataFrame(pd.DataFrame({"point_id": range(400), "time_idx": np.int32(0), **dict(zip("xyz", p, strict=True))}))
        for method in ("cubic", "quintic"):
            got = tiles.gather(points, splines.fitted(field, grid, ["v"], method), grid, ["v"], method, size=8).toPandas().sort_values("point_id").v
            r = np.sqrt((p * p).sum(0))
            errors[n, method] = np.abs(got - f(p, 0)["v"])[(r > 1.05) & (r < 2.95)].max()
    assert errors[24, "cubic"] < errors[12, "cubic"] / 8 and errors[24, "quintic"] < min(errors[12, "quintic"] / 16, errors[24, "cubic"])


def test_what_a_missing_cell_has_a_part_in_is_nan(spark):
    side = tuple(float(i) for i in range(6))
    grid = Grid((side,) * 3, spherical=False)
    field = spark.createDataFrame(sampled(grid, [0.0], lambda p, t: {"v": p[0]}))
    lacking = splines.fitted(field.where("not (i = 2 and j = 3 and k = 4)"), grid, ["v"], "cubic")
    assert lacking.where("ei between 1 and 4 and ej between 1 and 4 and ek between 1 and 4").where(~F.isnan("v")).count() == 0
    assert splines.fitted(field.where("false"), grid, ["v"], "cubic").count() == 0
