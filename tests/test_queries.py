"""Every registered query with SQL gives what DuckDB gives for it."""

import math

import duckdb
import pytest

from eddyline.queries import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, str) else float(v) + 0.0 if hasattr(v, "__float__") else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name not in ORACLES:
        assert len(mine)
        return
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_steps_that_sql_cannot_say(spark):
    """Final positions against fine classical Runge-Kutta steps on the flow itself."""
    import numpy as np

    from eddyline.functions.flows import BlastWave, DiskWind

    def fine(flow, p, start, end, n):
        h, v = (end - start) / n, flow.velocity_np
        for i in range(n):
            t = start + i * h
            a = v(p, t)
            b = v(p + h / 2 * a, t + h / 2)
            c = v(p + h / 2 * b, t + h / 2)
            p = p + h / 6 * (a + 2 * b + 2 * c + v(p + h * c, t + h))
        return p

    sf = f"{DATA}/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    p = np.stack(vectors.embedding.to_numpy()).astype(float)[:, :3].T * 10
    for name, flow, start, end, most in (("t2_implicit_trapezoid", DiskWind(), 0, 3, 2e-2), ("t6_blast_wave_chunk", BlastWave(), 1, 4, 2e-2), ("t11_backward", DiskWind(), 3, 0, 1e-3)):
        got = QUERIES[name](spark, sf).toPandas().sort_values("tracer_id")
        assert got.tracer_id.tolist() == vectors.vec_id.tolist()
        away = np.abs(got[["x", "y", "z"]].to_numpy().T - fine(flow, p, start, end, 600))
        far = np.sqrt((p * p).sum(0)) > 0.3  # close to the centre the disk turns fast
        assert away[:, far].max() < most and np.median(away) < most / 20, name
