"""Registered queries of the particle library, each over whole tables, with the SQL that says the same.

The tables stand in for a simulation's: ``events`` are histories (a user is a tracer, the value its temperature
and radius), ``orders`` give tracers their masses, ``embeddings`` are positions, ``lineitem`` weighted samples,
``supplier`` and ``customer`` specifications of seeds. Floats are rounded, as two engines add in two orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.functions import geometry as g
from eddyline.functions import stencil
from eddyline.functions import fields, keys
from eddyline.functions.flows import BlastWave, DiskWind
from eddyline.functions.grid import Grid
from eddyline.functions.octree import Octree, faces
from eddyline.operators import advance, catalog, gather, history, seeding, splines, tiles
from eddyline.shared import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EPOCH = 1_704_067_200_000_000  # 2024-01-01 in microseconds
DAY = 86_400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRAJ(tracer_id, seq, time, r, temp, rho, ye, status)."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("tracer_id"), n.alias("seq"), ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / 1e6).alias("time"), F.col("value").alias("r"), F.col("value").alias("temp"),
        (1 + (n * 7919 % 1000) / 1000).alias("rho"), ((n * 31 % 100) / 100).alias("ye"), F.col("event_type").alias("status"),
    )


TRAJ = f"""traj as (select user_id as tracer_id, event_id as seq, (epoch_us(ts) - {EPOCH}) / 1e6 as time, value as r, value as temp,
  1 + (event_id * 7919 % 1000) / 1000 as rho, (event_id * 31 % 100) / 100 as ye, event_type as status from events)"""


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROPS(tracer_id, mass, dV)."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("tracer_id")).agg((F.round(F.sum("o_totalprice"), 2) / 1e6).alias("mass"), F.count(F.lit(1)).cast("double").alias("dV"))


PROPS = "props as (select o_custkey as tracer_id, round(sum(o_totalprice), 2) / 1e6 as mass, cast(count(*) as double) as dV from orders group by 1)"


def positions(spark: SparkSession, sf_dir: str, scale: float = 10.0) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("tracer_id"), *((F.element_at("embedding", i).cast("double") * scale).alias(c) for i, c in enumerate("xyz", 1)))


def _pos(scale: float = 10.0) -> str:
    return f"pos as (select vec_id as tracer_id, cast(embedding[1] as double) * {scale} as x, cast(embedding[2] as double) * {scale} as y, cast(embedding[3] as double) * {scale} as z from embeddings)"


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- coordinates and fields ------------------------------------------------------------------------------


@query(f"""with {_pos()} select tracer_id, round(sqrt(x*x+y*y+z*z), 8) as r, round(acos(z / sqrt(x*x+y*y+z*z)), 8) as theta, round(z / sqrt(x*x+y*y+z*z), 8) as mu,
  round(case when atan2(y, x) < 0 then atan2(y, x) + 2*pi() else atan2(y, x) end, 8) as phi from pos""")
def p2_spherical_coordinates(spark, sf_dir):
    p, (x, y, z) = positions(spark, sf_dir), map(F.col, "xyz")
    return p.select("tracer_id", rounded(g.radius(x, y, z), 8).alias("r"), rounded(g.polar(x, y, z), 8).alias("theta"), rounded(g.polar(x, y, z, "mu"), 8).alias("mu"), rounded(g.azimuth(x, y), 8).alias("phi"))


@query("select l_orderkey, l_linenumber, round(log10(l_extendedprice), 8) as log_r, round(asinh(l_extendedprice / 1000), 8) as asinh_r from lineitem")
def p1_radial_transforms(spark, sf_dir):
    r = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(g.transformed(r, "log"), 8).alias("log_r"), rounded(g.transformed(r, "asinh", 1000.0), 8).alias("asinh_r"))


_ANGLE = "(temp - 6.283185307179586 * floor(temp / 6.283185307179586))"


@query(f"""with {TRAJ}, a as (select tracer_id, seq, time, {_ANGLE} as phi from traj),
  d as (select *, phi - lag(phi) over (partition by tracer_id order by time, seq) as step from a)
  select tracer_id, seq, round((phi + 2*pi() * sum(case when step > pi() then -1 when step < -pi() then 1 else 0 end) over (partition by tracer_id order by time, seq rows unbounded preceding)) * 180 / pi(), 6) as phi_deg from d""")
def p4_unwrapped_angle(spark, sf_dir):
    t = histories(spark, sf_dir)
    phi = F.col("temp") - g.TWO_PI * F.floor(F.col("temp") / g.TWO_PI)
    t = t.withColumn("phi", phi)
    return t.select("tracer_id", "seq", rounded(g.unwrapped(F.col("phi"), "tracer_id", ["time", "seq"]) * (180 / math.pi)).alias("phi_deg"))


@query("""select l_orderkey, l_linenumber, l_discount + l_tax as flux,
  round(case when l_discount + l_tax > 0 then (l_discount * l_quantity + l_tax * l_extendedprice) / (l_discount + l_tax) else 0 end, 6) as energy from lineitem""")
def p7_heavy_species(spark, sf_dir):
    wa, wb = F.col("l_discount"), F.col("l_tax")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.summed_flux(wa, wb).alias("flux"), rounded(g.mean_energy(wa, F.col("l_quantity"), wb, F.col("l_extendedprice"))).alias("energy"))


@query("""with d as (select event_id, case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then 'infinity'::double when event_id % 17 = 0 then value * 1e6 else value end as v from events)
  select event_id, case when not isnan(v) and abs(v) < 'infinity'::double and abs(v) <= 10000 then v else 0 end as v, not (not isnan(v) and abs(v) < 'infinity'::double and abs(v) <= 10000) as bad from d""")
def p8_sanitised(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    e = read(spark, sf_dir, "events").select(n, F.when(n % 11 == 0, F.lit(float("nan"))).when(n % 13 == 0, F.lit(float("inf"))).when(n % 17 == 0, v * 1e6).otherwise(v).alias("v"))
    return e.select(n, g.sanitised(F.col("v"), g.ENERGY_LIMIT).alias("v"), (~g.is_sane(F.col("v"), g.ENERGY_LIMIT)).alias("bad"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber <> 0 then round(l_extendedprice / l_linenumber, 6) end as eps, case when l_quantity <> 0 then round(l_linenumber / l_quantity, 8) end as flux from lineitem""")
def p9_moment_reduction(spark, sf_dir):
    n = F.col("l_linenumber").cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(g.moment_energy(F.col("l_extendedprice"), n)).alias("eps"), rounded(g.moment_density(n, F.col("l_quantity")), 8).alias("flux"))


@query(f"""with {_pos()}, s as (select tracer_id, 3 + sqrt(x*x+y*y+z*z) as r, acos(z / sqrt(x*x+y*y+z*z)) as th, atan2(y, x) as ph, x / 10 as u1, y / 100 as u2, z / 100 as u3 from pos),
  f as (select *, sqrt(1 - 2 / r) / sqrt(1 + u1*u1 / (1 - 2/r) + (r*u2)*(r*u2) + (r*sin(th)*u3)*(r*sin(th)*u3)) as w from s),
  c as (select *, w*u1 as vr, w*r*u2 as vt, w*r*sin(th)*u3 as vp from f)
  select tracer_id, round(vr*sin(th)*cos(ph) + vt*cos(th)*cos(ph) - vp*sin(ph), 8) as vx, round(vr*sin(th)*sin(ph) + vt*cos(th)*sin(ph) + vp*cos(ph), 8) as vy, round(vr*cos(th) - vt*sin(th), 8) as vz from c""")
def p11_transport_velocity(spark, sf_dir):
    x, y, z = map(F.col, "xyz")
    r = g.radius(x, y, z)
    s = positions(spark, sf_dir).select("tracer_id", (r + 3).alias("r"), g.polar(x, y, z).alias("th"), F.atan2(y, x).alias("ph"), (x / 10).alias("u1"), (y / 100).alias("u2"), (z / 100).alias("u3"))
    v = g.transport_velocity(*(F.col(c) for c in ("u1", "u2", "u3", "r", "th", "ph")), 1.0)
    return s.select("tracer_id", *(rounded(c, 8).alias(n) for c, n in zip(v, ("vx", "vy", "vz"), strict=True)))


@query("select event_id, case when value / 50 > 1 then round(sqrt(1 - 1 / ((value/50)*(value/50))), 8) else -1 end as v_inf from events")
def p16_asymptotic_velocity(spark, sf_dir):
    v = g.asymptotic_velocity(F.col("value") / 50)
    return read(spark, sf_dir, "events").select("event_id", F.when(F.isnan(v), F.lit(-1.0)).otherwise(rounded(v, 8)).alias("v_inf"))


@query("select o_orderkey, o_orderkey % 16 as i, 11 - (o_orderkey // 16) % 12 as j, o_orderkey // 192 as k, abs(o_totalprice - 200000) as mass from orders")
def p20_grid_index(spark, sf_dir):
    i, j, k = g.grid_index(F.col("o_orderkey"), 16, 12, flip=True)
    return read(spark, sf_dir, "orders").select("o_orderkey", i.alias("i"), j.alias("j"), k.alias("k"), F.abs(F.col("o_totalprice") - 200000).alias("mass"))


@query("""with c as (select o_orderkey, o_orderkey % 14 - 3 as j, o_orderkey % 26 - 5 as k from orders)
  select o_orderkey, j, k, case when j < 0 then -j - 1 when j > 7 then 15 - j else j end as row_, (k + case when j < 0 or j > 7 then 8 else 0 end + 16) % 16 as col_ from c""")
def i7_ghost_cells(spark, sf_dir):
    j, k = F.col("o_orderkey") % 14 - 3, F.col("o_orderkey") % 26 - 5
    row, col = g.ghost_cell(j, k, 8, 16)
    return read(spark, sf_dir, "orders").select("o_orderkey", j.alias("j"), k.alias("k"), row.alias("row_"), col.alias("col_"))


# ---- filters and the catalog -----------------------------------------------------------------------------


def _files(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / DAY).alias("time")
    return o.select(F.when(F.col("o_orderkey") % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).alias("path"), day, F.array("o_orderpriority").alias("keys"))


_FILES = "files as (select case when o_orderkey % 97 = 0 then '' else 'f' || lpad(cast(o_orderkey as varchar), 9, '0') end as path, epoch_us(o_orderdate) / 1e6 / 86400.0 as time, o_orderpriority as key from orders)"


@query(f"with {_FILES} select row_number() over (order by time) - 1 as time_idx, time, count(*) as n_files, min(path) as first_path, max(path) as last_path from files where path <> '' group by time")
def s2_snapshot_catalog(spark, sf_dir):
    return catalog.snapshots(_files(spark, sf_dir)).select(F.col("time_idx").cast("long").alias("time_idx"), "time", "n_files", "first_path", "last_path")


@query(f"""with {_FILES}, k as (select distinct key from files), t as (select distinct time from files)
  select t.time, k.key from t, k where not exists (select 1 from files f where f.time = t.time and f.key = k.key)""")
def s2_incomplete_keys(spark, sf_dir):
    keys = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return catalog.incomplete(_files(spark, sf_dir), keys)


@query(f"with {_FILES} select time, key, max(path) as path from files group by 1, 2")
def s12_latest_path_wins(spark, sf_dir):
    f = _files(spark, sf_dir).select("time", F.explode("keys").alias("key"), "path")
    return catalog.latest_path(f).select("time", "key", "path")


@query(f"""with {_FILES}, t as (select row_number() over (order by time) - 1 as time_idx, time from (select distinct time from files)),
  s as (select o_orderkey as seed_id, epoch_us(o_orderdate) / 1e6 / 86400.0 + (o_orderkey % 7) / 7.0 as t0 from orders)
  select seed_id, (select arg_min(time_idx, abs(time - t0) + time * 1e-12) from t where time between t0 - 1.5 and t0 + 1.5) as time_idx from s""")
def f4_nearest_snapshot(spark, sf_dir):
    f = _files(spark, sf_dir)
    times = catalog.snapshots(f.withColumn("path", F.lit("f"))).select("time_idx", "time")
    o = read(spark, sf_dir, "orders")
    seeds = o.select(F.col("o_orderkey").alias("seed_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / DAY + (F.col("o_orderkey") % 7) / 7.0).alias("t0"))
    return catalog.nearest_time(seeds, times, 1.5).select("seed_id", F.col("time_idx").cast("long").alias("time_idx"))


@query(f"with {_FILES}, t as (select distinct time from files where time between 9000 and 10000), n as (select time, row_number() over (order by time desc) - 1 as step from t) select time, step from n where step % 3 = 0")
def f5_every_nth_snapshot(spark, sf_dir):
    times = _files(spark, sf_dir).select("time").distinct()
    return catalog.every_nth(times, 10000.0, 9000.0, 3).select("time", F.col("step").cast("long").alias("step"))


@query(f"with {_FILES}, t as (select distinct time from files) select * from (select time as t_b, lag(time) over (order by time) as t_a, lead(time) over (order by time) as t_c, lead(time, 2) over (order by time) as t_d from t) where t_c is not null")
def j3_step_windows(spark, sf_dir):
    times = catalog.snapshots(_files(spark, sf_dir).withColumn("path", F.lit("f")))
    return catalog.step_windows(times).select("t_a", "t_b", "t_c", "t_d")


@query(f"""with {_FILES}, t as (select row_number() over (order by time) - 1 as i, time from (select distinct time from files)), n as (select count(*) as n from t),
  b as (select row_number() over (order by time) - 1 as slot, time + 0.3 as t_start from t, n where i % 7 = 2 and i < n - 1), a as (select slot, (select arg_min(i, abs(t.time - b.t_start)) from t) as i from b),
  p as (select slot, i as a, lead(i) over (order by slot) as b from a)
  select p.slot, t.i as time_idx, p.b - p.a as n_files, round(u.time - v.time, 9) as dt from p join t on t.i >= p.a and t.i < p.b join t u on u.i = p.b join t v on v.i = p.a""")
def j6_slot_windows(spark, sf_dir):
    """Slots that begin a little after every seventh snapshot."""
    times = catalog.snapshots(_files(spark, sf_dir).withColumn("path", F.lit("f"))).select("time_idx", "time")
    last = times.agg(F.max("time_idx").alias("last"))
    chosen = times.join(F.broadcast(last), F.lit(True)).where("time_idx % 7 = 2 and time_idx < last")
    starts = chosen.select((F.row_number().over(Window.orderBy("time")) - 1).alias("order"), (F.col("time") + 0.3).alias("t_start"))
    return catalog.slot_windows(times, starts).select(F.col("slot").cast("long"), F.col("time_idx").cast("long"), "n_files", rounded("dt", 9).alias("dt"))


@query(f"""with {_FILES}, t as (select distinct time from files), s as (select o_orderkey as seed_id, epoch_us(o_orderdate) / 1e6 / 86400.0 + case when o_orderkey % 3 = 0 then 0.4 else (o_orderkey % 3) * 1e-3 end as t0 from orders)
  select seed_id, exists (select 1 from t where abs(t0 - t.time) <= 1e-8 + 1e-5 * abs(t.time)) as starts from s""")
def f3_seed_meets_a_snapshot(spark, sf_dir):
    times = catalog.snapshots(_files(spark, sf_dir).withColumn("path", F.lit("f"))).select("time_idx", "time")
    n = F.col("o_orderkey") % 3
    t0 = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / DAY + F.when(n == 0, F.lit(0.4)).otherwise(n * 1e-3)
    near = catalog.nearest_time(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed_id"), t0.alias("t0")), times, 1.5)
    return near.select("seed_id", F.coalesce(catalog.is_close(F.col("t0"), F.col("time")), F.lit(False)).alias("starts"))


@query(f"with {TRAJ} select tracer_id, seq from traj where status in ('view', 'purchase')")
def f6_status_filter(spark, sf_dir):
    return history.of_status(histories(spark, sf_dir), ["view", "purchase"]).select("tracer_id", "seq")


@query(f"with {TRAJ}, m as (select tracer_id, min(r * r) as r2 from traj group by 1) select t.tracer_id, t.seq from traj t join m using (tracer_id) where m.r2 >= 0.09")
def f7_never_within_radius(spark, sf_dir):
    return history.never_within(histories(spark, sf_dir), 0.3).select("tracer_id", "seq")


@query(f"with {TRAJ} select tracer_id, count(*) as n from traj group by 1 having min(r) < 0.3")
def f8_reaching_inside(spark, sf_dir):
    return history.reaching(histories(spark, sf_dir), 0.3)


@query("select vec_id from embeddings order by (vec_id * 2654435761 + 97) % 4294967296, vec_id limit 200")
def f11_hash_sample(spark, sf_dir):
    return history.sampled(read(spark, sf_dir, "embeddings"), 200, 97, "vec_id").select("vec_id")


@query(f"""with {TRAJ}, m as (select tracer_id, max(temp) as v from traj group by 1), b as (select min(v) as lo, max(v) as hi from m),
  s as (select tracer_id, v, floor((v - lo) / ((hi - lo) / 19) + 1e-12) as t from m, b) select tracer_id, v from (select *, row_number() over (partition by t order by v, tracer_id) as r from s) where r = 1""")
def f12_even_by_value(spark, sf_dir):
    m = histories(spark, sf_dir).groupBy("tracer_id").agg(F.max("temp").alias("v"))
    return history.even_by_value(m, "v", 20).select("tracer_id", "v")


# ---- interpolation ---------------------------------------------------------------------------------------

_D = "case when s{a}*s{b} > 0 then 3*(h{a}+h{b}) / ((2*h{b}+h{a})/s{a} + (h{b}+2*h{a})/s{b}) else 0 end"


@query(f"""with {TRAJ}, n as (select tracer_id, seq, temp as v0, time as x0, lead(temp, 1) over w as v1, lead(time, 1) over w as x1, lead(temp, 2) over w as v2, lead(time, 2) over w as x2, lead(temp, 3) over w as v3, lead(time, 3) over w as x3
    from traj window w as (partition by tracer_id order by time, seq)),
  s as (select *, x1-x0 as h0, x2-x1 as h1, x3-x2 as h2, (v1-v0)/(x1-x0) as s0, (v2-v1)/(x2-x1) as s1, (v3-v2)/(x3-x2) as s2 from n where v3 is not null),
  d as (select *, {_D.format(a=0, b=1)} as d1, {_D.format(a=1, b=2)} as d2 from s)
  select tracer_id, seq, round(v1*(1+2*0.3)*0.7*0.7 + v2*(3-2*0.3)*0.3*0.3 + h1*(d1*0.3*0.7*0.7 - d2*0.3*0.3*0.7), 6) as value from d""")
def i1_monotone_cubic(spark, sf_dir):
    w = history.by_time("seq")
    t = histories(spark, sf_dir)
    n = t.select("tracer_id", "seq", *(F.lead("temp", i).over(w).alias(f"v{i}") for i in range(4)), *(F.lead("time", i).over(w).alias(f"x{i}") for i in range(4))).where("v3 is not null")
    x = [F.col(f"x{i}") for i in range(4)]
    return n.select("tracer_id", "seq", rounded(stencil.pchip4(x, [F.col(f"v{i}") for i in range(4)], x[1] + 0.3 * (x[2] - x[1]))).alias("value"))


def _lag(i: int) -> str:
    return " * ".join(f"((x1+x2)/2 - x{j})/(x{i} - x{j})" for j in range(4) if j != i)


@query(f"""with {TRAJ}, n as (select tracer_id, seq, time as x0, lead(time, 1) over w as x1, lead(time, 2) over w as x2, lead(time, 3) over w as x3 from traj window w as (partition by tracer_id order by time, seq))
  select tracer_id, seq, {', '.join(f'round({_lag(i)}, 6) as w{i}' for i in range(4))} from n where x3 is not null""")
def i8_midpoint_weights(spark, sf_dir):
    w = history.by_time("seq")
    n = histories(spark, sf_dir).select("tracer_id", "seq", *(F.lead("time", i).over(w).alias(f"x{i}") for i in range(4))).where("x3 is not null")
    return n.select("tracer_id", "seq", *(rounded(c).alias(f"w{i}") for i, c in enumerate(stencil.midpoint_weight_columns([F.col(f"x{i}") for i in range(4)]))))


def _grid(spark, sf_dir, n=12):
    """A field on n x n x n cells, its values averages of line items dealt to the cells."""
    li = read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") % n, F.col("l_partkey") % n, F.col("l_suppkey") % n
    cells = li.groupBy(*(k.cast("int").alias(a) for k, a in zip(key, "ijk", strict=True))).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return cells.withColumn("time_idx", F.lit(0))


_GRID = "cells as (select cast(l_orderkey % 12 as integer) as i, cast(l_partkey % 12 as integer) as j, cast(l_suppkey % 12 as integer) as k, round(avg(l_quantity), 6) as v from lineitem group by 1, 2, 3)"


def _points(spark, sf_dir):
    """Points of which some lie outside the grid's 0 to 11."""
    p = positions(spark, sf_dir, 16.0)
    return p.select(F.col("tracer_id").alias("point_id"), F.lit(0).alias("time_idx"), *((F.col(c) + 5.5).alias(f"f{a}") for c, a in zip("xyz", "ijk", strict=True)))


_AXIS = tuple(float(i) for i in range(12))
_CUBE = Grid((_AXIS, _AXIS, _AXIS), spherical=False)
_POINTS = f"{_pos(16.0)}, q as (select tracer_id as point_id, x + 5.5 as fi, y + 5.5 as fj, z + 5.5 as fk from pos)"
_LINEAR = f"""with {_GRID}, {_POINTS},
  o as (select unnest([0, 1]) as d), c as (select q.*, a.d as di, b.d as dj, e.d as dk from q, o a, o b, o e),
  w as (select point_id, cast(floor(fi) + di as integer) as i, cast(floor(fj) + dj as integer) as j, cast(floor(fk) + dk as integer) as k,
    (case when di = 0 then 1 - (fi - floor(fi)) else fi - floor(fi) end) * (case when dj = 0 then 1 - (fj - floor(fj)) else fj - floor(fj) end) * (case when dk = 0 then 1 - (fk - floor(fk)) else fk - floor(fk) end) as w from c)
  select point_id, case when sum(case when v is not null then w end) > 1 - 1e-9 then round(sum(w * v), 6) else -1 end as v from w left join cells using (i, j, k) group by 1"""


def _shown(df: DataFrame, *names: str) -> list[Column]:
    """Rounded columns with -1 for NaN."""
    return [F.when(F.isnan(n), F.lit(-1.0)).otherwise(rounded(n)).alias(n) for n in names]


@query(_LINEAR)
def j1_linear_gather(spark, sf_dir):
    out = gather.gather_linear(_points(spark, sf_dir), _grid(spark, sf_dir), ["v"])
    return out.select("point_id", *_shown(out, "v"))


def _by_tiles(spark, sf_dir, method: str) -> DataFrame:
    return tiles.gather(_points(spark, sf_dir), _grid(spark, sf_dir), _CUBE, ["v"], method, place=("fi", "fj", "fk"), kind="coordinates", size=4)


@query(_LINEAR)
def i4_linear_by_tiles(spark, sf_dir):
    out = _by_tiles(spark, sf_dir, "linear")
    return out.select("point_id", *_shown(out, "v"))


def _cardinal(degree: int, n: int = 12) -> str:
    """SQL's rows (cell, node, power, factor) of the not-a-knot spline through n even nodes: in a cell the polynomial in the
    distance from its lower node that is 1 at the node and 0 at others, from a dense system of truncated powers."""
    import numpy as np

    cut = (degree + 1) // 2
    inner = np.arange(cut, n - cut, dtype=float)
    powers = lambda x: np.concatenate([(x[:, None] / n) ** np.arange(degree + 1), np.maximum((x[:, None] - inner) / n, 0) ** degree], 1)
    factors = np.linalg.solve(powers(np.arange(n, dtype=float)), np.eye(n))
    rows = []
    for cell in range(n - 1):
        steps = np.linspace(0, 1, degree + 1)
        local = np.linalg.solve(steps[:, None] ** np.arange(degree + 1), powers(cell + steps) @ factors)
        rows += [f"({cell},{node},{p},{float(local[p, node])!r})" for node in range(n) for p in range(degree + 1)]
    return f"(values {','.join(rows)}) b(cell, node, p, f)"


def _spline_sql(degree: int) -> str:
    weights = lambda a: f"w{a} as (select point_id, node as {a}, sum(f * pow(f{a} - cell, p)) as w from q join basis on cell = least(cast(floor(f{a}) as integer), 10) where f{a} between 0 and 11 group by 1, 2)"
    return f"""with {_GRID}, {_POINTS}, basis as (select * from {_cardinal(degree)}), {weights('i')}, {weights('j')}, {weights('k')},
  s as (select point_id, sum(wi.w * wj.w * wk.w * coalesce(cells.v, 25)) as v from wi join wj using (point_id) join wk using (point_id) left join cells using (i, j, k) group by 1)
  select point_id, coalesce(round(s.v, 5), -1) as v from q left join s using (point_id)"""


def _by_splines(spark, sf_dir, method: str) -> DataFrame:
    n = 12
    cell = {a: F.floor(F.col("id") / n**p).cast("int") % n for a, p in zip("ijk", (2, 1, 0), strict=True)}
    full = spark.range(n**3).select(F.lit(0).alias("time_idx"), *(c.alias(a) for a, c in cell.items())).join(_grid(spark, sf_dir), ["time_idx", "i", "j", "k"], "left").withColumn("v", F.coalesce("v", F.lit(25.0)))
    coefficients = splines.fitted(full, _CUBE, ["v"], method)
    out = tiles.gather(_points(spark, sf_dir), coefficients, _CUBE, ["v"], method, place=("fi", "fj", "fk"), kind="coordinates", size=4)
    return out.select("point_id", F.when(F.isnan("v"), F.lit(-1.0)).otherwise(rounded("v", 5)).alias("v"))


@query(_spline_sql(3))
def i4_cubic_spline_gather(spark, sf_dir):
    """Global cubic splines, cells that no line item is dealt to being 25."""
    return _by_splines(spark, sf_dir, "cubic")


@query(_spline_sql(5))
def i4_quintic_spline_gather(spark, sf_dir):
    return _by_splines(spark, sf_dir, "quintic")


@query(f"""with {_GRID}, {_POINTS} select point_id, case when v is not null and fi between 0 and 11 and fj between 0 and 11 and fk between 0 and 11 then v else -1 end as v from q left join cells on i = floor(fi + 0.5) and j = floor(fj + 0.5) and k = floor(fk + 0.5)""")
def i4_nearest_gather(spark, sf_dir):
    out = _by_tiles(spark, sf_dir, "nearest")
    return out.select("point_id", *_shown(out, "v"))


def _inner(a: str, b: str) -> str:
    return f"case when ({a})*({b}) > 0 then 2*({a})*({b})/(({a})+({b})) else 0 end"


def _end(a: str, b: str) -> str:
    d = f"((3*({a})-({b}))/2)"
    return f"case when sign({d}) <> sign({a}) then 0 when sign({a}) <> sign({b}) and abs({d}) > 3*abs({a}) then 3*({a}) else {d} end"


def _cubic(part: str, first: str, last: str) -> str:
    """SQL of the monotone cubic of v0 .. v3, a unit apart, with end slopes where ``first`` or ``last`` holds."""
    d1 = f"(case when {first} then {_end('v2-v1', 'v3-v2')} else {_inner('v1-v0', 'v2-v1')} end)"
    d2 = f"(case when {last} then {_end('v2-v1', 'v1-v0')} else {_inner('v2-v1', 'v3-v2')} end)"
    whole = f"v1 is not null and v2 is not null and (v0 is not null or {first}) and (v3 is not null or {last})"
    return f"case when {whole} then v1*(1+2*{part})*(1-{part})*(1-{part}) + v2*(3-2*{part})*{part}*{part} + {d1}*{part}*(1-{part})*(1-{part}) - {d2}*{part}*{part}*(1-{part}) end"


def _pivot(by: str, axis: str, cell: str, value: str) -> str:
    return ", ".join(f"max(case when {axis} = {cell} + {d - 1} then {value} end) as v{d}" for d in range(4))


def _monotone(ends: bool) -> str:
    """SQL of the cubic along i with end slopes, then j and k, there with end slopes only if ``ends``."""
    edge = lambda c: (f"{c} = 0", f"{c} = 10") if ends else ("false", "false")
    return f"""with {_GRID}, {_POINTS}, c as (select *, least(floor(fi), 10) as ci, least(floor(fj), 10) as cj, least(floor(fk), 10) as ck from q where fi between 0 and 11 and fj between 0 and 11 and fk between 0 and 11),
  s as (select point_id, fi - ci as pi, fj - cj as pj, fk - ck as pk, ci, cj, ck, j, k, {_pivot("", "i", "ci", "v")} from c left join cells on i between ci - 1 and ci + 2 and j between cj - 1 and cj + 2 and k between ck - 1 and ck + 2 group by all),
  a as (select point_id, pj, pk, cj, ck, j, k, {_cubic("pi", "ci = 0", "ci = 10")} as v from s),
  t as (select point_id, pj, pk, cj, ck, k, {_pivot("", "j", "cj", "v")} from a group by all), b as (select point_id, pk, ck, k, {_cubic("pj", *edge("cj"))} as v from t),
  u as (select point_id, pk, ck, {_pivot("", "k", "ck", "v")} from b group by all), e as (select point_id, {_cubic("pk", *edge("ck"))} as v from u)
  select q.point_id, coalesce(round(e.v, 6), -1) as v from q left join e using (point_id)"""


@query(_monotone(False))
def i2_monotone_gather(spark, sf_dir):
    out = _by_tiles(spark, sf_dir, "pchip")
    return out.select("point_id", *_shown(out, "v"))


@query(_monotone(True))
def i4_regular_cubic_gather(spark, sf_dir):
    out = _by_tiles(spark, sf_dir, "regular_pchip")
    return out.select("point_id", *_shown(out, "v"))


@query(f"""with {_POINTS} select point_id, case when fi between 0 and 11 and fj between 0 and 11 and fk between 0 and 11 then cast(floor(least(fi, 10) / 4) * 9 + floor(least(fj, 10) / 4) * 3 + floor(least(fk, 10) / 4) as bigint) else -1 end as tile from q""")
def t9_locality_tiles(spark, sf_dir):
    """Where particles are dealt to, so that neighbours read the same part of the field."""
    return tiles.located(_points(spark, sf_dir), _CUBE, 4, ["fi", "fj", "fk"], "coordinates").select("point_id", "tile")


@query(f"""with {_pos(30.0)}, s as (select tracer_id, floor((x + 8) / 16 * 8) as a, floor((y + 8) / 16 * 8) as b, floor((z + 8) / 16 * 8) as c from pos)
  select tracer_id, cast(case when least(a, b, c) < 0 or greatest(a, b, c) > 7 then -1 when a < 2 and b < 2 and c < 2 then 1000 + a*4 + b*2 + c else floor(a / 2)*16 + floor(b / 2)*4 + floor(c / 2) end as bigint) as block_id from s""")
def j2_block_location(spark, sf_dir):
    """Blocks of two cells; the corner root cell is refined once more (its slots are blocks of their own)."""
    p = positions(spark, sf_dir, 30.0).select("tracer_id", F.col("x").alias("x1"), F.col("y").alias("x2"), F.col("z").alias("x3"))
    slots = spark.range(512).select(*(F.floor(F.col("id") / d).cast("int").bitwiseAND(F.lit(7)).alias(f"s{n}") for n, d in ((1, 64), (2, 8), (3, 1))))
    fine = F.greatest("s1", "s2", "s3") < 2
    block = F.when(fine, 1000 + F.col("s1") * 4 + F.col("s2") * 2 + F.col("s3")).otherwise(F.floor(F.col("s1") / 2) * 16 + F.floor(F.col("s2") / 2) * 4 + F.floor(F.col("s3") / 2))
    faces = [-8.0, -4.0, 0.0, 4.0, 8.0]
    found = gather.locate_blocks(p, slots.withColumn("block_id", block.cast("long")), {a: faces for a in ("x1", "x2", "x3")}, 1, {a: 1 for a in ("x1", "x2", "x3")})
    return found.select("tracer_id", F.coalesce("block_id", F.lit(-1)).alias("block_id"))


# ---- seeds -----------------------------------------------------------------------------------------------


def _shells(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spec_id"), F.lit(1.0).alias("r_min"), (2 + F.col("s_suppkey") % 5).cast("double").alias("r_max"))


_CELLS = """cells as (select s_suppkey as spec_id, ir, ith, iph, pow(2.0 + s_suppkey % 5, ir / 4.0) as r0, pow(2.0 + s_suppkey % 5, (ir + 1) / 4.0) as r1, acos(1 - 2 * ith / 3.0) as th0, acos(greatest(1 - 2 * (ith + 1) / 3.0, -1)) as th1,
  2*pi()*iph/6 as ph0, 2*pi()*(iph+1)/6 as ph1, s_suppkey * 72 + (ir * 3 + ith) * 6 + iph as tracer_id from supplier, range(4) a(ir), range(3) b(ith), range(6) c(iph))"""


@query(f"""with {_CELLS} select tracer_id, round((r0+r1)/2 * sin((th0+th1)/2) * cos((ph0+ph1)/2), 8) as x, round((r0+r1)/2 * sin((th0+th1)/2) * sin((ph0+ph1)/2), 8) as y, round((r0+r1)/2 * cos((th0+th1)/2), 8) as z,
  round((r0+r1)/2*(r0+r1)/2 * sin((th0+th1)/2) * (r1-r0)*(th1-th0)*(ph1-ph0), 8) as dV from cells""")
def g1_volume_seeds(spark, sf_dir):
    cells = seeding.volume_cells(_shells(spark, sf_dir), 4, 3, 6)
    return cells.select("tracer_id", *(rounded(c, 8).alias(c) for c in ("x", "y", "z", "dV")))


_GL = "gl as (select * from (values (-0.5773502691896257, 1.0), (0.5773502691896257, 1.0)) v(q, w))"


@query(f"""with {_CELLS}, {_GL}, n as (select tracer_id, (r0+r1)/2 + (r1-r0)/2*a.q as r, (th0+th1)/2 + (th1-th0)/2*b.q as th, (ph0+ph1)/2 + (ph1-ph0)/2*c.q as ph,
    a.w*b.w*c.w*(r1-r0)/2*(th1-th0)/2*(ph1-ph0)/2 as w from cells, gl a, gl b, gl c)
  select tracer_id, round(sum(w*r*r*sin(th)*(1 + 0.5*sin(2*ph + 0.8))*4/(1 + r*r)), 7) as mass from n group by 1""")
def g3_volume_masses(spark, sf_dir):
    density = lambda r, th, ph: (1 + 0.5 * F.sin(2 * ph + 0.8)) * 4 / (1 + r * r)
    return seeding.volume_masses(seeding.volume_cells(_shells(spark, sf_dir), 4, 3, 6), density).select("tracer_id", rounded("mass", 7).alias("mass"))


@query(f"""with {_GL}, s as (select s_suppkey as spec_id, 2.0 + s_suppkey % 3 as radius from supplier),
  c as (select s.*, 1 - 2*ith/3.0 as mu0, 1 - 2*(ith+1)/3.0 as mu1, 2*pi()*iph/4 as ph0, 2*pi()*(iph+1)/4 as ph1, spec_id*12 + ith*4 + iph as tracer_id from s, range(3) a(ith), range(4) b(iph)),
  t as (select c_custkey % (select count(*) from supplier) as spec_id, c_custkey % 4 as slot, c_acctbal / 1000 as time, count(*) over (partition by c_custkey % (select count(*) from supplier), c_custkey % 4) as n_files from customer),
  n as (select tracer_id, slot, radius, (mu0+mu1)/2 + (mu0-mu1)/2*a.q as mu, (ph0+ph1)/2 + (ph1-ph0)/2*b.q as ph, a.w*b.w*(mu0-mu1)/2*(ph1-ph0)/2 as w, time, n_files from c join t using (spec_id), gl a, gl b)
  select tracer_id, slot, round(sum(w*radius*radius*(1 + mu*mu)*(2 + sin(ph))*(1 + time/100) * 0.5 / n_files), 6) as mass from n group by 1, 2""")
def g2_surface_masses(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier")
    n = suppliers.count()
    specs = suppliers.select(F.col("s_suppkey").alias("spec_id"), (2.0 + F.col("s_suppkey") % 3).alias("radius"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") % n).alias("spec_id"), (F.col("c_custkey") % 4).alias("slot"), (F.col("c_acctbal") / 1000).alias("time"), F.lit(0.5).alias("dt"))
    slots = c.withColumn("n_files", F.count(F.lit(1)).over(Window.partitionBy("spec_id", "slot")))
    flux = lambda r, mu, ph, t: (1 + mu * mu) * (2 + F.sin(ph)) * (1 + t / 100)
    return seeding.surface_masses(seeding.surface_cells(specs, 3, 4), slots, flux, 2).select("tracer_id", "slot", rounded("mass").alias("mass"))


@query("""with s as (select p_partkey as spec_id, 0.5 + p_size / 10.0 as radius, 0.1 as width, p_retailprice / 1000 as rho from part)
  select spec_id * 6 + iph as tracer_id, round(radius * cos(2*pi()*iph/6), 8) as x, round(radius * sin(2*pi()*iph/6), 8) as y, round(rho*radius*width*(2*pi()/6), 8) as mass from s, range(6) a(iph)""")
def g9_rings(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), (0.5 + F.col("p_size") / 10.0).alias("radius"), F.lit(0.1).alias("width"), (F.col("p_retailprice") / 1000).alias("rho"))
    return seeding.rings(p, 6).select("tracer_id", *(rounded(c, 8).alias(c) for c in ("x", "y", "mass")))


# ---- steps -----------------------------------------------------------------------------------------------

_WIND = DiskWind()
_SPIN = "0.4 * pow(0.75 / greatest(sqrt(({x})*({x})+({y})*({y})+({z})*({z})), 1e-12), 2)"


def _v(x: str, y: str, z: str, t: str) -> tuple[str, str, str]:
    spin = _SPIN.format(x=x, y=y, z=z)
    return f"(({x})/(({t})+15.0) - {spin}*({y}))", f"(({y})/(({t})+15.0) + {spin}*({x}))", f"(({z})/(({t})+15.0))"


def _state(spark, sf_dir):
    return positions(spark, sf_dir).withColumn("time", F.lit(0.0))


def _recursive(body: str) -> str:
    return f"with recursive {_pos()}, s(tracer_id, x, y, z, n) as (select tracer_id, x, y, z, 0 from pos union all {body}) select tracer_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from s where n = 4"


_V0 = _v("x", "y", "z", "n*0.5")


@query(_recursive(f"select tracer_id, x + 0.5*{_V0[0]}, y + 0.5*{_V0[1]}, z + 0.5*{_V0[2]}, n + 1 from s where n < 4"))
def t4_forward_euler(spark, sf_dir):
    return _final(advance.column_steps(_state(spark, sf_dir), _WIND, "euler", 0.5, 4))


_V1 = _v("x + 0.5*a", "y + 0.5*b", "z + 0.5*c", "n*0.5 + 0.5")


@query(_recursive(f"""select tracer_id, x + 0.25*(a + {_V1[0]}), y + 0.25*(b + {_V1[1]}), z + 0.25*(c + {_V1[2]}), n + 1
  from (select *, {_V0[0]} as a, {_V0[1]} as b, {_V0[2]} as c from s where n < 4) q"""))
def t1_explicit_trapezoid(spark, sf_dir):
    return _final(advance.column_steps(_state(spark, sf_dir), _WIND, "expl_trap", 0.5, 4))


_K2 = _v("x + 0.25*a", "y + 0.25*b", "z + 0.25*c", "n*0.5 + 0.25")
_K3 = _v("x + 0.25*a2", "y + 0.25*b2", "z + 0.25*c2", "n*0.5 + 0.25")
_K4 = _v("x + 0.5*a3", "y + 0.5*b3", "z + 0.5*c3", "n*0.5 + 0.5")


@query(_recursive(f"""select tracer_id, x + 0.5/6*(a + 2*a2 + 2*a3 + {_K4[0]}), y + 0.5/6*(b + 2*b2 + 2*b3 + {_K4[1]}), z + 0.5/6*(c + 2*c2 + 2*c3 + {_K4[2]}), n + 1
  from (select *, {_K3[0]} as a3, {_K3[1]} as b3, {_K3[2]} as c3 from (select *, {_K2[0]} as a2, {_K2[1]} as b2, {_K2[2]} as c2 from (select *, {_V0[0]} as a, {_V0[1]} as b, {_V0[2]} as c from s where n < 4) q) q) q"""))
def t3_runge_kutta(spark, sf_dir):
    return _final(advance.column_steps(_state(spark, sf_dir), _WIND, "rk4", 0.5, 4))


def _final(df: DataFrame) -> DataFrame:
    return df.select("tracer_id", *(rounded(c).alias(c) for c in "xyz"))


def _carried(spark, sf_dir, flow, scheme: str, times: list[float], **options) -> DataFrame:
    state = advance.seed_state(positions(spark, sf_dir), F.lit(times[0]))
    return advance.advance_chunk(state, flow, times, scheme, records_only_last=True, **options)


@query()
def t2_implicit_trapezoid(spark, sf_dir):
    return _final(_carried(spark, sf_dir, _WIND, "impl_trap", [0.1 * n for n in range(31)]))


@query()
def t6_blast_wave_chunk(spark, sf_dir):
    return _final(_carried(spark, sf_dir, BlastWave(), "rk4", [1 + 0.1 * n for n in range(31)], mode="monotone"))


@query()
def t11_backward(spark, sf_dir):
    return _final(_carried(spark, sf_dir, _WIND, "rk4", [3 - 0.1 * n for n in range(31)]))


@query(f"""with {_pos(20.0)}, a as (select tracer_id, x - 0.5 as dx, y - 0.3 as dy, tracer_id % 4 as t from pos), b as (select *, sqrt(dx*dx + dy*dy) / pow(1.0 + t, 0.8) as xi, 1 + 0.5 * sin(2 * atan2(dy, dx) + 0.8) as u from a),
  c as (select *, 0.5 * (1 - tanh((xi - 1) / 0.06)) as f from b) select tracer_id, round(u * (1 - f) + 0.05 * f + 4 * u * exp(-pow((xi - 1) / 0.08, 2)), 6) as rho from c""")
def g8_blast_density(spark, sf_dir):
    p = positions(spark, sf_dir, 20.0)
    return p.select("tracer_id", rounded(BlastWave().density(F.col("x"), F.col("y"), F.col("z"), F.col("tracer_id") % 4)).alias("rho"))


@query()
def a15_error_of_fixed_steps(spark, sf_dir):
    """By zone of the starting radius, the RMS distance of a fixed-step path through a blast from the adaptive one."""
    start = positions(spark, sf_dir, 8.0).select("tracer_id", "x", "y", "z", F.lit(1.0).alias("time"), F.lit("active").alias("status"))
    times = [1 + 0.1 * n for n in range(31)]
    truth = advance.reference(start, BlastWave(), [times[-1]]).select("tracer_id", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    got = advance.advance_chunk(start, BlastWave(), times, "rk4", records_only_last=True, mode="monotone").select("tracer_id", "x", "y", "z")
    far = F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    zone = start.select("tracer_id", F.floor(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).cast("int").alias("zone"))
    errors = got.join(truth, "tracer_id").join(zone, "tracer_id").select("zone", far.alias("e"))
    return history.rms(errors, "e", "zone").select("zone", rounded("rms").alias("rms"))


_SIDE = tuple(float(i) for i in range(6))
_BOX = Grid((_SIDE, _SIDE, _SIDE), spherical=False)
_FLOW = """flow as (select cast(l_linenumber % 2 as integer) as time_idx, cast(l_orderkey % 6 as integer) as i, cast(l_partkey % 6 as integer) as j, cast(l_suppkey % 6 as integer) as k,
  round((avg(l_discount) - 0.05) * 20, 6) as vx, round((avg(l_tax) - 0.04) * 20, 6) as vy, round((avg(l_quantity) - 25) / 20, 6) as vz, round(avg(l_extendedprice) / 1000, 6) as rho from lineitem group by 1, 2, 3, 4), o as (select unnest([0, 1]) as d)"""


def _flow(spark, sf_dir) -> DataFrame:
    """FIELD of two snapshots on 6 x 6 x 6 cells, its values averages of line items dealt to the cells."""
    li = read(spark, sf_dir, "lineitem")
    key = (F.col("l_linenumber") % 2, F.col("l_orderkey") % 6, F.col("l_partkey") % 6, F.col("l_suppkey") % 6)
    value = {"vx": (F.avg("l_discount") - 0.05) * 20, "vy": (F.avg("l_tax") - 0.04) * 20, "vz": (F.avg("l_quantity") - 25) / 20, "rho": F.avg("l_extendedprice") / 1000}
    return li.groupBy(*(k.cast("int").alias(a) for k, a in zip(key, ("time_idx", "i", "j", "k"), strict=True))).agg(*(rounded(v).alias(n) for n, v in value.items()))


def _trilinear(name: str, points: str, time: str, ids: str = "id") -> str:
    """SQL of ``name``: id and the flow's values at ``points`` (id, x, y, z), null outside."""
    place = lambda c, d: f"cast(floor({c}) + {d}.d as integer)"
    part = lambda c, d: f"(case when {d}.d = 0 then 1 - ({c} - floor({c})) else {c} - floor({c}) end)"
    found = "sum(case when f.i is not null then w end) > 1 - 1e-9"
    values = ", ".join(f"case when {found} then sum(w * {v}) end as {v}" for v in ("vx", "vy", "vz", "rho"))
    return f"""{name}w as (select p.id, {time} as time_idx, {place('x', 'a')} as i, {place('y', 'b')} as j, {place('z', 'c')} as k, {part('x', 'a')} * {part('y', 'b')} * {part('z', 'c')} as w from {points} p, o a, o b, o c),
  {name} as (select w.id, {values} from {name}w w left join flow f using (time_idx, i, j, k) group by 1)"""


@query(f"""with {_FLOW}, {_pos(8.0)}, p0 as (select tracer_id as id, x + 2.5 as x, y + 2.5 as y, z + 2.5 as z from pos), {_trilinear('g0', 'p0', '0')},
  p1 as (select id, x + 0.5*vx as x, y + 0.5*vy as y, z + 0.5*vz as z from p0 join g0 using (id) where vx is not null), {_trilinear('g1', 'p1', '1')},
  p2 as (select p0.id, x + 0.25*(g0.vx + g1.vx) as x, y + 0.25*(g0.vy + g1.vy) as y, z + 0.25*(g0.vz + g1.vz) as z from p0 join g0 using (id) join g1 using (id) where g1.vx is not null), {_trilinear('g2', 'p2', '1')}
  select id as tracer_id, 0 as time_idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, coalesce(round(rho, 6), -1) as rho from p0 left join g0 using (id)
  union all select id, 1, round(x, 6), round(y, 6), round(z, 6), coalesce(round(rho, 6), -1) from p2 left join g2 using (id)""")
def t7_step_through_snapshots(spark, sf_dir):
    """An explicit trapezoid through two snapshots of a gridded field, density read at both records."""
    seeds = positions(spark, sf_dir, 8.0).select("tracer_id", *((F.col(c) + 2.5).alias(c) for c in "xyz"), F.lit(0.0).alias("t0"))
    out = advance.advance_snapshots(seeds, _flow(spark, sf_dir), _BOX, [0.0, 0.5], 0, 1, scratch_path(spark, "steps"), ["rho"], ["vx", "vy", "vz"], "expl_trap", "linear", size=3)
    return out.select("tracer_id", "time_idx", *(rounded(c).alias(c) for c in "xyz"), *_shown(out, "rho"))


@query(f"""with {_FLOW}, {_GL}, c as (select s_suppkey as spec_id, ir, ith, iph, 0.5 * pow(4.0, ir / 2.0) as r0, 0.5 * pow(4.0, (ir + 1) / 2.0) as r1, acos(1 - 2 * ith / 2.0) as th0, acos(greatest(1 - 2 * (ith + 1) / 2.0, -1)) as th1,
    2*pi()*iph/3 as ph0, 2*pi()*(iph+1)/3 as ph1 from supplier, range(2) a(ir), range(2) b(ith), range(3) d(iph)),
  n as (select row_number() over () as id, spec_id * 12 + (ir * 2 + ith) * 3 + iph as tracer_id, (r0+r1)/2 + (r1-r0)/2*a.q as r, (th0+th1)/2 + (th1-th0)/2*b.q as th, (ph0+ph1)/2 + (ph1-ph0)/2*d.q as ph, a.w*b.w*d.w*(r1-r0)/2*(th1-th0)/2*(ph1-ph0)/2 as w from c, gl a, gl b, gl d),
  p as (select id, tracer_id, w*r*r*sin(th) as weight, 2.5 + r*sin(th)*cos(ph) as x, 2.5 + r*sin(th)*sin(ph) as y, 2.5 + r*cos(th) as z from n), {_trilinear('f0', 'p', '0')}
  select tracer_id, case when count(rho) = count(*) then round(sum(weight * rho), 5) else -1 end as mass from p join f0 using (id) group by 1""")
def g3_masses_on_a_grid(spark, sf_dir):
    """Cells' masses by quadrature of a gridded density."""
    specs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spec_id"), F.lit(0.5).alias("r_min"), F.lit(2.0).alias("r_max"))
    nodes = seeding.volume_nodes(seeding.volume_cells(specs, 2, 2, 3), 2).select("tracer_id", *((F.col(c) + 2.5).alias(c) for c in "xyz"), "w", F.lit(0).alias("time_idx"))
    return seeding.summed(nodes, _flow(spark, sf_dir), _BOX, "rho", method="linear", size=3).select("tracer_id", F.when(F.isnan("mass"), F.lit(-1.0)).otherwise(rounded("mass", 5)).alias("mass"))


# ---- analysis of histories -------------------------------------------------------------------------------


@query("""select cast(least(floor((l_quantity - 1) / (49.0 / 39)) + 1, 39) as integer) as bin, round(sum(l_extendedprice), 2) as mass, count(*) as n from lineitem group by 1""")
def a1_weighted_histogram(spark, sf_dir):
    h = history.weighted_histogram(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1.0, 50.0, 39)
    return h.select("bin", rounded("mass", 2).alias("mass"), "n")


@query("""select cast(least(floor((log10(l_extendedprice) - 2.5) / (3.0 / 40)) + 1, 40) as integer) as bin, round(sum(l_quantity), 4) as mass, count(*) as n from lineitem where l_extendedprice between pow(10, 2.5) and pow(10, 5.5) group by 1""")
def a1_log_histogram(spark, sf_dir):
    h = history.weighted_histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 10**2.5, 10**5.5, 40, log=True)
    return h.select("bin", rounded("mass", 4).alias("mass"), "n")


@query("""with h as (select cast(least(floor((l_extendedprice - 900) / (110000.0 / 80)) + 1, 80) as integer) as bin, sum(l_quantity) as mass from lineitem where l_extendedprice between 900 and 110900 group by 1)
  select bin, round(mass, 4) as mass, round(sum(mass) over (order by bin rows unbounded preceding), 4) as enclosed from h""")
def a3_enclosed_mass(spark, sf_dir):
    h = history.weighted_histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 900.0, 110900.0, 80)
    return history.cumulative(h).select("bin", rounded("mass", 4).alias("mass"), rounded("enclosed", 4).alias("enclosed"))


@query(f"with {TRAJ}, m as (select tracer_id, max(temp) as peak from traj group by 1) select t.tracer_id, min(t.time) as t_peak, m.peak from traj t join m on t.tracer_id = m.tracer_id and t.temp = m.peak group by t.tracer_id, m.peak")
def a5_peak(spark, sf_dir):
    return history.peak(histories(spark, sf_dir))


@query(f"""with {TRAJ}, m as (select tracer_id, max(temp) as peak from traj group by 1), p as (select t.tracer_id, min(t.time) as t_peak from traj t join m on t.tracer_id = m.tracer_id and t.temp = m.peak group by 1)
  select t.tracer_id, t.seq from traj t join p using (tracer_id) where t.time >= p.t_peak""")
def a5_after_peak(spark, sf_dir):
    return history.after_peak(histories(spark, sf_dir)).select("tracer_id", "seq")


@query(f"""with {TRAJ}, g as (select tracer_id, seq, rho, lag(rho) over w as f0, lead(rho) over w as f2, time - lag(time) over w as hs, lead(time) over w - time as hd from traj window w as (partition by tracer_id order by time, seq)),
  d as (select *, case when f0 is null then (f2 - rho)/hd when f2 is null then (rho - f0)/hs else (hs*hs*f2 + (hd*hd - hs*hs)*rho - hd*hd*f0)/(hs*hd*(hd+hs)) end as df from g)
  select tracer_id, seq, case when df is null then -1 when abs(df) < 1e-9 then -2 else round(rho / (abs(df) + 1e-300), 1) end as tau from d""")
def a6_expansion_time(spark, sf_dir):
    t = histories(spark, sf_dir)
    slope = history.gradient(F.col("rho"), F.col("time"), history.by_time("seq"))
    out = t.select("tracer_id", "seq", "rho", slope.alias("df"))
    tau = F.when(F.isnan("df"), F.lit(-1.0)).when(F.abs("df") < 1e-9, F.lit(-2.0)).otherwise(rounded(F.col("rho") / (F.abs("df") + 1e-300), 1))
    return out.select("tracer_id", "seq", tau.alias("tau"))


@query(f"""with {TRAJ}, m as (select tracer_id, max(temp) as peak from traj group by 1), p as (select t.tracer_id, min(t.time) as t_peak from traj t join m on t.tracer_id = m.tracer_id and t.temp = m.peak group by 1),
  s as (select t.tracer_id, t.time, t.seq, temp as b, ye as vb, lag(temp) over w as a, lag(ye) over w as va from traj t join p using (tracer_id) where t.time >= p.t_peak window w as (partition by t.tracer_id order by t.time, t.seq)),
  f as (select *, row_number() over (partition by tracer_id order by time, seq) as r from s where a > 50 and b <= 50)
  select tracer_id, round(va + (vb - va) * (50 - a) / (b - a), 8) as value from f where r = 1""")
def a7_value_when_cooled(spark, sf_dir):
    return history.value_when_cooled(histories(spark, sf_dir), 50.0, "ye", ties=("seq",)).select("tracer_id", rounded("value", 8).alias("value"))


@query(f"""with {TRAJ}, s as (select tracer_id, time, seq, r, ye, lag(time) over w as t0, lag(r) over w as r0, lag(ye) over w as y0 from traj window w as (partition by tracer_id order by time, seq)),
  f as (select *, row_number() over (partition by tracer_id order by time, seq) as n from s where r >= 120)
  select tracer_id, round(case when r0 is null then time else t0 + (time - t0)*(120 - r0)/(r - r0) end, 4) as t_cross, round(case when r0 is null then ye else y0 + (ye - y0)*(120 - r0)/(r - r0) end, 8) as ye from f where n = 1""")
def a8_first_crossing(spark, sf_dir):
    c = history.first_crossing(histories(spark, sf_dir), 120.0, values=("ye",), ties=("seq",))
    return c.select("tracer_id", rounded("t_cross", 4).alias("t_cross"), rounded("ye", 8).alias("ye"))


@query(f"with {TRAJ} select tracer_id, time, temp, ye from (select *, row_number() over (partition by tracer_id order by time desc, seq desc) as n from traj) where n = 1")
def a10_final_state(spark, sf_dir):
    return history.final_state(histories(spark, sf_dir), ["temp", "ye"], ("seq",))


def _daily(spark, sf_dir):
    t = histories(spark, sf_dir).withColumn("day", F.floor(F.col("time") / DAY).cast("double"))
    return t.groupBy("tracer_id", F.col("day").alias("time")).agg(F.max("r").alias("r"))


_DAILY = "daily as (select tracer_id, cast(floor(time / 86400) as double) as time, max(r) as r from traj group by 1, 2)"
_HELD = "held as (select tracer_id, max(time) as t_last, arg_max(r, time) as r_last from daily group by 1)"


@query(f"""with {TRAJ}, {_DAILY}, {_HELD}, t as (select distinct time from daily)
  select h.tracer_id, t.time, case when t.time >= t_last then r_last else coalesce(d.r, 0) end as r from held h cross join t left join daily d on d.tracer_id = h.tracer_id and d.time = t.time""")
def j8_held_to_times(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return history.held_to_times(d, d.select("time"))


_OUTSIDE = f"""{TRAJ}, {PROPS}, {_DAILY}, {_HELD}, t as (select distinct time from daily),
  g as (select h.tracer_id, t.time, case when t.time >= t_last then r_last else coalesce(d.r, 0) end as r from held h cross join t left join daily d on d.tracer_id = h.tracer_id and d.time = t.time),
  m as (select time, sum(case when r >= 60 then mass else 0 end) as mass from g join props using (tracer_id) group by 1)"""


@query(f"with {_OUTSIDE} select time, round(mass, 9) as mass from m")
def a11_mass_outside(spark, sf_dir):
    return history.mass_outside(_daily(spark, sf_dir), masses(spark, sf_dir), 60.0).select("time", rounded("mass", 9).alias("mass"))


@query(f"with {_OUTSIDE}, q as (select time, round(mass, 9) as mass from m) select time, mass, round(coalesce((mass - lag(mass) over (order by time)) / (time - lag(time) over (order by time)), 0), 8) as rate from q")
def a12_mass_rate(spark, sf_dir):
    m = history.mass_outside(_daily(spark, sf_dir), masses(spark, sf_dir), 60.0).select("time", rounded("mass", 9).alias("mass"))
    return history.rate(m).select("time", "mass", rounded("rate", 8).alias("rate"))


@query(f"""with {TRAJ}, {PROPS}, l as (select tracer_id, temp, ye from (select *, row_number() over (partition by tracer_id order by time desc, seq desc) as n from traj) where n = 1)
  select round(sum(case when temp / 50 > 1 then mass else 0 end) / sum(mass), 9) as unbound, count(*) as n from l join props using (tracer_id)""")
def a13_unbound_fraction(spark, sf_dir):
    last = history.final_state(histories(spark, sf_dir), ["temp"], ("seq",)).join(masses(spark, sf_dir), "tracer_id")
    return history.unbound_fraction(last, F.col("temp") / 50).select(rounded("unbound", 9).alias("unbound"), "n")


@query(f"with {TRAJ} select tracer_id, round(avg(temp), 8) as mean, max(temp) as peak, count(*) as n from traj group by 1")
def a14_tracer_means(spark, sf_dir):
    return history.means(histories(spark, sf_dir), "temp").select("tracer_id", rounded("mean", 8).alias("mean"), "peak", "n")


@query("""with e as (select l_linenumber, case when l_orderkey % 19 = 0 then 'nan'::double else l_discount - l_tax end as e from lineitem) select l_linenumber, round(sqrt(avg(case when isnan(e) then null else e * e end)), 9) as rms from e group by 1""")
def a15_rms_error(spark, sf_dir):
    e = F.when(F.col("l_orderkey") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") - F.col("l_tax"))
    li = read(spark, sf_dir, "lineitem").select("l_linenumber", e.alias("e"))
    return history.rms(li, "e", "l_linenumber").select("l_linenumber", rounded("rms", 9).alias("rms"))


@query("""with e as (select l_linenumber as k, avg(l_extendedprice) / pow(2, 2 * l_linenumber) as err from lineitem group by 1) select k, round(log2(lag(err) over (order by k) / err), 6) as order_ from e""")
def a16_convergence_order(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_extendedprice").alias("m")).withColumn("err", F.col("m") / F.pow(F.lit(2.0), 2 * F.col("k")))
    return history.convergence_order(e).select("k", rounded("order_").alias("order_"))


@query("select l_orderkey, l_linenumber, cast((l_quantity >= 1)::int + (l_quantity >= 5)::int + (l_quantity >= 12.5)::int + (l_quantity >= 30)::int + (l_quantity >= 50)::int as integer) as idx from lineitem")
def a20_searchsorted(spark, sf_dir):
    edges = F.array(*map(F.lit, (1.0, 5.0, 12.5, 30.0, 50.0)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stencil.searchsorted(edges, F.col("l_quantity")).alias("idx"))


@query(f"with {TRAJ}, n as (select tracer_id, arg_max(status, (time, seq)) as status from traj group by 1) select status, count(*) as n from n group by 1")
def a22_status_counts(spark, sf_dir):
    last = histories(spark, sf_dir).groupBy("tracer_id").agg(F.max_by("status", F.struct("time", "seq")).alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select p.p_size as zone, round(avg(abs(l_discount - l_tax)), 9) as mean, round(max(abs(l_discount - l_tax)), 9) as most from lineitem join part p on l_partkey = p_partkey group by 1")
def a24_disagreement_by_zone(spark, sf_dir):
    d = F.abs(F.col("l_discount") - F.col("l_tax"))
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return history.disagreement(li.withColumnRenamed("p_size", "zone"), d, "zone").select("zone", rounded("mean", 9).alias("mean"), rounded("most", 9).alias("most"))


@query(f"""with {TRAJ}, {PROPS}, l as (select tracer_id, arg_max(rho, (time, seq)) as rho from traj group by 1)
  select p.tracer_id, round(coalesce(dV * rho, mass), 9) as mass, mass as mass_quad from props p left join l using (tracer_id)""")
def k2_latest_density_mass(spark, sf_dir):
    m = history.latest_density_mass(histories(spark, sf_dir), masses(spark, sf_dir), ties=("seq",))
    return m.select("tracer_id", rounded("mass", 9).alias("mass"), "mass_quad")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then o_totalprice when o_orderkey % 5 = 1 then o_totalprice * 2 else o_totalprice + o_custkey end as v, o_orderkey % 3 = 0 as has_all from orders")
def p6_key_specs(spark, sf_dir):
    """A combined key takes all of its parts; a file that lacks one doesn't have it."""
    from eddyline.functions.keys import key_specs, missing

    o = read(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    raw = o.select("o_orderkey", price.alias("|F|:2"), F.when(k == 0, F.lit(0.0)).when(k == 1, price).otherwise(F.col("o_custkey").cast("double")).alias("|F|:3"))
    spec = key_specs(["F_nux"])
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("|F|:2"), F.lit("|F|:3"))).otherwise(F.array(F.lit("|F|:2")))
    return raw.select("o_orderkey", spec[0].column().alias("v"), (F.size(missing(spec, have)) == 0).alias("has_all"))


@query("""with s as (select c_custkey as tracer_id, c_custkey % 30 as t0 from customer), e as (select distinct cast(floor((epoch_us(ts) - 1704067200000000) / 86400e6) as bigint) as t from events)
  select t as time, count(*) as starting from s join e on s.t0 = e.t group by 1""")
def j4_seed_activation(spark, sf_dir):
    """How many waiting seeds start at each snapshot, where their time is a snapshot's."""
    days = histories(spark, sf_dir).select(F.floor(F.col("time") / DAY).cast("double").alias("time")).distinct()
    times = days.withColumn("time_idx", F.row_number().over(Window.orderBy("time")) - 1)
    seeds = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tracer_id"), (F.col("c_custkey") % 30).cast("double").alias("t0"))
    near = catalog.nearest_time(seeds, times, 1.0).where(catalog.is_close(F.col("t0"), F.col("time")))
    return near.groupBy(F.col("time").cast("long").alias("time")).agg(F.count(F.lit(1)).alias("starting"))


@query("select arg_min(p_partkey, (abs(p_retailprice - 1234.5), p_partkey)) as irad, arg_min(p_retailprice, (abs(p_retailprice - 1234.5), p_partkey)) as r from part")
def j9_nearest_radius(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("irad"), F.col("p_retailprice").alias("r"))
    return catalog.nearest_index(p, 1234.5)


@query(f"""with {TRAJ}, m as (select cast(floor(time / 3600) as double) as time, round(sum(temp), 6) as mdot from traj group by 1)
  select time, round(sum(mdot * dt) over (order by time rows unbounded preceding), 3) as total from (select *, coalesce(lead(time) over (order by time) - time, 0) as dt from m)""")
def a21_running_mass(spark, sf_dir):
    m = histories(spark, sf_dir).groupBy(F.floor(F.col("time") / 3600).cast("double").alias("time")).agg(rounded(F.sum("temp")).alias("mdot"))
    return history.running(m, "mdot").select("time", rounded("total", 3).alias("total"))


@query("""select l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 9) as eps_nue, round(l_tax / l_quantity, 8) as eps_anue, round(l_discount / l_quantity, 8) as eps_nux,
  round(l_quantity / (1 + l_linenumber), 8) as "F_nue", round(l_quantity / (1 + l_linenumber), 8) as "F_anue", round(l_quantity / (1 + l_linenumber), 8) as "F_nux", l_tax as hu_t from lineitem""")
def p9_reduced_surface(spark, sf_dir):
    """Moments become fluxes and energies, and go with the momenta; what else there is stays."""
    li, q = read(spark, sf_dir, "lineitem"), F.col("l_quantity")
    raw = li.select("l_orderkey", "l_linenumber", *(c.alias(f"J_0{n}") for n, c in enumerate((F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")))), *(q.alias(f"n_0{n}") for n in range(3)), (1.0 + F.col("l_linenumber")).alias("sc_sqrt_det_g"), q.alias("st_H_u_t_00"), q.alias("s"), F.col("l_tax").alias("hu_t"))
    out = keys.reduced_moments(raw)
    return out.select("l_orderkey", "l_linenumber", rounded("eps_nue", 9).alias("eps_nue"), *(rounded(c, 8).alias(c) for c in ("eps_anue", "eps_nux", "F_nue", "F_anue", "F_nux")), "hu_t")


@query("""with r as (select epoch_us(ts) // 86400000000 as time, cast(user_id % 12 as varchar) as radius_key, 'group.' || event_type as name, cast(user_id % 5 as integer) as j, cast(event_id % 3 as integer) as k, value from events),
  i as (select time, radius_key, cast(dense_rank() over (partition by time order by cast(radius_key as bigint)) - 1 as integer) as i from (select distinct time, radius_key from r))
  select r.time, i.i, j, k, split_part(name, '.', 2) as key, count(*) as n, round(sum(value), 6) as value from r join i using (time, radius_key) group by all""")
def p10_relaid_surface(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    raw = e.select(day.alias("time"), (F.col("user_id") % 12).cast("string").alias("radius_key"), F.concat(F.lit("group."), "event_type").alias("name"), (F.col("user_id") % 5).alias("j"), (F.col("event_id") % 3).alias("k"), "value")
    return keys.relaid(raw).groupBy("time", "i", "j", "k", "key").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("value"))


@query(f"""with {_pos()} select tracer_id, round(sqrt(x*x+y*y+z*z) * 1.5, 8) as q_r, round(x * pow(sqrt(x*x+y*y+z*z), 3), 6) as q_rho_r3, round(y * 2, 8) as "q_T" from pos""")
def p17_quantities(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("rho", F.col("x")).withColumn("T", F.col("y"))
    out = fields.with_quantities(p, ["r", "rho_r3", "T"], fields.Units(length_km=1.5, temperature_gk=2.0))
    return out.select("tracer_id", rounded("q_r", 8).alias("q_r"), rounded("q_rho_r3").alias("q_rho_r3"), rounded("q_T", 8).alias("q_T"))


@query(f"""with {TRAJ}, n as (select tracer_id, seq, temp as v0, lead(temp, 1) over w as v1, lead(temp, 2) over w as v2, lead(temp, 3) over w as v3, time as x0, lead(time, 1) over w as x1, lead(time, 2) over w as x2, lead(time, 3) over w as x3
    from traj window w as (partition by tracer_id order by time, seq)),
  s as (select *, x1-x0 as h0, x2-x1 as h1, x3-x2 as h2, (v1-v0)/(x1-x0) as s0, (v2-v1)/(x2-x1) as s1, (v3-v2)/(x3-x2) as s2 from n where v3 is not null),
  d as (select *, {_D.format(a=0, b=1)} as d1, {_D.format(a=1, b=2)} as d2 from s)
  select tracer_id, seq, round((v1 + v2) / 2 + h1 * (d1 - d2) / 8, 6) as value from d""")
def i9_midpoint_cubic(spark, sf_dir):
    w = history.by_time("seq")
    n = histories(spark, sf_dir).select("tracer_id", "seq", *(F.lead("temp", i).over(w).alias(f"v{i}") for i in range(4)), *(F.lead("time", i).over(w).alias(f"x{i}") for i in range(4))).where("v3 is not null")
    x = [F.col(f"x{i}") for i in range(4)]
    return n.select("tracer_id", "seq", rounded(stencil.pchip4(x, [F.col(f"v{i}") for i in range(4)], (x[1] + x[2]) / 2)).alias("value"))


@query(f"""with {TRAJ}, n as (select tracer_id, seq, temp as v0, lead(temp) over w as v1, time as x0, lead(time) over w as x1 from traj window w as (partition by tracer_id order by time, seq))
  select tracer_id, seq, round(v0 + (v1 - v0) * 0.25, 6) as value from n where v1 is not null""")
def i10_linear_in_time(spark, sf_dir):
    w = history.by_time("seq")
    n = histories(spark, sf_dir).select("tracer_id", "seq", F.col("temp").alias("v0"), F.lead("temp").over(w).alias("v1"), F.col("time").alias("x0"), F.lead("time").over(w).alias("x1")).where("v1 is not null")
    c = {k: F.col(k) for k in ("x0", "v0", "x1", "v1")}
    return n.select("tracer_id", "seq", rounded(stencil.linear(*c.values(), c["x0"] + 0.25 * (c["x1"] - c["x0"]))).alias("value"))


@query(f"""with {TRAJ}, l as (select tracer_id, count(*) as n, max(time) as t from traj where tracer_id % 5 <> 0 group by 1), e as (select max(time) as t_end from traj)
  select c_custkey as tracer_id, case when coalesce(n, 0) <= 1 then 'not started' when t = t_end then 'active' else 'done' end as status from customer left join l on c_custkey = tracer_id, e""")
def t8_statuses(spark, sf_dir):
    t = histories(spark, sf_dir)
    end = t.agg(F.max("time")).first()[0]
    return advance.statuses(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tracer_id")), t.where("tracer_id % 5 <> 0"), end)


@query("select s_suppkey * 72 + n as tracer_id, true as inside from supplier, range(72) r(n)")
def g6_jittered_seeds(spark, sf_dir):
    """Seeds shifted by a hash stay in their cells."""
    c = seeding.volume_cells(_shells(spark, sf_dir), 4, 3, 6, jitter=5)
    x, y, z = (F.col(n) for n in "xyz")
    r = g.radius(x, y, z)
    th, ph = g.polar(x, y, z), g.azimuth(x, y)
    inside = [v.between(F.col(a) - 1e-9, F.col(b) + 1e-9) for v, a, b in ((r, "r0", "r1"), (th, "th0", "th1"), (ph, "ph0", "ph1"))]
    return c.select("tracer_id", (inside[0] & inside[1] & inside[2]).alias("inside"))


@query("""select s_suppkey * 8 + ith * 4 + iph as tracer_id, round((acos(cos(radians(30)) - (cos(radians(30)) - cos(radians(90))) * ith / 2) + acos(cos(radians(30)) - (cos(radians(30)) - cos(radians(90))) * (ith + 1) / 2)) / 2, 8) as theta,
  round((radians(45) + radians(90) * iph / 4 + radians(45) + radians(90) * (iph + 1) / 4) / 2, 8) as phi from supplier, range(2) a(ith), range(4) b(iph)""")
def g1_angle_limits(spark, sf_dir):
    c = seeding.volume_cells(_shells(spark, sf_dir), 1, 2, 4, (30.0, 90.0, 45.0, 135.0))
    x, y, z = (F.col(n) for n in "xyz")
    return c.select("tracer_id", rounded(g.polar(x, y, z), 8).alias("theta"), rounded(g.azimuth(x, y), 8).alias("phi"))


@query(f"with {TRAJ}, v as (select tracer_id, seq, case when temp / 50 > 1 then sqrt(1 - 1 / ((temp/50)*(temp/50))) else null end as v from traj) select cast(least(floor(v * 40) + 1, 40) as integer) as bin, count(*) as n from v where v is not null group by 1")
def a2_velocity_histogram(spark, sf_dir):
    t = histories(spark, sf_dir).select(g.asymptotic_velocity(F.col("temp") / 50).alias("v"), F.lit(1.0).alias("w"))
    return history.weighted_histogram(t, "v", "w", 0.0, 1.0, 40).select("bin", "n")


@query("""with v as (select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 23 = 0 then '-infinity'::double else value end as x from events)
  select event_id, case when not isnan(x) and abs(x) < 'infinity'::double then 'active' else 'done' end as status from v""")
def f1_finite_positions(spark, sf_dir):
    n = F.col("event_id")
    x = F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 23 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select(n, F.when(g.is_sane(x), F.lit("active")).otherwise(F.lit("done")).alias("status"))


@query(f"with {_pos(30.0)} select tracer_id as point_id, case when greatest(abs(x), abs(y), abs(z)) < 8 then round(x + 2*y + 3*z, 8) else -1 end as value from pos")
def i5_block_gather(spark, sf_dir):
    """Points in and outside blocks of their own nodes, two ghosts a side; the field is linear, which the cubic meets."""
    from eddyline.operators.meshblock import gather_blocks

    p = positions(spark, sf_dir, 30.0)
    place = [F.floor((F.col(c) + 8) / 4).cast("int") for c in "xyz"]
    inside = F.greatest(*(F.abs(F.col(c)) for c in "xyz")) < 8
    points = p.select(F.col("tracer_id").alias("point_id"), *(F.col(c).alias(f"x{n}") for n, c in enumerate("xyz", 1)), F.when(inside, place[0] + 4 * place[1] + 16 * place[2]).alias("block_id"))
    ids = points.where("block_id is not null").select("block_id").distinct()
    axis = lambda d: F.expr(f"transform(sequence(0, 7), i -> double(-8 + 4 * (floor(block_id / {d}) % 4) + i) - 1.5)")
    blocks = ids.select("block_id", axis(1).alias("x1v"), axis(4).alias("x2v"), axis(16).alias("x3v"))
    data = F.expr("flatten(flatten(transform(x3v, z -> transform(x2v, y -> transform(x1v, x -> x + 2 * y + 3 * z)))))")
    got = gather_blocks(points, blocks.withColumn("data", data)).withColumnRenamed("data", "value")
    return got.select("point_id", F.when(F.isnan("value"), F.lit(-1.0)).otherwise(rounded("value", 8)).alias("value"))


_BLOCK_FLOW = """coef as (select cast(l_linenumber % 2 as integer) as time_idx, round(avg(l_quantity) / 40, 6) as w, round(avg(l_tax) * 6, 6) as s from lineitem group by 1)"""


def _refined() -> Octree:
    """Eight root cells an axis in blocks of four, the first of the eight blocks cut in eight again."""
    side = faces(0.0, 8.0, 1.0, 8)
    coarse = [(n, 0, n // 4, n // 2 % 2, n % 2) for n in range(1, 8)]
    return Octree((side, side, side), (4, 4, 4), tuple(coarse + [(8 + n, 1, n // 4, n // 2 % 2, n % 2) for n in range(8)]), spherical=False)


def _blocks(spark, sf_dir, octree: Octree) -> DataFrame:
    """BLOCK of two snapshots of a turning, stretching flow whose rates are averages of line items."""
    li = read(spark, sf_dir, "lineitem")
    rate = li.groupBy((F.col("l_linenumber") % 2).cast("int").alias("time_idx")).agg(rounded(F.avg("l_quantity") / 40).alias("w"), rounded(F.avg("l_tax") * 6).alias("s"))
    geometry = spark.createDataFrame(list(octree.blocks), "block_id long, level int, l1 long, l2 long, l3 long").crossJoin(F.broadcast(rate))
    width = F.pow(F.lit(0.5), F.col("level"))
    nodes_of = lambda first: F.transform(F.sequence(F.lit(-2), F.lit(5)), lambda c: (first * 4 + c + 0.5) * width)
    nodes = {f"x{a}v": nodes_of(F.col(f"l{a}")) for a in (1, 2, 3)}
    cells = F.sequence(F.lit(0), F.lit(511))
    at = lambda c: (F.element_at("x1v", (c % 8 + 1).cast("int")), F.element_at("x2v", (F.floor(c / 8) % 8 + 1).cast("int")), F.element_at("x3v", (F.floor(c / 64) + 1).cast("int")))
    of = lambda f: F.transform(cells, lambda c: f(*at(c)))
    values = {"vx": lambda x, y, z: -F.col("w") * (y - 4), "vy": lambda x, y, z: F.col("w") * (x - 4), "vz": lambda x, y, z: F.col("s") * (z - 4), "rho": lambda x, y, z: x + 2 * y + 3 * z}
    return geometry.withColumns(nodes).select("time_idx", "block_id", "x1v", "x2v", "x3v", "w", "s").select("time_idx", "block_id", "x1v", "x2v", "x3v", *(of(f).alias(k) for k, f in values.items()))


@query(f"""with {_BLOCK_FLOW}, {_pos(12.0)}, p0 as (select tracer_id as id, x + 4 as x, y + 4 as y, z + 4 as z from pos), a as (select * from coef where time_idx = 0), b as (select * from coef where time_idx = 1),
  p1 as (select id, p0.x, p0.y, p0.z, x - w*(y-4) as x1, y + w*(x-4) as y1, z + s*(z-4) as z1, w, s from p0, a where least(x, y, z) >= 0 and greatest(x, y, z) <= 8),
  p2 as (select p1.id, p1.x + 0.5 * (-p1.w*(p1.y-4) - b.w*(y1-4)) as x, p1.y + 0.5 * (p1.w*(p1.x-4) + b.w*(x1-4)) as y, p1.z + 0.5 * (p1.s*(p1.z-4) + b.s*(z1-4)) as z from p1, b where least(x1, y1, z1) >= 0 and greatest(x1, y1, z1) <= 8),
  r as (select id, 0 as time_idx, x, y, z from p0 union all select id, 1, x, y, z from p2)
  select id as tracer_id, time_idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, case when least(x, y, z) >= 0 and greatest(x, y, z) <= 8 then round(x + 2*y + 3*z, 5) else -1 end as rho from r""")
def t6_step_over_blocks(spark, sf_dir):
    """A trapezoid step whose stages cross blocks of two levels."""
    octree = _refined()
    seeds = positions(spark, sf_dir, 12.0).select("tracer_id", *((F.col(c) + 4).alias(c) for c in "xyz"), F.lit(0.0).alias("t0"))
    traj = advance.advance_snapshots(seeds, _blocks(spark, sf_dir, octree), octree, [0.0, 1.0], 0, 1, scratch_path(spark, "blocks"), ["rho"], ["vx", "vy", "vz"], "expl_trap")
    return traj.select("tracer_id", "time_idx", *(rounded(c).alias(c) for c in "xyz"), F.when(F.isnan("rho"), F.lit(-1.0)).otherwise(rounded("rho", 5)).alias("rho"))


_TURN = """turn as (select cast(l_linenumber % 4 as integer) as n, round(avg(l_quantity) / 60, 6) as w, round(avg(l_tax) * 4, 6) as s from lineitem group by 1)"""


def _turning(spark, sf_dir) -> DataFrame:
    """FIELD of four snapshots on 12 x 12 x 12 cells of a flow that turns about (5.5, 5.5) and stretches from z = 5.5, its rates averages
    of line items: linear in space, which the monotone cubic leaves as it is."""
    li = read(spark, sf_dir, "lineitem")
    rate = li.groupBy((F.col("l_linenumber") % 4).cast("int").alias("time_idx")).agg(rounded(F.avg("l_quantity") / 60).alias("w"), rounded(F.avg("l_tax") * 4).alias("s"))
    cells = spark.range(12**3).select(*(F.floor(F.col("id") / 12**p).cast("int") % 12 for p in (2, 1, 0))).toDF("i", "j", "k").crossJoin(F.broadcast(rate))
    x, y, z = (F.col(c) - 5.5 for c in "ijk")
    return cells.select("time_idx", "i", "j", "k", (-F.col("w") * y).alias("vx"), (F.col("w") * x).alias("vy"), (F.col("s") * z).alias("vz"), (x + 2 * y + 3 * z).alias("rho"))


def _stepped(spark, sf_dir, scheme: str, start: int, end: int, **options) -> DataFrame:
    seeds = positions(spark, sf_dir, 6.0).select("tracer_id", *((F.col(c) + 5.5).alias(c) for c in "xyz"), F.lit(0.5 * start).alias("t0"))
    traj = advance.advance_snapshots(seeds, _turning(spark, sf_dir), _CUBE, [0.0, 0.5, 1.0, 1.5], start, end, scratch_path(spark, "turning"), ["rho"], ["vx", "vy", "vz"], scheme, size=4, **options)
    return traj.where(F.col("time_idx") == end).select("tracer_id", *(rounded(c, 5).alias(c) for c in "xyz"), F.when(F.isnan("rho"), F.lit(-99.0)).otherwise(rounded("rho", 4)).alias("rho"))


_IN = "least(x, y, z) >= 0 and greatest(x, y, z) <= 11"
_END = f"select id as tracer_id, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z, case when {_IN} then round(x + 2*y + 3*z - 33, 4) else -99 end as rho"


def _stage(name: str, base: str, after: str, w: str, s: str, h: str) -> str:
    """SQL of a stage: where ``base`` gets by the velocity of rates w and s at ``after`` in time h, while that is in the grid."""
    return f"""{name} as (select b.id, b.x - {h}*{w}*(a.y - 5.5) as x, b.y + {h}*{w}*(a.x - 5.5) as y, b.z + {h}*{s}*(a.z - 5.5) as z, -{w}*(a.y - 5.5) as vx, {w}*(a.x - 5.5) as vy, {s}*(a.z - 5.5) as vz
    from {base} b join {after} a using (id), r where a.x between 0 and 11 and a.y between 0 and 11 and a.z between 0 and 11)"""


_RATES = f"{_TURN}, r as (select " + ", ".join(f"max(case when n = {n} then {c} end) as {c}{n}" for n in range(4) for c in "ws") + f" from turn), {_pos(6.0)}, p0 as (select tracer_id as id, x + 5.5 as x, y + 5.5 as y, z + 5.5 as z from pos)"
_MID = {c: f"((-{c}0 + 9*{c}1 + 9*{c}2 - {c}3) / 16)" for c in "ws"}


@query(f"""with {_RATES}, {_stage('a', 'p0', 'p0', 'w1', 's1', '0.25')}, {_stage('b', 'p0', 'a', _MID['w'], _MID['s'], '0.25')}, {_stage('c', 'p0', 'b', _MID['w'], _MID['s'], '0.5')}, {_stage('d', 'p0', 'c', 'w2', 's2', '0.5')},
  e as (select id, p0.x + 0.5/6*(a.vx + 2*b.vx + 2*c.vx + d.vx) as x, p0.y + 0.5/6*(a.vy + 2*b.vy + 2*c.vy + d.vy) as y, p0.z + 0.5/6*(a.vz + 2*b.vz + 2*c.vz + d.vz) as z from p0 join a using (id) join b using (id) join c using (id) join d using (id))
  {_END} from e""")
def t7_runge_kutta_of_four_snapshots(spark, sf_dir):
    """Middle velocities from the four snapshots around the step, values by the monotone cubic."""
    return _stepped(spark, sf_dir, "rk4", 1, 2, mode="lagrange")


@query(f"""with {_RATES}, {_stage('a', 'p0', 'p0', 'w0', 's0', '0.25')}, i as (select a.*, 0.25*w1 as k, 0.25*s1 as m from a, r),
  e as (select id, 5.5 + ((x-5.5) - k*(y-5.5)) / (1 + k*k) as x, 5.5 + ((y-5.5) + k*(x-5.5)) / (1 + k*k) as y, 5.5 + (z-5.5) / (1 - m) as z from i)
  {_END} from e where {_IN}""")
def t6_implicit_step_on_a_grid(spark, sf_dir):
    """The implicit step of a linear flow, against the linear system's solution; those that it takes off the grid are left out."""
    return _stepped(spark, sf_dir, "impl_trap", 0, 1, tol=1e-12, max_iter=60).where("rho > -99")


def _heun(n: int) -> str:
    """SQL of an explicit trapezoid from p<n> at snapshot n to p<n+1>, of those whose stages are in the grid."""
    a, b = _stage(f"a{n}", f"p{n}", f"p{n}", f"w{n}", f"s{n}", "0.5"), _stage(f"b{n}", f"p{n}", f"a{n}", f"w{n + 1}", f"s{n + 1}", "0.5")
    moved = ", ".join(f"p.{c} + 0.25*(a.v{c} + b.v{c}) as {c}" for c in "xyz")
    return f"{a}, {b}, p{n + 1} as (select p.id, {moved} from p{n} p join a{n} a using (id) join b{n} b using (id))"


@query(f"""with {_RATES}, {_heun(0)}, {_heun(1)}, {_heun(2)}, e as (""" + " union all ".join(f"select {n} as n, id, x, y, z from p{n}" for n in range(4)) + f""")
  {_END.replace('select', 'select n as time_idx,', 1)} from e""")
def t6_several_steps_a_job(spark, sf_dir):
    """Three explicit trapezoids in one job, particles crossing tiles each at a step of its own; all their records."""
    seeds = positions(spark, sf_dir, 6.0).select("tracer_id", *((F.col(c) + 5.5).alias(c) for c in "xyz"), F.lit(0.0).alias("t0"))
    traj = advance.advance_snapshots(seeds, _turning(spark, sf_dir), _CUBE, [0.0, 0.5, 1.0, 1.5], 0, 3, scratch_path(spark, "together"), ["rho"], ["vx", "vy", "vz"], "expl_trap", size=4, together=3)
    return traj.select("tracer_id", "time_idx", *(rounded(c, 5).alias(c) for c in "xyz"), F.when(F.isnan("rho"), F.lit(-99.0)).otherwise(rounded("rho", 4)).alias("rho"))


@query(f"""with v as (select round(avg(l_quantity) / 20, 6) as u, round(avg(l_discount), 6) as v, round(avg(l_tax), 6) as w from lineitem), {_pos(1.0)},
  p as (select tracer_id, x * 0.2 - 0.6 as x, y * 0.2 as y, 1.2 + z * 0.2 as z from pos), n as (select unnest([0, 1, 2]) as n)
  select tracer_id, n as time_idx, round(x + n*u/2, 5) as x, round(y + n*v/2, 5) as y, round(z + n*w/2, 5) as z from p, v, n""")
def t6_steps_over_a_pole(spark, sf_dir):
    """Particles of an even flow that pass the axis of a spherical grid."""
    li = read(spark, sf_dir, "lineitem").agg(rounded(F.avg("l_quantity") / 20).alias("vx"), rounded(F.avg("l_discount")).alias("vy"), rounded(F.avg("l_tax")).alias("vz"))
    grid = Grid((tuple(0.3 * 1.2**n for n in range(16)), tuple((n + 0.5) * math.pi / 8 for n in range(8)), tuple(n * math.pi / 6 for n in range(12))), transform="log")
    cells = spark.range(3 * 16 * 8 * 12).select(F.floor(F.col("id") / 1536).cast("int"), F.floor(F.col("id") / 96).cast("int") % 16, F.floor(F.col("id") / 12).cast("int") % 8, (F.col("id") % 12).cast("int")).toDF("time_idx", "i", "j", "k").crossJoin(F.broadcast(li))
    seeds = positions(spark, sf_dir, 1.0).select("tracer_id", (F.col("x") * 0.2 - 0.6).alias("x"), (F.col("y") * 0.2).alias("y"), (F.col("z") * 0.2 + 1.2).alias("z"), F.lit(0.0).alias("t0"))
    traj = advance.advance_snapshots(seeds, cells, grid, [0.0, 0.5, 1.0], 0, 2, scratch_path(spark, "pole"), ["vx"], ["vx", "vy", "vz"], "expl_trap", size=8)
    return traj.select("tracer_id", "time_idx", *(rounded(c, 5).alias(c) for c in "xyz"))


def flagship(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """A disk wind followed by the implicit scheme from the embeddings' positions, and where its particles end."""
    return t2_implicit_trapezoid(spark, sf_dir)
