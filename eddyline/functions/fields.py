"""Named quantities of a history, as Columns: what reports plot or colour by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.geometry import radius


@dataclass(frozen=True)
class Units:
    """What a unit of the simulation is in kilometres, milliseconds, gigakelvins and grams a cubic centimetre."""

    length_km: float = 1.0
    time_ms: float = 1.0
    temperature_gk: float = 1.0
    density_cgs: float = 1.0


@dataclass(frozen=True)
class Quantity:
    label: str
    column: Callable[[Units], Column]
    log: bool = False


def _r() -> Column:
    return radius(F.col("x"), F.col("y"), F.col("z"))


#: Quantities by name; angles need ``geometry.spherical`` columns theta and phi.
QUANTITIES = {
    "r": Quantity("r (km)", lambda u: _r() * u.length_km),
    "theta": Quantity("theta (deg)", lambda u: F.col("theta")),
    "phi": Quantity("phi (deg)", lambda u: F.col("phi")),
    "rho_r3": Quantity("rho r^3", lambda u: F.col("rho") * _r() * _r() * _r(), True),
    "Ye": Quantity("Ye", lambda u: F.col("r_0")),
    "T": Quantity("T (GK)", lambda u: F.col("T") * u.temperature_gk),
    "rho": Quantity("rho (g/cm^3)", lambda u: F.col("rho") * u.density_cgs, True),
    "v": Quantity("|v| (c)", lambda u: radius(F.col("V_u_x"), F.col("V_u_y"), F.col("V_u_z"))),
    "u_t": Quantity("u_t", lambda u: F.col("u_t")),
}


def with_quantities(traj: DataFrame, names: list[str], units: Units = Units()) -> DataFrame:
    """``traj`` with the named quantities in columns q_<name>."""
    return traj.withColumns({f"q_{n}": QUANTITIES[n].column(units) for n in names})
