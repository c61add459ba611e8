"""What a requested field is made of: raw names, and the two heavy species that may count as one.

Specifications are resolved on the driver, as there are a handful of keys, into plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.functions.geometry import mean_energy, moment_density, moment_energy, summed_flux

#: Our keys and the names that snapshot files on a spherical grid use for them.
GRID_NAMES = {
    "rho": "dens", "T": "temperature", "r_0": "s_00", "u_t": "u_t", "V_u_x": "win_Vx", "V_u_y": "win_Vy", "V_u_z": "win_Vz",
    "F_nue": "|F|:0", "F_anue": "|F|:1", "F_nux": "|F|:2", "F_anux": "|F|:3", "eps_nue": "e:0", "eps_anue": "e:1", "eps_nux": "e:2", "eps_anux": "e:3",
}
#: The same for files of mesh blocks.
BLOCK_NAMES = {"rho": "rho", "press": "press", "r_0": "rYE", "s": "rENT", "T": "Temperature", "u_t": "u_t", "h": "h"}
HEAVY = ("sum", "drop", "separate")


@dataclass(frozen=True)
class KeySpec:
    key: str
    kind: str  # direct, sum or weighted_mean
    raw: tuple[str, ...]

    def column(self) -> Column:
        c = [F.col(f"`{r}`") for r in self.raw]
        if self.kind == "sum":
            return summed_flux(*c).alias(self.key)
        if self.kind == "weighted_mean":
            return mean_energy(c[0], c[1], c[2], c[3]).alias(self.key)
        return c[0].alias(self.key)


def key_specs(keys: list[str], names: dict[str, str] = GRID_NAMES, heavy: str = "sum") -> list[KeySpec]:
    """How to make each of ``keys`` that there is; names that aren't listed are raw ones. The two heavy species
    are one by ``sum`` (fluxes added, energies weighted by flux, nothing under the second's name), none by
    ``drop`` and themselves by ``separate``."""
    if heavy not in HEAVY:
        raise ValueError(f"heavy species: one of {', '.join(HEAVY)}")
    raw = lambda key: names.get(key, key)
    flux, energy = ("F_nux", "F_anux"), ("eps_nux", "eps_anux")
    out = []
    for key in keys:
        if heavy == "separate" or key not in flux + energy:
            out.append(KeySpec(key, "direct", (raw(key),)))
        elif heavy == "sum" and key == flux[0]:
            out.append(KeySpec(key, "sum", tuple(map(raw, flux))))
        elif heavy == "sum" and key == energy[0]:
            out.append(KeySpec(key, "weighted_mean", tuple(raw(k) for pair in zip(flux, energy, strict=True) for k in pair)))
    return out


def missing(specs: list[KeySpec], have: Column) -> Column:
    """Which raw names a file that has ``have`` (an array) lacks: all parts of a combined key are required."""
    want = sorted({r for s in specs for r in s.raw})
    return F.array_except(F.array(*map(F.lit, want)), have)


def renamed(df: DataFrame, names: dict[str, str] = GRID_NAMES) -> DataFrame:
    """Raw columns under our keys; others keep their names."""
    return df.withColumnsRenamed({raw: key for key, raw in names.items() if raw in df.columns})


@dataclass(frozen=True)
class Preset:
    """What a kind of snapshot file is read with unless told otherwise."""

    names: dict[str, str]
    pattern: str
    transform: str | None
    method: str
    keys: tuple[str, ...]


_NEUTRINOS = tuple(f"{q}_{s}" for q in ("F", "eps") for s in ("nue", "anue", "nux"))
_COMMON = ("V_u_x", "V_u_y", "V_u_z", "rho", "T", "r_0", "u_t")
#: Kinds of snapshot files: spherical grids in VTK files, surfaces and refined blocks in HDF5 files.
PRESETS = {
    "grid": Preset(GRID_NAMES, ".vtk", "log", "pchip", _COMMON + _NEUTRINOS),
    "surface": Preset({}, ".hdf5", "log", "pchip", _COMMON + ("hu_t",) + _NEUTRINOS),
    "blocks": Preset(BLOCK_NAMES, ".athdf", None, "blocks", _COMMON + ("press", "h")),
}


def reduced_moments(df: DataFrame) -> DataFrame:
    """Neutrino number fluxes and mean energies in place of the moments they come from, which go, as do the momenta. A
    table that lacks one of the moments or the metric stays as it is, whole."""
    species = {"00": "nue", "01": "anue", "02": "nux"}
    needed = [*(f"{m}_{n}" for m in ("J", "n") for n in species), "sc_sqrt_det_g"]
    if not set(needed) <= set(df.columns):
        return df
    new = {f"F_{s}": moment_density(F.col(f"n_{n}"), F.col("sc_sqrt_det_g")) for n, s in species.items()}
    new |= {f"eps_{s}": moment_energy(F.col(f"J_{n}"), F.col(f"n_{n}")) for n, s in species.items()}
    return df.withColumns(new).drop(*needed, *(f"st_H_u_{c}_{n}" for c in "txyz" for n in species), "s")


def relaid(raw: DataFrame) -> DataFrame:
    """FIELD(time, i, j, k, key, value) of surfaces that are stored radius by radius: ``raw`` (time, radius_key, name, j, k,
    value) has a row a point; radii are numbered by their keys as numbers, of dotted names the last part counts, and
    coordinates among the fields are left out."""
    radii = raw.select("time", "radius_key").distinct().withColumn("i", F.dense_rank().over(Window.partitionBy("time").orderBy(F.col("radius_key").cast("long"))) - 1)
    key = F.element_at(F.split("name", r"\."), -1)
    kept = raw.where(~F.col("name").isin("r", "th", "ph", "time"))
    return kept.join(radii, ["time", "radius_key"]).select("time", F.col("i").cast("int"), F.col("j").cast("int"), F.col("k").cast("int"), key.alias("key"), F.col("value").cast("double"))
