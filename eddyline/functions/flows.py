"""Analytic flows: a velocity and a density for any place and time, as Columns and as numpy twins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DiskWind:
    """A disk that expands homologously and rotates the slower the farther out."""

    r0: float = 0.75
    v0: float = 0.05
    omega0: float = 0.4
    q: float = 2.0

    @property
    def t0(self) -> float:
        return self.r0 / self.v0

    def velocity(self, x: Column, y: Column, z: Column, t: Column) -> tuple[Column, Column, Column]:
        r = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-12))
        spin = self.omega0 * F.pow(self.r0 / r, F.lit(self.q))
        grow = 1 / (t + self.t0)
        return x * grow - spin * y, y * grow + spin * x, z * grow

    def velocity_np(self, p: np.ndarray, t: float) -> np.ndarray:
        r = np.maximum(np.sqrt((p * p).sum(0)), 1e-12)
        spin, grow = self.omega0 * (self.r0 / r) ** self.q, 1 / (t + self.t0)
        return np.stack([p[0] * grow - spin * p[1], p[1] * grow + spin * p[0], p[2] * grow])

    def density(self, x: Column, y: Column, z: Column) -> Column:
        r = F.sqrt(x * x + y * y + z * z)
        return (1 + 0.5 * F.sin(2 * F.atan2(y, x) + 0.8)) * 4 / (1 + (r / self.r0) * (r / self.r0))

    def exact(self, p: np.ndarray, t: float) -> np.ndarray:
        """Where tracers that start at ``p`` at time 0 in the plane z = 0 are at ``t``."""
        r, a, s = np.hypot(p[0], p[1]), np.arctan2(p[1], p[0]), 1 + t / self.t0
        turned = np.log(s) if self.q == 1 else (1 - s ** (1 - self.q)) / (self.q - 1)
        a = a + self.omega0 * self.t0 * (self.r0 / r) ** self.q * turned
        return np.stack([r * s * np.cos(a), r * s * np.sin(a), p[2] * s])


@dataclass(frozen=True)
class BlastWave:
    """A shell that decelerates outwards from a centre, at rest beyond its front."""

    centre: tuple[float, float] = (0.5, 0.3)
    alpha: float = 0.8
    sigma: float = 0.06
    peak: float = 4.0
    width: float = 0.08
    ambient: float = 1.0
    inner: float = 0.05

    def velocity(self, x: Column, y: Column, z: Column, t: Column) -> tuple[Column, Column, Column]:
        dx, dy = x - self.centre[0], y - self.centre[1]
        xi = F.sqrt(dx * dx + dy * dy) / F.pow(1 + t, F.lit(self.alpha))
        front = 0.5 * (1 - F.tanh((xi - 1) / self.sigma))
        speed = self.alpha / (1 + t) * front
        return speed * dx, speed * dy, F.lit(0.0) * z

    def velocity_np(self, p: np.ndarray, t: float) -> np.ndarray:
        dx, dy = p[0] - self.centre[0], p[1] - self.centre[1]
        front = 0.5 * (1 - np.tanh((np.hypot(dx, dy) / (1 + t) ** self.alpha - 1) / self.sigma))
        speed = self.alpha / (1 + t) * front
        return np.stack([speed * dx, speed * dy, np.zeros_like(dx)])

    def density(self, x: Column, y: Column, z: Column, t: Column) -> Column:
        """A dense shell at the front, the medium beyond it and what it leaves behind, the first two uneven in angle."""
        dx, dy = x - self.centre[0], y - self.centre[1]
        xi = F.sqrt(dx * dx + dy * dy) / F.pow(1 + t, F.lit(self.alpha))
        front = 0.5 * (1 - F.tanh((xi - 1) / self.sigma))
        uneven, shell = 1 + 0.5 * F.sin(2 * F.atan2(dy, dx) + 0.8), (xi - 1) / self.width
        return uneven * (self.ambient * (1 - front) + self.peak * F.exp(-shell * shell)) + self.inner * front


@dataclass(frozen=True)
class Uniform:
    v: tuple[float, float, float] = (0.1, -0.2, 0.15)

    def velocity(self, x: Column, y: Column, z: Column, t: Column) -> tuple[Column, Column, Column]:
        return F.lit(self.v[0]), F.lit(self.v[1]), F.lit(self.v[2])

    def velocity_np(self, p: np.ndarray, t: float) -> np.ndarray:
        return np.repeat(np.array(self.v)[:, None], p.shape[1], 1)


@dataclass(frozen=True)
class Rotation:
    omega: float = 1.0

    def velocity(self, x: Column, y: Column, z: Column, t: Column) -> tuple[Column, Column, Column]:
        return -self.omega * y, self.omega * x, F.lit(0.0) * z

    def velocity_np(self, p: np.ndarray, t: float) -> np.ndarray:
        return np.stack([-self.omega * p[1], self.omega * p[0], np.zeros_like(p[0])])
