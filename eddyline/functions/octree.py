"""Which block of a refined grid holds a point, in numpy, for tasks.

A root grid's cells are dealt to blocks of ``interior`` cells an axis; a block of level n covers 1 / 2^n of a root block an
axis. Blocks are known by level and place, so what a task holds grows with the number of blocks, not with
that of the finest level's slots. Blocks' nodes and values come as rows of BLOCK tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def faces(low: float, high: float, ratio: float, n: int) -> tuple[float, ...]:
    """The n + 1 faces of n cells, each ``ratio`` times as wide as the one before."""
    if np.isclose(ratio, 1.0):
        return tuple(np.linspace(low, high, n + 1))
    return tuple(low + (high - low) * (ratio ** np.arange(n + 1) - 1) / (ratio**n - 1))


@dataclass(frozen=True)
class Octree:
    """Faces of the root grid's cells, cells of a block, and (block_id, level, l1, l2, l3) of every block."""

    root: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]
    interior: tuple[int, int, int]
    blocks: tuple[tuple[int, int, int, int, int], ...]
    spherical: bool = True
    table: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        finest = self.finest
        for a in range(3):
            cells = len(self.root[a]) - 1
            if cells % self.interior[a] or self.interior[a] % (1 << finest):
                raise ValueError(f"axis {a + 1}: {cells} cells, blocks of {self.interior[a]} and {finest} levels don't fit")
        known = np.array(self.blocks, np.int64).reshape(-1, 5)
        volume = sum(8.0 ** -int(level) for level in known[:, 1])
        if volume != np.prod([(len(f) - 1) // n for f, n in zip(self.root, self.interior, strict=True)]):
            raise ValueError("blocks don't cover the root grid once")
        for level in np.unique(known[:, 1]):
            mine = known[known[:, 1] == level]
            code = self._code(mine[:, 2:].T, int(level))
            order = np.argsort(code)
            if len(np.unique(code)) < len(code):
                raise ValueError(f"two blocks of level {level} in one place")
            self.table[int(level)] = code[order], mine[order, 0]

    @property
    def finest(self) -> int:
        return max((b[1] for b in self.blocks), default=0)

    def _code(self, place: np.ndarray, level: int) -> np.ndarray:
        n = [((len(f) - 1) // m) << level for f, m in zip(self.root, self.interior, strict=True)]
        return (place[0] * n[1] + place[1]) * n[2] + place[2]

    def coordinates(self, p: np.ndarray) -> np.ndarray:
        """Grid coordinates (3, n) of Cartesian positions (3, n)."""
        if not self.spherical:
            return p
        r = np.sqrt((p * p).sum(0))
        return np.stack([r, np.arccos(np.clip(p[2] / np.where(r == 0, 1, r), -1, 1)), np.mod(np.arctan2(p[1], p[0]), 2 * np.pi)])

    def find(self, q: np.ndarray) -> np.ndarray:
        """The block of each point in grid coordinates (3, n), -1 outside: the one whose cells hold it, whatever its level."""
        out, inside, slots = np.full(q.shape[1], -1, np.int64), np.isfinite(q).all(0), []
        finest = self.finest
        for a in range(3):
            f = np.array(self.root[a])
            inside &= (q[a] >= f[0]) & (q[a] <= f[-1])
            cell = np.clip(np.searchsorted(f, np.where(inside, q[a], f[0]), "right") - 1, 0, len(f) - 2)
            slots.append((cell << finest) // self.interior[a])
        slots = np.stack(slots)
        for level, (codes, ids) in self.table.items():
            code = self._code(slots >> (finest - level), level)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            out = np.where(inside & (codes[at] == code), ids[at], out)
        return out
