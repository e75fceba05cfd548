"""Elastic deformation, rotation and section shifts of a whole volume in blocks, without seams.

Every output voxel takes its value from a place of the input that depends on its global position only: control points on
a global grid are moved by draws from their own place, sections by draws from their number, the rotation turns about the volume's centre. So
the result doesn't depend on the chunks. An output chunk's places span a box of the input; the chunks that
it meets send their part of it, so a task holds one output chunk and the box it looks at, however far things move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .roi import Vec, tile

#: Moves of control points are cut at so many standard deviations.
CUT = 3.0


def draws(seed: int, *keys: np.ndarray) -> np.ndarray:
    """``project.draw`` in numpy: numbers in [0, 1) from integers that aren't negative."""
    p, q = 1_000_003, 2_147_483_647
    h = np.int64(seed % p)
    for k in keys:
        h = (h * 48271 + (np.asarray(k, np.int64) % p) * 69621 + 12345) % q
    h = h % p
    square = h * h % p
    return ((square * square % p * h % p) * 48271 + 11) % p / p


@dataclass(frozen=True)
class Deformation:
    """How a volume is deformed: control points ``spacing`` voxels apart moved with ``sigma``, an angle about z, and sections that shift.

    With probability ``prob_shift`` a section and all that follow move by up to ``max_misalign`` voxels in y and x. The field is
    computed at every ``subsample``-th voxel and linear in between.
    """

    spacing: Vec = (32, 32, 32)
    sigma: Vec = (2.0, 2.0, 2.0)
    rotation: tuple[float, float] = (0.0, np.pi / 2)
    prob_shift: float = 0.0
    max_misalign: int = 0
    subsample: int = 4
    seed: int = 0

    def angle(self) -> float:
        return self.rotation[0] + (self.rotation[1] - self.rotation[0]) * float(draws(self.seed, np.int64(1)))

    def moves(self, knots: list[np.ndarray], axis: int) -> np.ndarray:
        """The moves along ``axis`` of the control points with these numbers."""
        if not self.sigma[axis]:
            return np.zeros([len(k) for k in knots])
        keys = [k.reshape([-1 if j == i else 1 for j in range(3)]) + 1000 for i, k in enumerate(knots)]
        u, v = (draws(self.seed + 10 + 2 * axis + half, *keys) for half in (0, 1))
        return self.sigma[axis] * np.clip(np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v), -CUT, CUT)

    def shifts(self, first: int, n: int) -> np.ndarray:
        """(n, 2): how far the sections 0 .. n - 1 of a volume whose first section is ``first`` have moved in y and x."""
        z = np.arange(n) + abs(first)
        move = draws(self.seed + 20, z) < self.prob_shift
        steps = [np.floor(draws(self.seed + 21 + k, z) * (2 * self.max_misalign + 1)).astype(np.int64) - self.max_misalign for k in (0, 1)]
        return np.cumsum(np.stack([np.where(move, s, 0) for s in steps], 1), 0)


def _between(values: np.ndarray, axis: int, at: np.ndarray) -> np.ndarray:
    """Linear interpolation along one axis at fractional places."""
    i = np.clip(np.floor(at).astype(int), 0, values.shape[axis] - 2) if values.shape[axis] > 1 else np.zeros(len(at), int)
    w = (at - i).reshape([-1 if k == axis else 1 for k in range(values.ndim)])
    return np.take(values, i, axis) * (1 - w) + np.take(values, np.minimum(i + 1, values.shape[axis] - 1), axis) * w


def source_places(how: Deformation, lo: Vec, size: Vec, box: tuple[Vec, Vec]) -> np.ndarray:
    """(3, z, y, x): where each voxel of a box at ``lo`` takes its value, in voxels of the volume."""
    step = how.subsample
    grid = [np.arange(o // step, -(-(o + s - 1) // step) + 1) * step for o, s in zip(lo, size, strict=True)]
    at = np.stack(np.meshgrid(*[g.astype(np.float64) for g in grid], indexing="ij"))
    angle = how.angle()
    centre = [o + (s - 1) / 2 for o, s in zip(*box, strict=True)]
    y, x = at[1] - centre[1], at[2] - centre[2]
    at[1], at[2] = centre[1] + y * np.cos(angle) - x * np.sin(angle), centre[2] + y * np.sin(angle) + x * np.cos(angle)
    knots = [np.arange(g[0] // k, g[-1] // k + 2) for g, k in zip(grid, how.spacing, strict=True)]
    for axis in range(3):
        moved = how.moves(knots, axis)
        for j, (g, k, n) in enumerate(zip(grid, how.spacing, knots, strict=True)):
            moved = _between(moved, j, g / k - n[0])
        at[axis] += moved
    for j, (o, s, g) in enumerate(zip(lo, size, grid, strict=True)):
        at = _between(at, j + 1, (np.arange(s) + o - g[0]) / step)
    if how.prob_shift:
        moved = how.shifts(box[0][0], box[1][0])[lo[0] - box[0][0] : lo[0] - box[0][0] + size[0]]
        at[1] += moved[:, 0, None, None]
        at[2] += moved[:, 1, None, None]
    top = [o + s - 1 for o, s in zip(*box, strict=True)]
    return np.stack([np.clip(a, o, t) for a, o, t in zip(at, box[0], top, strict=True)])


_ROUTE = "cz long, cy long, cx long, dz long, dy long, dx long, nz long, ny long, nx long, mz long, my long, mx long"


def deform_blocks(blocks: DataFrame, box: tuple[Vec, Vec], chunk: Vec, how: Deformation, order: int = 0) -> DataFrame:
    """The volume ``box`` deformed: blocks on the same chunks. ``order`` 0 takes the nearest voxel (labels), 1 interpolates (raw).

    Places outside the volume take the nearest border; an absent chunk is 0.
    """
    offset = box[0]

    def chunk_box(c: Vec) -> tuple[Vec, Vec]:
        return [o + k * i for o, k, i in zip(offset, chunk, c, strict=True)], [min(k, s - k * i) for s, k, i in zip(box[1], chunk, c, strict=True)]

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each output chunk the input chunks of the box it looks at: from chunk c to chunk d, box n of m voxels."""
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                places = source_places(how, *chunk_box((r.cz, r.cy, r.cx)), box)
                lo = np.floor(places.min((1, 2, 3))).astype(int)
                hi = np.minimum(np.ceil(places.max((1, 2, 3))).astype(int) + 1, [o + s for o, s in zip(*box, strict=True)])
                spans = [range((a - o) // k, (b - 1 - o) // k + 1) for a, b, o, k in zip(lo, hi, offset, chunk, strict=True)]
                rows += [(*c, r.cz, r.cy, r.cx, *lo, *(hi - lo)) for c in product(*spans)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _ROUTE.split(", ")])

    def send(r) -> Iterator[tuple]:
        a, own = B.array_of(r), (r.oz, r.oy, r.ox)
        need = (r.nz, r.ny, r.nx), (r.mz, r.my, r.mx)
        s = [max(n, o) for n, o in zip(need[0], own, strict=True)]
        e = [min(n + m, o + k) for n, m, o, k in zip(*need, own, a.shape, strict=True)]
        part = a[tuple(slice(p - o, max(p, q) - o) for p, q, o in zip(s, e, own, strict=True))]
        yield *B._row((r.dz, r.dy, r.dx), s, part, r.dtype), *need[0], *need[1]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        c = [int(pdf[k].iloc[0]) for k in B.CHUNK]
        lo, size = chunk_box(c)
        first, shape = ([int(pdf[k].iloc[0]) for k in names] for names in (("nz", "ny", "nx"), ("mz", "my", "mx")))
        kind = pdf["dtype"].iloc[0]
        a = np.zeros(shape, kind)
        for r in pdf.itertuples():
            a[tuple(slice(o - b, o - b + s) for o, b, s in zip((r.oz, r.oy, r.ox), first, (r.sz, r.sy, r.sx), strict=True))] = B.array_of(r)
        at = source_places(how, lo, size, box) - np.array(first).reshape(3, 1, 1, 1)
        return pd.DataFrame([B._row(c, lo, B.gather(a, at, order).astype(kind), kind)], columns=B.COLUMNS)

    wanted = tile(blocks.sparkSession, *box, chunk).select(*B.CHUNK).mapInPandas(routes, _ROUTE)
    sent = blocks.select(B.COLUMNS).join(wanted, B.CHUNK).mapInPandas(B.rows_of(send, [*B.COLUMNS, "nz", "ny", "nx", "mz", "my", "mx"]), f"{B.SCHEMA}, nz long, ny long, nx long, mz long, my long, mx long")
    return sent.groupBy(*B.CHUNK).applyInPandas(build, B.SCHEMA)
