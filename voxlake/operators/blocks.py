"""Block form: one row per chunk with little-endian C-order bytes, and the exchange of halos between chunks.

A block table has cz, cy, cx (chunk number), oz, oy, ox, sz, sy, sx (box in voxels), dtype and data.
Kernels are numpy functions that run in ``mapInPandas`` / ``applyInPandas`` tasks, one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .roi import AXES, Vec

CHUNK = ["cz", "cy", "cx"]
BOX = ["oz", "oy", "ox", "sz", "sy", "sx"]
COLUMNS = [*CHUNK, *BOX, "dtype", "data"]
SCHEMA = "cz long, cy long, cx long, oz long, oy long, ox long, sz long, sy long, sx long, dtype string, data binary"


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, np.dtype(row.dtype).newbyteorder("<")).reshape(row.sz, row.sy, row.sx)


def bytes_of(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes()


def _row(chunk, offset, a: np.ndarray, dtype: str) -> tuple:
    return (*map(int, chunk), *map(int, offset), *a.shape, dtype, bytes_of(a))


#: Bytes after which rows that a task makes are given on.
FRAME = 4 << 20


def rows_of(make: Callable[..., Iterable[tuple]], columns: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` from one that makes rows of a row. They are given on in frames of about FRAME bytes: Spark hands a
    task up to 64 MB of blocks at once, and what is made of them may be many times as much."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.itertuples():
                for made in make(row):
                    rows.append(made)
                    size += sum(len(v) for v in made if isinstance(v, bytes))
                    if size >= FRAME:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def blocks_to_voxels(blocks: DataFrame, kind: str = "double", skip: float | None = None, also: str | None = None) -> DataFrame:
    """(z, y, x, v); voxels equal to ``skip`` are left out. ``also`` is the name and type of a column that is carried on."""
    more = also.split()[:1] if also else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a = array_of(row)
                at = np.argwhere(np.ones(a.shape, bool) if skip is None else a != skip)
                yield pd.DataFrame({"z": at[:, 0] + row.oz, "y": at[:, 1] + row.oy, "x": at[:, 2] + row.ox, "v": a[tuple(at.T)], **{m: getattr(row, m) for m in more}})

    return blocks.select(*COLUMNS, *more).mapInPandas(run, f"z long, y long, x long, v {kind}" + (f", {also}" if also else ""))


def voxels_to_blocks(df: DataFrame, offset: Vec, shape: Vec, chunk: Vec, dtype: str, fill: float = 0, value: str = "v") -> DataFrame:
    """Blocks of the box that hold a voxel; edge blocks are smaller. A group is one chunk, so its size is bounded by the chunk."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        c = [int(pdf[k].iloc[0]) for k in CHUNK]
        lo = [o + k * s for o, k, s in zip(offset, c, chunk, strict=True)]
        size = [min(s, o + n - b) for s, o, n, b in zip(chunk, offset, shape, lo, strict=True)]
        a = np.full(size, fill, dtype)
        a[tuple(pdf[k].to_numpy() - b for k, b in zip(AXES, lo, strict=True))] = pdf[value].to_numpy()
        return pd.DataFrame([_row(c, lo, a, dtype)], columns=COLUMNS)

    inside = df.select(*AXES, value)
    for a, o, s in zip(AXES, offset, shape, strict=True):
        inside = inside.filter((F.col(a) >= o) & (F.col(a) < o + s))
    number = {k: F.expr(f"CAST(floor(({a} - {o}) / {c}) AS BIGINT)") for k, a, o, c in zip(CHUNK, AXES, offset, chunk, strict=True)}
    return inside.withColumns(number).groupBy(*CHUNK).applyInPandas(build, SCHEMA)


def map_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], dtype: str | None = None) -> DataFrame:
    """A function of each block alone, of the same shape."""

    def one(row) -> Iterator[tuple]:
        a = kernel(array_of(row))
        kind = dtype or row.dtype
        yield _row((row.cz, row.cy, row.cx), (row.oz, row.oy, row.ox), a.astype(kind), kind)

    return blocks.select(COLUMNS).mapInPandas(rows_of(one, COLUMNS), SCHEMA)


def with_halo(
    blocks: DataFrame, context: Vec, kernel: Callable[[np.ndarray], np.ndarray], box: tuple[Vec, Vec], chunk: Vec, fill: float | str = 0, dtype: str | None = None
) -> DataFrame:
    """``kernel`` of each block grown by ``context`` voxels a side; it returns the inner part.

    Each block sends only the slabs that its neighbours lack, so one shuffle moves the blocks once
    and the rims between them. Outside ``box`` the array is ``fill``, the block's own ``mean``
    (truncated) or its ``edge``. Context may exceed a chunk.
    """
    offset, shape = box

    def slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a, lo, size = array_of(row), (row.oz, row.oy, row.ox), (row.sz, row.sy, row.sx)
                spans = []
                for k in range(3):
                    first = (lo[k] - context[k] - offset[k]) // chunk[k]
                    last = (lo[k] + size[k] - 1 + context[k] - offset[k]) // chunk[k]
                    top = -(-shape[k] // chunk[k]) - 1
                    spans.append(range(max(0, first), min(top, last) + 1))
                out = []
                for c in product(*spans):
                    b = [offset[k] + c[k] * chunk[k] for k in range(3)]
                    e = [min(b[k] + chunk[k], offset[k] + shape[k]) for k in range(3)]
                    s = [max(lo[k], b[k] - context[k]) for k in range(3)]
                    t = [min(lo[k] + size[k], e[k] + context[k]) for k in range(3)]
                    if all(x < y for x, y in zip(s, t, strict=True)):
                        part = a[tuple(slice(s[k] - lo[k], t[k] - lo[k]) for k in range(3))]
                        out.append(_row(c, s, part, row.dtype))
                yield pd.DataFrame(out, columns=COLUMNS)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        c = [int(pdf[k].iloc[0]) for k in CHUNK]
        lo = [offset[k] + c[k] * chunk[k] for k in range(3)]
        size = [min(chunk[k], offset[k] + shape[k] - lo[k]) for k in range(3)]
        kind = pdf["dtype"].iloc[0]
        a = np.zeros([size[k] + 2 * context[k] for k in range(3)], kind)
        known = np.zeros(a.shape, bool)
        for row in pdf.itertuples():
            at = tuple(slice(o - b + n, o - b + n + s) for o, b, n, s in zip((row.oz, row.oy, row.ox), lo, context, (row.sz, row.sy, row.sx), strict=True))
            a[at], known[at] = array_of(row), True
        inner = tuple(slice(n, n + s) for n, s in zip(context, size, strict=True))
        if fill == "edge":
            clamp = [np.clip(np.arange(lo[k] - context[k], lo[k] + size[k] + context[k]), offset[k], offset[k] + shape[k] - 1) - lo[k] + context[k] for k in range(3)]
            a = a[np.ix_(*clamp)]
        else:
            a[~known] = int(a[inner].mean()) if fill == "mean" else fill
        out = kernel(a)
        return pd.DataFrame([_row(c, lo, out.astype(dtype or out.dtype), dtype or str(out.dtype))], columns=COLUMNS)

    return blocks.select(COLUMNS).mapInPandas(slabs, SCHEMA).groupBy(*CHUNK).applyInPandas(assemble, SCHEMA)


def shifted(a: np.ndarray, context: Vec, offset: Vec) -> np.ndarray:
    """The inner part of a block with context, moved by ``offset``."""
    return a[tuple(slice(n + d, a.shape[k] - n + d) for k, (n, d) in enumerate(zip(context, offset, strict=True)))]


def dilate_kernel(ball: list[tuple[int, int, int]], context: Vec) -> Callable[[np.ndarray], np.ndarray]:
    return lambda a: np.logical_or.reduce([shifted(a != 0, context, o) for o in ball]).astype(np.uint8)


def boundary_kernel(ball: list[tuple[int, int, int]], context: Vec) -> Callable[[np.ndarray], np.ndarray]:
    """What a dilation adds."""
    wide = dilate_kernel(ball, context)
    return lambda a: (wide(a).astype(bool) & (shifted(a, context, (0, 0, 0)) == 0)).astype(np.uint8)


def erode_kernel(ball: list[tuple[int, int, int]], context: Vec) -> Callable[[np.ndarray], np.ndarray]:
    return lambda a: np.logical_and.reduce([shifted(a != 0, context, o) for o in ball]).astype(np.uint8)


def instances_kernel(ball: list[tuple[int, int, int]], context: Vec) -> Callable[[np.ndarray], np.ndarray]:
    """Each id dilated on its own; where they overlap the largest stays. Ids are positive, background is 0."""
    return lambda a: np.maximum.reduce([shifted(a, context, o) for o in ball])


#: In blocks that a kernel of opening or closing gets, what lies outside the box; ``fill`` of ``with_halo``.
OUTSIDE = -1


def _swept(a: np.ndarray, ball: list[tuple[int, int, int]], radius: int, grow: bool, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(foreground, outside) after one dilation, or an erosion to which outside is foreground; both lose ``radius`` voxels a side."""
    n = (radius,) * 3
    parts = [shifted(a if grow else a | outside, n, o) for o in ball]
    outside = shifted(outside, n, (0, 0, 0))
    return (np.logical_or if grow else np.logical_and).reduce(parts) & ~outside, outside


def sweep_kernel(steps: list[tuple[str, int]]) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """(context, kernel) of openings and closings by round balls, one after another with one halo. Blocks are signed, outside is OUTSIDE."""
    from .neighbourhood import round_ball

    passes = [(radius, grow) for kind, radius in steps for grow in ((False, True) if kind == "open" else (True, False))]

    def run(a: np.ndarray) -> np.ndarray:
        outside = a == OUTSIDE
        fg = a > 0
        for radius, grow in passes:
            fg, outside = _swept(fg, round_ball(radius), radius, grow, outside)
        return fg.astype(np.uint8)

    return sum(r for r, _ in passes), run


def metric_mask_kernel(outwards: int, inwards: int, on: int = 255) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """(context, kernel) of the exclusion mask: the larger radius serves both steps with one halo."""
    from .neighbourhood import cross_ball

    n = max(outwards, inwards)
    wide, narrow = dilate_kernel(cross_ball(outwards), (n,) * 3), erode_kernel(cross_ball(inwards), (n,) * 3)
    return n, lambda a: np.where(wide(a).astype(bool) & ~narrow(a).astype(bool), 0, on).astype(np.uint8)


def convolve_kernel(weights: dict[tuple[int, int, int], float], bias: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda a: (sum(w * shifted(a.astype(np.float64), (1, 1, 1), o) for o, w in weights.items()) + bias).astype(np.float64)


def elastic_augment(blocks: DataFrame, spacing: int, sigma: float, rotation: tuple[float, float], seed: int, order: int = 0) -> DataFrame:
    """Elastic deformation and rotation about z of each block on its own, drawn from (seed, block).

    ``order`` 0 takes the nearest voxel (labels), 1 interpolates (raw). Positions outside take the nearest border.
    """

    def one(row) -> Iterator[tuple]:
        a = array_of(row)
        at = displaced(a.shape, spacing, sigma, rotation, np.random.default_rng([seed, row.cz & 0xFFFFFFFF, row.cy & 0xFFFFFFFF, row.cx & 0xFFFFFFFF]))
        yield _row((row.cz, row.cy, row.cx), (row.oz, row.oy, row.ox), gather(a, at, order).astype(row.dtype), row.dtype)

    return blocks.select(COLUMNS).mapInPandas(rows_of(one, COLUMNS), SCHEMA)


def displaced(shape: tuple[int, ...], spacing: int, sigma: float, rotation: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """Source positions (3, z, y, x): control points moved by normal draws, linear in between, turned about the centre of (y, x)."""
    at = np.stack(np.meshgrid(*[np.arange(n, dtype=np.float64) for n in shape], indexing="ij"))
    knots = [max(2, -(-n // spacing) + 1) for n in shape]
    moves = rng.normal(0, sigma, (3, *knots)) if sigma else np.zeros((3, *knots))
    for axis, n in enumerate(shape):
        pos = np.minimum(np.arange(n) / spacing, moves.shape[axis + 1] - 1)
        i = np.minimum(pos.astype(int), moves.shape[axis + 1] - 2)
        w = (pos - i).reshape([-1 if k == axis + 1 else 1 for k in range(4)])
        moves = np.take(moves, i, axis + 1) * (1 - w) + np.take(moves, i + 1, axis + 1) * w
    angle = rng.uniform(*rotation)
    cy, cx = (shape[1] - 1) / 2, (shape[2] - 1) / 2
    y, x = at[1] - cy, at[2] - cx
    at[1], at[2] = cy + y * np.cos(angle) - x * np.sin(angle), cx + y * np.sin(angle) + x * np.cos(angle)
    return at + moves


def gather(a: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    top = np.array(a.shape).reshape(3, 1, 1, 1) - 1
    at = np.clip(at, 0, top)
    if order == 0:
        return a[tuple(np.rint(at).astype(int))]
    lo = np.floor(at).astype(int)
    hi, w = np.minimum(lo + 1, top), at - lo
    out = np.zeros(at.shape[1:])
    for corner in product((0, 1), repeat=3):
        spot = tuple(hi[k] if c else lo[k] for k, c in enumerate(corner))
        out += a[spot] * np.prod([w[k] if c else 1 - w[k] for k, c in enumerate(corner)], axis=0)
    return out if a.dtype.kind == "f" else np.rint(out)
