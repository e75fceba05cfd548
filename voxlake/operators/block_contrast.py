"""Adaptive equalisation over blocks: one pass over the chunks for histograms, one that maps them.

A chunk counts its grey values by tile (a row of ``nbins`` numbers for each tile it meets); a tile's counts are added up, filled, clipped and
turned into a look-up table of ``nbins`` numbers. Then tables are exchanged: every tile's goes to the chunks round
it, and a chunk with the tables of the tiles it needs blends them in numpy. What shuffles is histograms, look-up tables and, once, the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from . import blocks as B
from .histogram import GREY, bin_size, clip_counts
from .roi import Vec

TILES = ["tz", "ty", "tx"]
#: In signed blocks a voxel that isn't there; in blocks of floats that is NaN.
ABSENT = -1
_SLAB = 1 << 18
#: Tiles a side whose tables are made together.
_NEAR = 8


def grey_of(a: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Values lo..hi as 0..GREY - 1, rounded."""
    return np.rint((a.astype(np.float64) - lo) / max(hi - lo, 1e-300) * (GREY - 1)).astype(np.int64)


def absent(a: np.ndarray) -> np.ndarray | None:
    """Where there is no voxel; None if the type can't say so."""
    return np.isnan(a) if a.dtype.kind == "f" else a == ABSENT if a.dtype.kind == "i" else None


def _bins(a: np.ndarray, grey: tuple[float, float], nbins: int, gone: np.ndarray | None, there: int) -> np.ndarray:
    """Bins of a block, ``there`` where there is no voxel."""
    if gone is None:
        return grey_of(a, *grey) // bin_size(nbins)
    return np.where(gone, there, grey_of(np.where(gone, grey[0], a), *grey) // bin_size(nbins))


def _tiles_of(lo: int, size: int, kernel: int, length: int) -> dict[int, np.ndarray]:
    """For one axis: tile -> places in a chunk that begins at ``lo`` (from the box) that count in it, also those that mirror into the last one."""
    half = kernel // 2
    end = length + half - 1
    last = -(-(length + 2 * half) // kernel) * kernel - half - 1
    at = np.arange(size)
    p = at + lo
    inside = (p >= -half) & (p <= end)
    at, p = at[inside], p[inside]
    mirrored = (2 * end - p <= last) & (2 * end - p > end)
    at, p = np.concatenate([at, at[mirrored]]), np.concatenate([p, 2 * end - p[mirrored]])
    tile = (p + half) // kernel
    return {int(t): at[tile == t] for t in np.unique(tile)}


def _histograms(blocks: DataFrame, k: Vec, nbins: int, grey: tuple[float, float], box: tuple[Vec, Vec]) -> DataFrame:
    """(tile, counts) of every chunk and tile, and a row without tile: (sum, number) of the chunk's voxels in the box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a, lo = B.array_of(r), [o - b for o, b in zip((r.oz, r.oy, r.ox), box[0], strict=True)]
                gone = absent(a)
                inner = tuple(slice(max(0, -o), max(0, s - o)) for o, s in zip(lo, box[1], strict=True))
                own = a[inner] if gone is None else a[inner][~gone[inner]]
                if own.size:
                    rows.append((None, None, None, None, float(own.sum(dtype=np.float64)), own.size))
                bins = _bins(a, grey, nbins, gone, nbins)
                axes = [_tiles_of(o, s, n, m) for o, s, n, m in zip(lo, a.shape, k, box[1], strict=True)]
                for t in product(*axes):
                    part = bins[np.ix_(*[ax[i] for ax, i in zip(axes, t, strict=True)])]
                    rows.append((*t, np.bincount(part.ravel(), minlength=nbins + 1)[:nbins].astype("<i8").tobytes(), None, None))
            yield pd.DataFrame(rows, columns=[*TILES, "counts", "total", "n"])

    return blocks.select(B.COLUMNS).mapInPandas(run, "tz long, ty long, tx long, counts binary, total double, n long")


def tile_tables(histograms: DataFrame, k: Vec, clip: float, nbins: int, fill: int, box: tuple[Vec, Vec]) -> DataFrame:
    """(tile, table): the look-up table of every tile of the box, from its chunks' counts; what lacks to a full tile has bin ``fill``."""
    full = k[0] * k[1] * k[2]
    limit = max(1, int(clip * full)) if clip > 0 else full
    z, y, x = (-(-(s + 2 * (n // 2)) // n) for s, n in zip(box[1], k, strict=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf[TILES].to_numpy(np.int64)
        tiles, own = np.unique(place, axis=0, return_inverse=True)
        counts = np.zeros((len(tiles), nbins), np.int64)
        for k, c in zip(own.ravel().tolist(), pdf["counts"], strict=True):
            if c is not None:
                counts[k] += np.frombuffer(c, "<i8")
        counts[:, fill] += full - counts.sum(1)
        upto = np.cumsum([clip_counts(c, limit) if c.max() > limit else c for c in counts], 1)
        tables = np.minimum(np.floor(upto * ((GREY - 1) / full)), GREY - 1).astype("<i2")
        return pd.DataFrame([(*t, m.tobytes()) for t, m in zip(tiles.tolist(), tables, strict=True)], columns=[*TILES, "table"])

    spark = histograms.sparkSession
    grid = spark.range(z * y * x).select(F.expr(f"id DIV {y * x}").alias("tz"), F.expr(f"id DIV {x} % {y}").alias("ty"), F.expr(f"id % {x}").alias("tx"), F.lit(None).cast("binary").alias("counts"))
    rows = histograms.filter("tz IS NOT NULL").select(*TILES, "counts").unionByName(grid)
    near = [F.expr(f"{t} DIV {_NEAR}").alias(f"__{t}") for t in TILES]  # _NEAR ** 3 tiles at most, each met by a bounded number of chunks
    return rows.groupBy(*near).applyInPandas(run, "tz long, ty long, tx long, table binary")


def _needed(lo: int, size: int, kernel: int, top: int) -> tuple[int, int]:
    """First and last tile whose table the voxels lo .. lo + size - 1 blend, held inside 0..top."""
    odd = kernel % 2
    return min(max((lo - odd) // kernel, 0), top), min(max((lo + size - 1 - odd) // kernel + 1, 0), top)


def blend(bins: np.ndarray, lo: Vec, tables: np.ndarray, first: Vec, k: Vec, tops: Vec) -> np.ndarray:
    """Each voxel's bin by the tables (tz, ty, tx, bin; from tile ``first``) of the 8 tiles round it, weighted by i / kernel."""
    at, share = [], []
    for o, s, n, f, top in zip(lo, bins.shape, k, first, tops, strict=True):
        p = np.arange(s) + o - n % 2
        at.append([np.clip(p // n + up, 0, top) - f for up in (0, 1)])
        share.append([1 - p % n / n, p % n / n])
    out = np.zeros(bins.shape)
    deep = max(1, _SLAB // max(1, bins.shape[1] * bins.shape[2]))
    for z in range(0, bins.shape[0], deep):
        cut = slice(z, z + deep)
        for up in product((0, 1), repeat=3):
            iz, iy, ix = (at[axis][u] for axis, u in enumerate(up))
            wz, wy, wx = (share[axis][u] for axis, u in enumerate(up))
            weight = wz[cut, None, None] * wy[None, :, None] * wx[None, None, :]
            out[cut] += weight * tables[iz[cut, None, None], iy[None, :, None], ix[None, None, :], bins[cut]]
    return out


def clahe_blocks(
    blocks: DataFrame, box: tuple[Vec, Vec], chunk: Vec, kernel: int | Vec = 128, clip: float = 0.02, nbins: int = 256, grey: tuple[float, float] = (0, 255), fill: float | None = None,
    origin: Vec | None = None,
) -> DataFrame:
    """Contrast limited adaptive equalisation of ``box`` on one tile grid: blocks (int16) with values 0..255, ABSENT where there is no voxel.

    ``blocks`` are chunks counted from ``origin`` (the box's offset if not given); those up to half a kernel outside the box are looked at if they are there. Voxels
    that are absent (ABSENT or NaN, or the chunk isn't there) count as ``fill``, the mean of the box cut to an integer if not given.
    """
    k = (kernel,) * 3 if isinstance(kernel, int) else tuple(kernel)
    offset, shape = box
    origin = offset if origin is None else origin
    counted = materialize(_histograms(blocks, k, nbins, grey, box), "tile-histograms")
    if fill is None:
        total, n = counted.agg(F.sum("total"), F.sum("n")).first()
        fill = int(total / n) if n else 0
    tables = tile_tables(counted, k, clip, nbins, int(grey_of(np.array(float(fill)), *grey)) // bin_size(nbins), box)
    tops = [-(-(s + 2 * (n // 2)) // n) - 1 for s, n in zip(shape, k, strict=True)]

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tables that each chunk needs, by chunk number."""
        wanted: list[dict[int, list[int]]] = []
        for o, b, s, c, n, top in zip(offset, origin, shape, chunk, k, tops, strict=True):
            by_tile: dict[int, list[int]] = {}
            for i in range((o - b) // c, (o - b + s - 1) // c + 1):
                lo, hi = max(b + i * c - o, 0), min(b + (i + 1) * c - o, s)
                first, last = _needed(lo, hi - lo, n, top)
                for t in range(first, last + 1):
                    by_tile.setdefault(t, []).append(i)
            wanted.append(by_tile)
        for batch in batches:
            rows = [(*c, r.tz, r.ty, r.tx, r.table) for r in batch.itertuples() for c in product(*[w.get(t, ()) for w, t in zip(wanted, (r.tz, r.ty, r.tx), strict=True)])]
            yield pd.DataFrame(rows, columns=[*B.CHUNK, *TILES, "table"])

    sent = tables.mapInPandas(around, "cz long, cy long, cx long, tz long, ty long, tx long, table binary")
    near = sent.groupBy(*B.CHUNK).agg(F.collect_list(F.struct(*TILES, "table")).alias("tables"))  # a chunk's own and those round it

    def one(r) -> Iterator[tuple]:
        a = B.array_of(r)
        s = [max(b - o, 0) for o, b in zip((r.oz, r.oy, r.ox), offset, strict=True)]
        e = [min(b + n - o, m) for o, b, n, m in zip((r.oz, r.oy, r.ox), offset, shape, a.shape, strict=True)]
        if any(p >= q for p, q in zip(s, e, strict=True)):
            return
        a = a[tuple(slice(p, q) for p, q in zip(s, e, strict=True))]
        lo = [o + p - b for o, p, b in zip((r.oz, r.oy, r.ox), s, offset, strict=True)]
        spans = [_needed(p, n, m, top) for p, n, m, top in zip(lo, a.shape, k, tops, strict=True)]
        held = np.zeros([q - p + 1 for p, q in spans] + [nbins], np.int16)
        for t in r.tables:
            if all(p <= t[x] <= q for x, (p, q) in zip(TILES, spans, strict=True)):
                held[tuple(t[x] - p for x, (p, _) in zip(TILES, spans, strict=True))] = np.frombuffer(t["table"], "<i2")
        gone = absent(a)
        bins = _bins(a, grey, nbins, gone, 0)
        out = np.floor(np.floor(blend(bins, lo, held, [p for p, _ in spans], k, tops)) / (GREY - 1) * 255).astype(np.int16)
        if gone is not None:
            out[gone] = ABSENT
        yield B._row((r.cz, r.cy, r.cx), [o + p for o, p in zip((r.oz, r.oy, r.ox), s, strict=True)], out, "int16")

    return blocks.select(B.COLUMNS).join(near, B.CHUNK).mapInPandas(B.rows_of(one, B.COLUMNS), B.SCHEMA)
