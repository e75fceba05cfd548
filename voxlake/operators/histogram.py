"""Histograms, adaptive equalisation and histogram matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import nearest_known, ordered_parts, running_sum
from .roi import AXES, Vec, extent

KEY = list(AXES)
GREY = 1 << 14
TILES = ["tz", "ty", "tx"]
CELLS = ["cz", "cy", "cx"]
#: Of the chunks that voxels are put into.
CHUNK = (32, 64, 64)


def to_14bit(v: Column, lo, hi) -> Column:
    """Grey values lo..hi to 0..16383, rounded."""
    lo, hi = (F.lit(float(k)) if not isinstance(k, Column) else k.cast("double") for k in (lo, hi))
    return F.rint((v.cast("double") - lo) / F.greatest(hi - lo, F.lit(1e-300)) * (GREY - 1)).cast("int")


def bin_size(nbins: int) -> int:
    return 1 + GREY // nbins


def value_range(df: DataFrame, value: str = "v") -> DataFrame:
    return df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _tile(a: str, k: int) -> Column:
    """Tiles are shifted by half a kernel: tile b covers [b k - k/2, (b + 1) k - k/2)."""
    return F.expr(f"CAST(floor(({a} + {k // 2}) / {k}) AS BIGINT)")


def tile_histogram(df: DataFrame, kernel: int | Vec, nbins: int = 256, value: str = "g") -> DataFrame:
    """(tz, ty, tx, bin, n) over 14-bit grey values; counts are summed in tasks first."""
    k = (kernel,) * 3 if isinstance(kernel, int) else kernel
    return df.groupBy(*[_tile(a, s).alias(t) for a, s, t in zip(AXES, k, TILES, strict=True)], F.expr(f"CAST({value} DIV {bin_size(nbins)} AS INT)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clip_counts(hist: np.ndarray, limit: int) -> np.ndarray:
    """Counts cut at ``limit``; what is cut off goes to bins with room: as much to each as all could take alike, the rest one by one in strides.

    ``hist`` is one histogram or has a row for each of several, which are gone through side by side."""
    many = np.atleast_2d(hist).astype(np.int64)
    bins = np.arange(many.shape[1])
    room = np.maximum(limit - many, 0)
    spare = np.maximum(many - limit, 0).sum(1)
    even = np.minimum(room, (spare // len(bins))[:, None])
    room, spare = room - even, spare - even.sum(1)
    first, at = 0, np.flatnonzero((spare > 0) & room.any(1))
    while len(at):
        rest = room[at]
        stride = np.maximum(1, (rest > 0).sum(1) // spare[at])
        spots = (rest > 0) & (bins >= first) & ((bins - first) % stride[:, None] == 0)
        room[at] = rest = rest - spots
        spare[at] -= spots.sum(1)
        at = at[(spare[at] > 0) & rest.any(1)]
        first = (first + 1) % len(bins)
    return (limit - room).reshape(np.shape(hist))


#: Tiles whose counts are clipped side by side.
AT_ONCE = 512


def clip_histogram(hist: DataFrame, limit: int, nbins: int = 256) -> DataFrame:
    """Each tile's counts clipped; all bins come back, also empty ones. A tile is one row with a list of at most ``nbins`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                found = part.column("found")
                own = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
                bins, n = (c.to_numpy(zero_copy_only=False) for c in found.flatten().flatten())
                counts = np.zeros((part.num_rows, nbins), np.int64)
                counts[own, bins] = n
                out = clip_counts(counts, limit) if limit else counts
                tile = [pa.array(np.repeat(part.column(t).to_numpy(), nbins)) for t in TILES]
                yield pa.RecordBatch.from_arrays([*tile, pa.array(np.tile(np.arange(nbins, dtype=np.int32), part.num_rows)), pa.array(out.ravel())], [*TILES, "bin", "n"])

    tiles = hist.groupBy(*TILES).agg(F.collect_list(F.struct("bin", "n")).alias("found"))
    return tiles.mapInArrow(run, "tz long, ty long, tx long, bin int, n long")


def map_histogram(hist: DataFrame, n_pixels: int, top: int = GREY - 1) -> DataFrame:
    """(tile, bin, m): the bin's cumulated count scaled to 0..top and truncated."""
    upto = Window.partitionBy(*TILES).orderBy("bin")
    return hist.select(*TILES, "bin", F.least(F.floor(F.sum("n").over(upto) * (top / n_pixels)), F.lit(top)).cast("int").alias("m"))


def apply_mapping(df: DataFrame, maps: DataFrame, kernel: int | Vec, nbins: int = 256, value: str = "g") -> DataFrame:
    """(z, y, x, v): mappings of the 8 surrounding tiles blended by weights i / k. A tile or bin without a mapping counts as 0.

    The mappings of the tiles round a cell of ``kernel`` voxels are gathered in one row, 8 arrays of ``nbins`` numbers,
    and each voxel meets the row of its cell: one join, in which a cell brings at most ``kernel`` voxels.
    """
    k = (kernel,) * 3 if isinstance(kernel, int) else kernel
    filled = "flatten(transform(set, (e, i) -> concat(array_repeat(0, e.bin - if(i = 0, -1, set[i - 1].bin) - 1), array(e.m))))"
    tiles = maps.groupBy(*TILES).agg(F.sort_array(F.collect_list(F.struct("bin", "m"))).alias("set")).select(*TILES, F.expr(filled).alias("map"))
    steps = [((c >> 2) & 1, (c >> 1) & 1, c & 1) for c in range(8)]
    around = F.array(*[F.struct(F.lit(c).alias("corner"), *[(F.col(t) - up).alias(n) for t, up, n in zip(TILES, step, CELLS, strict=True)]) for c, step in enumerate(steps)])
    cells = tiles.select("map", F.inline(around)).groupBy(*CELLS).agg(*[F.first(F.when(F.col("corner") == c, F.col("map")), True).alias(f"m{c}") for c in range(8)])
    odd = [s % 2 for s in k]  # the grid of an odd kernel's cells starts one voxel later
    own = {n: F.floor((F.col(a) - o) / s).cast("long") for n, a, s, o in zip(CELLS, AXES, k, odd, strict=True)}
    rows = df.withColumns({"bin": F.expr(f"CAST({value} DIV {bin_size(nbins)} AS INT)"), **own}).join(cells, CELLS, "left")
    blend = F.lit(0.0)
    for c, step in enumerate(steps):
        weight = F.lit(1.0)
        for a, s, o, up in zip(AXES, k, odd, step, strict=True):
            r = F.pmod(F.col(a) - o, F.lit(s)) / s
            weight = weight * (r if up else 1 - r)
        blend = blend + weight * F.coalesce(F.get(f"m{c}", F.col("bin")), F.lit(0))
    return rows.select(*KEY, blend.alias("v"))


def clahe(
    df: DataFrame, kernel: int | Vec = 128, clip: float = 0.02, nbins: int = 256, value: str = "v", grey: tuple[float, float] = (0, 255), box: tuple[Vec, Vec] | None = None
) -> DataFrame:
    """Contrast limited adaptive equalisation of ``box`` (that of all voxels if not given) on one tile grid: (z, y, x, v) with v in 0..255.

    ``grey`` is the range of the values' type, not of those found. Voxels up to half a kernel outside the box are looked
    at if they are there; what is absent counts as the box's mean, cut to an integer. So a box that is smaller than the
    volume by half a kernel a side needs none. An empty table gives no row. The work is done on chunks (``block_contrast``).
    """
    k = (kernel,) * 3 if isinstance(kernel, int) else tuple(kernel)
    if box is None:
        if df.isEmpty():
            return df.select(*KEY, F.lit(0).alias("v"))
        box = extent(df)
    offset, shape = box
    from . import block_contrast
    from . import blocks as B

    half = [n // 2 for n in k]
    region = tuple(o - n for o, n in zip(box[0], half, strict=True)), tuple(s + 2 * n for s, n in zip(box[1], half, strict=True))
    blocks = B.voxels_to_blocks(df, *region, CHUNK, "float64", float("nan"), value)
    out = block_contrast.clahe_blocks(blocks, box, CHUNK, k, clip, nbins, grey, origin=region[0])
    return B.blocks_to_voxels(out, "int", skip=block_contrast.ABSENT)


def match_histograms(src: DataFrame, tmpl: DataFrame, value: str = "v", mask: str = "mask") -> DataFrame:
    """Values of ``src`` mapped so that the masked distribution becomes that of the masked ``tmpl``; all voxels are replaced.

    Both sides shrink to one row a value, of whichever type. Running counts and the brackets between the template's values are formed
    in ranges of values or quantiles, with one row carried from range to range, so floats with as many values as voxels work as they are.
    A value of ``src`` that occurs outside the mask only is an error; null stays null. Without masked voxels in ``tmpl`` everything maps to null.
    """

    def cdf(df: DataFrame, name: str) -> DataFrame:
        counts = df.filter((F.col(mask) != 0) & F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("val")).agg(F.count(F.lit(1)).alias("n"))
        parts = ordered_parts(counts, [F.col("val")], name)
        total = parts.agg(F.sum("n")).first()[0] or 1
        return running_sum(parts, "n", "upto").select("val", (F.col("upto") / F.lit(total)).alias("q"))

    none = F.lit(None).cast("struct<v:double,q:double>")
    a, b = cdf(src, "source-cdf"), cdf(tmpl, "template-cdf")
    both = a.select("q", F.col("val").alias("sv"), none.alias("t"), F.lit(1).alias("k")).unionByName(
        b.select("q", F.lit(None).cast("double").alias("sv"), F.struct(F.col("val").alias("v"), "q").alias("t"), F.lit(0).alias("k"))
    )
    near = nearest_known(ordered_parts(both, [F.col("q"), F.col("k")], "brackets"), F.col("t"), "lo", "hi").filter("sv IS NOT NULL")
    v0, q0, v1, q1 = (F.col(c) for c in ("lo.v", "lo.q", "hi.v", "hi.q"))
    mid = v0 + (v1 - v0) * (F.col("q") - q0) / (q1 - q0)
    mapped = F.when(v0.isNull(), v1).when(v1.isNull() | (q1 == q0), v0).otherwise(mid)
    lut = near.select("sv", mapped.alias("mapped"))
    out = src.join(lut, F.col(value).cast("double") == F.col("sv"), "left")
    missing = F.raise_error(F.concat(F.lit("value outside the mask only: "), F.col(value).cast("string"))).cast("double")
    return out.withColumn("mapped", F.when(F.col("sv").isNull() & F.col(value).isNotNull(), missing).otherwise(F.col("mapped"))).drop("sv")
