"""Morphology, stencils and components of sparse voxel tables (z, y, x[, value]).

An operator of radius r joins nothing: voxels are dealt to tasks by tiles, every foreground voxel sends itself to its
neighbours by a literal array of offsets, and one aggregate with partial sums collects them. Openings and closings send words
instead, the bits of 64 voxels along x. Chained operators on dense volumes belong to the block form (``blocks``).
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from .components import components
from .roi import AXES, Vec, extent

KEY = list(AXES)
WORD = ["z", "y", "w"]
TILE = (32, 32, 32)


def cross_ball(n: int) -> list[tuple[int, int, int]]:
    """Offsets that n steps of the 6-neighbour cross reach."""
    r = range(-n, n + 1)
    return [(z, y, x) for z in r for y in r for x in r if abs(z) + abs(y) + abs(x) <= n]


def round_ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]


def _offsets(ball: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES, strict=True)]) for o in ball])


def by_tile(df: DataFrame, axes: list[str] = KEY) -> DataFrame:
    """The voxels dealt to tasks by tiles of TILE, so that what neighbours send to one position is summed in a task before it shuffles."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.expr(f"CAST(floor({a} / {s}) AS BIGINT)") for a, s in zip(axes, TILE, strict=True)])


def spread(df: DataFrame, ball: list[tuple[int, int, int]], box: tuple[Vec, Vec] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each voxel once for each offset, at the shifted position, inside ``box`` if given. A row makes as many rows as the ball has offsets."""
    out = by_tile(df.select(*KEY, *keep)).select(*KEY, *keep, F.inline(_offsets(ball))).select(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY], *keep)
    if box is not None:
        from .roi import crop

        out = crop(out, *box)
    return out


def dilate(df: DataFrame, n: int, box: tuple[Vec, Vec] | None = None) -> DataFrame:
    """Foreground after n steps of the cross."""
    return spread(df, cross_ball(n), box).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).select(*KEY)


def erode(df: DataFrame, n: int) -> DataFrame:
    """Voxels all of whose ball is foreground; outside the volume is background."""
    return _full(df, cross_ball(n))


def _full(df: DataFrame, ball: list[tuple[int, int, int]]) -> DataFrame:
    return spread(df, ball).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(ball)).select(*KEY)


def dilate_ball(df: DataFrame, radius: int = 3, box: tuple[Vec, Vec] | None = None) -> DataFrame:
    return spread(df, round_ball(radius), box).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).select(*KEY)


def boundary(df: DataFrame, radius: int = 4, box: tuple[Vec, Vec] | None = None) -> DataFrame:
    """The ball-dilated foreground without the foreground itself."""
    return dilate_ball(df, radius, box).join(df.select(*KEY), KEY, "left_anti")


def metric_mask(grid: DataFrame, foreground: DataFrame, outwards: int, inwards: int, on: int = 255) -> DataFrame:
    """mask = 0 where dilate(outwards) AND NOT erode(inwards), else ``on``; context is the larger of the two.

    Every foreground voxel is sent once to the larger of the two balls, counted apart where it is inside either.
    """
    ball = sorted({*cross_ball(outwards), *cross_ball(inwards)})
    wide, narrow = set(cross_ball(outwards)), set(cross_ball(inwards))
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES, strict=True)], F.lit(int(o in wide)).alias("w"), F.lit(int(o in narrow)).alias("n")) for o in ball])
    sent = by_tile(foreground.select(*KEY)).select(*KEY, F.inline(steps)).select(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY], "w", "n")
    band = sent.groupBy(*KEY).agg(F.sum("w").alias("w"), F.sum("n").alias("n")).filter((F.col("w") > 0) & (F.col("n") < len(narrow)))
    band = band.select(*KEY, F.lit(1).alias("__b"))
    return grid.join(band, KEY, "left").select(*KEY, F.when(F.col("__b") == 1, 0).otherwise(on).alias("mask"))


def dilate_instances(df: DataFrame, n: int, box: tuple[Vec, Vec] | None = None, col: str = "id") -> DataFrame:
    """Each id dilated on its own; where they overlap the largest id stays."""
    return spread(df.filter(F.col(col) != 0), cross_ball(n), box, (col,)).groupBy(*KEY).agg(F.max(col).alias(col))


def open_ball(df: DataFrame, radius: int, box: tuple[Vec, Vec]) -> DataFrame:
    """Erosion by the ball, where outside the box counts as foreground, then dilation."""
    return _swept(df, radius, box, (False, True))


def close_ball(df: DataFrame, radius: int, box: tuple[Vec, Vec]) -> DataFrame:
    """Dilation by the ball, then erosion where outside the box counts as foreground."""
    return _swept(df, radius, box, (True, False))


def _swept(df: DataFrame, radius: int, box: tuple[Vec, Vec], passes: tuple[bool, ...]) -> DataFrame:
    """Dilations (True) and erosions of the voxels, on words (z, y, w, bits): bit i of word w is the voxel 64 w + i after the box's first x."""
    first = box[0][2]
    place = F.col("x").cast("long") - first
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = df.groupBy("z", "y", F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    for grow in passes:
        words = _sweep_words(words, radius, box, grow)
    voxels = words.select(*WORD, "bits", F.explode(F.array(*map(F.lit, range(64)))).alias("i")).filter(F.getbit("bits", F.col("i")) == 1)
    kind = df.select(F.col("x") + F.lit(0)).dtypes[0][1]
    return voxels.select("z", "y", (F.col("w") * 64 + F.col("i") + first).cast(kind).alias("x"))


def _along_x(bits: Column, by: int, reach: int) -> list[Column]:
    """What a word's bits, moved by up to ``by`` voxels either way, set in the words from ``reach`` before it to ``reach`` after it."""
    parts: list[list[Column]] = [[] for _ in range(2 * reach + 2)]
    for d in range(-by, by + 1):
        on, left = divmod(d, 64)
        parts[reach + on].append(F.shiftleft(bits, left))
        if left:
            parts[reach + on + 1].append(F.shiftrightunsigned(bits, 64 - left))
    return [reduce(Column.bitwiseOR, p, F.lit(0).cast("long")) for p in parts[:-1]]


def _sweep_words(words: DataFrame, radius: int, box: tuple[Vec, Vec], grow: bool) -> DataFrame:
    """Words after a dilation by the ball, or an erosion to which outside the box is foreground; what lies in the box.

    A word widened along x goes to the rows of the ball round it. An erosion is a dilation of the background, which absent words are all of:
    those beside a word are added, and a word to which not all rows have sent is background.
    """
    (oz, oy, _), (sz, sy, sx) = box
    inside = F.col("z").between(oz, oz + sz - 1) & F.col("y").between(oy, oy + sy - 1) & F.col("w").between(0, (sx - 1) // 64)
    in_box = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - F.least(F.lit(64), sx - F.col("w") * 64)).cast("int"))
    reach = -(-radius // 64)
    sides = range(-reach, reach + 1)
    if not grow:
        beside = F.array(*[F.struct(F.lit(d).alias("dw"), F.when(F.lit(d == 0), F.col("bits")).otherwise(0).alias("b")) for d in sides])
        words = words.select(*WORD, F.inline(beside)).select("z", "y", (F.col("w") + F.col("dw")).alias("w"), "b").filter(inside)
        words = words.groupBy(*WORD).agg(F.bit_or("b").alias("b")).select(*WORD, F.bitwise_not("b").bitwiseAND(in_box).alias("bits"))
    across = {dz: isqrt(radius * radius - dz * dz) for dz in range(-radius, radius + 1)}
    rows = [(dz, dy, isqrt(radius * radius - dz * dz - dy * dy)) for dz, m in across.items() for dy in range(-m, m + 1)]
    wide = [c.alias(f"b{by}_{k}") for by in range(radius + 1) for k, c in enumerate(_along_x(F.col("bits"), by, reach))]
    sends = [(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(d).alias("dw"), F.col(f"b{by}_{k}").alias("b")) for dz, dy, by in rows for k, d in enumerate(sides)]
    sent = by_tile(words, WORD).select(*WORD, *wide).select(*WORD, F.inline(F.array(*[F.struct(*s) for s in sends]))).filter("b != 0 OR dw = 0")
    sent = sent.select(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in WORD], "b", (F.col("dw") == 0).cast("long").alias("row")).filter(inside)
    got = sent.groupBy(*WORD).agg(F.bit_or("b").alias("b"), F.sum("row").alias("rows"))
    bits = F.col("b")
    if not grow:
        need = F.lit(0)
        for dz, m in across.items():
            seen = F.least(F.lit(m), F.col("y") - oy) + F.least(F.lit(m), oy + sy - 1 - F.col("y")) + 1
            need = need + F.when(F.col("z").between(oz - dz, oz + sz - 1 - dz), seen).otherwise(0)
        got, bits = got.filter(F.col("rows") == need), F.bitwise_not("b")
    return got.select(*WORD, bits.bitwiseAND(in_box).alias("bits")).filter("bits != 0")


def _number(at: np.ndarray, box: tuple[Vec, Vec]) -> np.ndarray:
    """One number for each voxel of the box, in order of z, y, x."""
    z, y, x = (at - np.array(box[0], np.int64)).T
    return (z * box[1][1] + y) * box[1][2] + x


def _label_tile(pdf: pd.DataFrame, box: tuple[Vec, Vec]) -> pd.DataFrame:
    """The smallest voxel number that each voxel of a tile reaches inside the tile."""
    at = pdf[KEY].sort_values(KEY).to_numpy()
    lo = at.min(0)
    index = np.full(at.max(0) - lo + 1, -1)
    index[tuple((at - lo).T)] = np.arange(len(at))
    label = np.arange(len(at))
    for axis in range(3):
        a = np.take(index, range(index.shape[axis] - 1), axis).ravel()
        b = np.take(index, range(1, index.shape[axis]), axis).ravel()
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    return pd.DataFrame({"z": at[:, 0], "y": at[:, 1], "x": at[:, 2], "root": _number(at[label], box)})


def label_components(df: DataFrame, block: Vec | None = None) -> DataFrame:
    """(z, y, x, component) of the 6-connected foreground; the component is its smallest voxel number,
    counted in the box that holds all of ``df``; ValueError if that box has more than 2**63 voxels.

    Voxels are labelled inside tiles first, one numpy task a tile; then only voxels on the tiles' faces
    meet, and components of the tiles' labels are joined. With ``block`` each block stays by itself.
    """
    tile = block or TILE
    number = [F.expr(f"CAST(floor({a} / {s}) AS BIGINT)").alias(f"t{a}") for a, s in zip(AXES, tile, strict=True)]
    rows = materialize(df.select(*[F.col(a).cast("long").alias(a) for a in KEY], *number).distinct(), "voxels")
    box = extent(rows) if not rows.isEmpty() else ((0, 0, 0), (1, 1, 1))
    if box[1][0] * box[1][1] * box[1][2] > 1 << 63:
        raise ValueError(f"voxels of a box of {box[1]} can't be numbered in 63 bits")
    tiles = rows.groupBy("tz", "ty", "tx").applyInPandas(lambda pdf: _label_tile(pdf, box), "z long, y long, x long, root long")
    local = materialize(tiles, "tiles")
    discard(rows)
    if block is not None:
        return local.withColumnRenamed("root", "component")
    faces = None
    for a, s in zip(AXES, tile, strict=True):
        last = local.filter(F.pmod(F.col(a), F.lit(s)) == s - 1).withColumn(a, F.col(a) + 1).withColumnRenamed("root", "u")
        first = local.filter(F.pmod(F.col(a), F.lit(s)) == 0).withColumnRenamed("root", "v")
        met = last.join(first, KEY).select("u", "v")
        faces = met if faces is None else faces.unionByName(met)
    joined = components(faces)
    tops = joined.select(F.col("u").alias("root"), F.col("v").alias("top"))
    out = materialize(local.join(tops, "root", "left").select(*KEY, F.coalesce("top", "root").alias("component")), "components")
    discard(local, joined)
    return out


def remove_small(df: DataFrame, min_size: int, block: Vec | None = None) -> DataFrame:
    """Foreground without components of fewer than ``min_size`` voxels."""
    labelled = label_components(df, block)
    large = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    out = materialize(labelled.join(large.select("component"), "component", "left_semi").select(*KEY), "large")
    discard(labelled)
    return out


def fill_small(grid: DataFrame, df: DataFrame, min_size: int, block: Vec | None = None) -> DataFrame:
    """Foreground with background components of fewer than ``min_size`` voxels filled."""
    holes = grid.select(*KEY).join(df.select(*KEY), KEY, "left_anti")
    return grid.select(*KEY).join(remove_small(holes, min_size, block), KEY, "left_anti")


def foreground_mask(
    raw: DataFrame, box: tuple[Vec, Vec], lo: int = 2, hi: int = 180, opening: int = 3, closing: int = 2, min_size: int = 100_000,
    block: Vec | None = None,
) -> DataFrame:
    """mask = 255 for the foreground: lo < v < hi, opened, closed, small holes filled, then small objects removed.

    In that order: an object counts with its holes filled. ``raw`` is written first: it is read four times, and Spark then knows its size, while
    it takes a grid made by explode for as small as what it was made of, and would send it whole to every executor for a join."""
    raw = materialize(raw, "raw")
    fg = raw.filter((F.col("v") > lo) & (F.col("v") < hi)).select(*KEY)
    swept = materialize(close_ball(open_ball(fg, opening, box), closing, box), "mask")
    filled = materialize(fill_small(raw, swept, min_size, block), "mask")
    fg = remove_small(filled, min_size, block).withColumn("__f", F.lit(1))
    discard(swept, filled)
    return raw.join(fg, KEY, "left").select(*KEY, F.when(F.col("__f") == 1, 255).otherwise(0).alias("mask"))


def foreground_mask_blocks(
    raw: DataFrame, box: tuple[Vec, Vec], chunk: Vec, lo: int = 2, hi: int = 180, opening: int = 3, closing: int = 2, min_size: int = 100_000, across: bool = True,
) -> DataFrame:
    """``foreground_mask`` of blocks (signed, all chunks of the box), as blocks (uint8, 0 and 255): opening and closing in numpy with one halo,
    components by ``block_components``. Without ``across`` holes and objects are judged chunk by chunk."""
    from . import blocks as B
    from .block_components import remove_small_blocks

    context, kernel = B.sweep_kernel([("open", opening), ("close", closing)])

    def run(a: np.ndarray) -> np.ndarray:
        return kernel(np.where(a == B.OUTSIDE, B.OUTSIDE, (a > lo) & (a < hi)).astype(np.int8))

    swept = B.with_halo(raw, (context,) * 3, run, box, chunk, B.OUTSIDE, "uint8")
    filled = remove_small_blocks(swept, min_size, box, chunk, across, holes=True)
    large = remove_small_blocks(filled, min_size, box, chunk, across)
    discard(filled)
    return B.map_blocks(large, lambda a: a * np.uint8(255), "uint8")


def convolve(df: DataFrame, weights: list[dict[tuple[int, int, int], float]], bias: list[float], value: str = "v") -> DataFrame:
    """(z, y, x, c, v): a cross-correlation for each output channel, zero outside. ``weights[c]`` maps offsets to numbers.

    Every voxel adds weight * value to the positions that look at it; all channels travel in one row.
    """
    taps = sorted({o for w in weights for o in w})
    table = F.array(
        *[F.struct(*[F.lit(-d).alias(f"d{a}") for d, a in zip(o, AXES, strict=True)], *[F.lit(float(w.get(o, 0.0))).alias(f"w{c}") for c, w in enumerate(weights)]) for o in taps]
    )
    sent = by_tile(df.select(*KEY, value)).select(*KEY, value, F.inline(table))
    sums = sent.groupBy(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY]).agg(*[F.sum(F.col(value) * F.col(f"w{c}")).alias(f"s{c}") for c in range(len(weights))])
    rows = df.select(*KEY).join(sums, KEY, "left")
    out = F.array(*[F.struct(F.lit(c).alias("c"), (F.coalesce(F.col(f"s{c}"), F.lit(0.0)) + b).alias("v")) for c, b in enumerate(bias)])
    return rows.select(*KEY, F.inline(out))
