"""Resampling, mirroring and padding of voxel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .project import draw
from .roi import AXES, Vec, crop, grow_to

KEY = list(AXES)


def _vec(f: int | Vec) -> Vec:
    return (f,) * 3 if isinstance(f, int) else f


def _cell(a: str, f: int, origin: int = 0) -> Column:
    return F.expr(f"CAST(floor(({a} - {origin}) / {f}) AS BIGINT)")


def downsample(df: DataFrame, factor: int | Vec, origin: Vec = (0, 0, 0), phase: Vec = (0, 0, 0)) -> DataFrame:
    """Every factor-th voxel from the origin; coordinates become cell numbers."""
    out = df
    for a, f, o, p in zip(AXES, _vec(factor), origin, phase, strict=True):
        out = out.filter(F.pmod(F.col(a) - o, F.lit(f)) == p)
    return out.withColumns({a: _cell(a, f, o) for a, f, o in zip(AXES, _vec(factor), origin, strict=True)})


def pyramid_level(df: DataFrame, factor: int | Vec, kind: str, value: str = "v", channels: Sequence[str] = ()) -> DataFrame:
    """``label``: the voxel at factor // 2 of each cell; ``mean``: the cell's sum over its full size, truncated."""
    f = _vec(factor)
    if kind == "label":
        return downsample(df, f, phase=tuple(k // 2 for k in f))
    cells = df.groupBy(*channels, *[_cell(a, k).alias(a) for a, k in zip(AXES, f, strict=True)])
    return cells.agg(F.floor(F.sum(value) / (f[0] * f[1] * f[2])).cast("long").alias(value))


def scale_pyramid(df: DataFrame, scales: Sequence[int | Vec], kind: str, value: str = "v") -> list[DataFrame]:
    """Successive levels, each made from the one before."""
    out = []
    for f in scales:
        df = pyramid_level(df, f, kind, value)
        out.append(df)
    return out


def downscale(df: DataFrame, factor: int | Vec, method: str, value: str = "v", interpolatable: bool = True) -> DataFrame:
    """``em_low_res``: slices in z and means in the plane; ``local_mean``: means in all axes; other arrays are sliced."""
    f = _vec(factor)
    if not interpolatable:
        return downsample(df, f)
    if method == "em_low_res":
        df, f = downsample(df, (f[0], 1, 1)), (1, f[1], f[2])
    return df.groupBy(*[_cell(a, k).alias(a) for a, k in zip(AXES, f, strict=True)]).agg((F.sum(value) / (f[0] * f[1] * f[2])).alias(value))


def import_gt(df: DataFrame, ny: int) -> DataFrame:
    """Every second voxel, y mirrored; ``ny`` is the length of y before."""
    return downsample(df, 2).withColumn("y", F.lit(-(-ny // 2) - 1) - F.col("y"))


def mirror_transpose(df: DataFrame, offset: Vec, shape: Vec, mirror: Sequence[bool], perm: Sequence[int]) -> DataFrame:
    """Mirror the marked axes in the box, then let axis k take what was axis perm[k], about the box's voxel-aligned centre."""
    at = [(2 * offset[k] + shape[k] - 1 - F.col(a) if mirror[k] else F.col(a)) for k, a in enumerate(AXES)]
    centre = [offset[k] + shape[k] // 2 for k in range(3)]
    return df.withColumns({a: at[perm[k]] - centre[perm[k]] + centre[k] for k, a in enumerate(AXES)})


def mirror_transpose_points(points: DataFrame, offset: Vec, shape: Vec, mirror: Sequence[bool], perm: Sequence[int]) -> DataFrame:
    """The same for points; those that leave the box are dropped."""
    return crop(mirror_transpose(points, offset, shape, mirror, perm), offset, shape)


def simple_augment(df: DataFrame, block: Sequence[str], side: int | Vec, seed: int, axes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Mirror bits and an order of the axes of equal length drawn for each block; z, y, x count from the block's corner and run below ``side``."""
    out, side = df, _vec(side)
    for k in axes:
        a = AXES[k]
        out = out.withColumn(a, F.when(draw(seed + k, *block) < 0.5, side[k] - 1 - F.col(a)).otherwise(F.col(a)))
    orders = [p for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) if all(side[p[k]] == side[k] and (k in axes or p[k] == k) for k in range(3))]
    pick = F.floor(draw(seed + 7, *block) * len(orders))
    new = {}
    for k, a in enumerate(AXES):
        v = F.col(AXES[orders[0][k]])
        for n, p in enumerate(orders[1:], 1):
            v = F.when(pick == n, F.col(AXES[p[k]])).otherwise(v)
        new[a] = v
    return out.withColumns(new)


def dense_box(df: DataFrame, offset: Vec, shape: Vec) -> DataFrame:
    """All positions of the box, made from ranges in the tasks."""
    g = df.sparkSession.range(offset[1], offset[1] + shape[1]).select(F.col("id").cast("long").alias("y"))
    g = g.withColumn("z", F.explode(F.sequence(F.lit(offset[0]).cast("long"), F.lit(offset[0] + shape[0] - 1).cast("long"))))
    g = g.withColumn("x", F.explode(F.sequence(F.lit(offset[2]).cast("long"), F.lit(offset[2] + shape[2] - 1).cast("long"))))
    return g.select(*KEY)


def empty_like(df: DataFrame, offset: Vec, shape: Vec, value: int = 0, out: str = "v") -> DataFrame:
    """A constant array of a box."""
    return dense_box(df, offset, shape).withColumn(out, F.lit(value))


def pad(df: DataFrame, offset: Vec, shape: Vec, values: dict[str, object]) -> DataFrame:
    """The box, with a constant for each array where ``df`` has no voxel."""
    out = dense_box(df, offset, shape).join(crop(df, offset, shape), KEY, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}).select(*KEY, *values)


def crop_pad(df: DataFrame, offset: Vec, shape: Vec, value: str = "v") -> DataFrame:
    """A box as a new array: zero outside the source, coordinates from 0 where the offset was negative."""
    out = pad(df.select(*KEY, value), offset, shape, {value: 0})
    return out.withColumns({a: F.col(a) - o for a, o in zip(AXES, offset, strict=True) if o < 0})


def pad_to(df: DataFrame, offset: Vec, shape: Vec, target: Vec, values: dict[str, object]) -> DataFrame:
    """Grow the array's box to at least ``target`` and pad it."""
    names = [f"{k}{a}" for k in "os" for a in AXES]
    box = df.sparkSession.createDataFrame([(*offset, *shape)], ", ".join(f"{n} long" for n in names))
    row = grow_to(box, target).select(names).first()
    return pad(df, row[:3], row[3:], values)


def pad_edge(df: DataFrame, offset: Vec, shape: Vec, before: Vec, after: Vec, value: str = "v") -> DataFrame:
    """Pad by repeating the border: every position looks up the nearest one inside."""
    wide = dense_box(df, [o - b for o, b in zip(offset, before, strict=True)], [s + b + e for s, b, e in zip(shape, before, after, strict=True)])
    near = {f"n{a}": F.least(F.greatest(F.col(a), F.lit(o)), F.lit(o + s - 1)) for a, o, s in zip(AXES, offset, shape, strict=True)}
    src = df.select(*[F.col(a).alias(f"n{a}") for a in AXES], value)
    return wide.withColumns(near).join(src, ["nz", "ny", "nx"], "left").select(*KEY, F.coalesce(F.col(value), F.lit(0)).alias(value))
