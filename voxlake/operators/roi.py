"""Regions of interest: boxes of voxels, as plain arguments or as columns oz, oy, ox, sz, sy, sx of a table.

A voxel table has integer columns z, y, x and a value column per array; an absent row is background.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Vec = Sequence[int]


def _div(a: Column, b) -> Column:
    """Floor division that stays integer."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def to_nm(boxes: DataFrame, voxel_size: Vec) -> DataFrame:
    """Offsets and shapes in voxels to nanometres, as columns <name>_nm."""
    return boxes.withColumns({f"{k}{a}_nm": F.col(f"{k}{a}") * s for k in "os" for a, s in zip(AXES, voxel_size, strict=True)})


def to_vox(boxes: DataFrame, voxel_size: Vec) -> DataFrame:
    """Columns <name>_nm back to voxels, truncated toward zero."""
    return boxes.withColumns({f"{k}{a}": (F.col(f"{k}{a}_nm") / s).cast("long") for k in "os" for a, s in zip(AXES, voxel_size, strict=True)})


def crop(df: DataFrame, offset: Vec, shape: Vec) -> DataFrame:
    """Voxels in the half-open box; plain comparisons, so that they reach the scan."""
    cond = F.lit(True)
    for a, o, s in zip(AXES, offset, shape, strict=True):
        cond = cond & (F.col(a) >= o) & (F.col(a) < o + s)
    return df.filter(cond)


def extent(df: DataFrame) -> tuple[Vec, Vec]:
    """(offset, shape) of the smallest box that holds all voxels; ValueError if there are none."""
    row = df.agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    if row[0] is None:
        raise ValueError("no voxels")
    return tuple(row[0::2]), tuple(hi - lo + 1 for lo, hi in zip(row[0::2], row[1::2], strict=True))


def with_context(boxes: DataFrame, context: Vec, available: tuple[Vec, Vec]) -> DataFrame:
    """Boxes grown by ``context`` voxels a side, cut to what the array covers."""
    out = boxes
    for k, a in enumerate(AXES):
        lo = F.greatest(F.col(f"o{a}") - context[k], F.lit(available[0][k]))
        hi = F.least(F.col(f"o{a}") + F.col(f"s{a}") + context[k], F.lit(available[0][k] + available[1][k]))
        out = out.withColumns({f"o{a}": lo, f"s{a}": hi - lo})
    return out


def grow_to(boxes: DataFrame, target: Vec) -> DataFrame:
    """Boxes smaller than ``target`` grow to it: half of the difference, rounded down, before and the rest after."""
    out = boxes
    for a, t in zip(AXES, target, strict=True):
        lack = F.greatest(F.lit(t) - F.col(f"s{a}"), F.lit(0))
        out = out.withColumns({f"o{a}": F.col(f"o{a}") - _div(lack, 2), f"s{a}": F.col(f"s{a}") + lack})
    return out


def contains(boxes: DataFrame, inner: tuple[Vec, Vec], out: str = "contains") -> DataFrame:
    """Whether each box contains the box ``inner``."""
    cond = F.lit(True)
    for k, a in enumerate(AXES):
        cond = cond & (F.col(f"o{a}") <= inner[0][k]) & (F.col(f"o{a}") + F.col(f"s{a}") >= inner[0][k] + inner[1][k])
    return boxes.withColumn(out, cond)


def assert_contains(boxes: DataFrame, inner: tuple[Vec, Vec]) -> None:
    """ValueError if a box of this small table does not contain ``inner``."""
    bad = contains(boxes, inner).filter("NOT contains").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]} does not contain {inner}")


def shrink(boxes: DataFrame, pad: int | Vec) -> DataFrame:
    """Boxes without ``pad`` voxels at each side."""
    pad = (pad,) * 3 if isinstance(pad, int) else pad
    return boxes.withColumns({f"o{a}": F.col(f"o{a}") + p for a, p in zip(AXES, pad, strict=True)}).withColumns(
        {f"s{a}": F.col(f"s{a}") - 2 * p for a, p in zip(AXES, pad, strict=True)}
    )


def snap(boxes: DataFrame, grid: Vec, mode: str) -> DataFrame:
    """Boxes moved to a grid, outward (``grow``) or inward (``shrink``)."""
    out = boxes
    for a, g in zip(AXES, grid, strict=True):
        lo, hi = F.col(f"o{a}"), F.col(f"o{a}") + F.col(f"s{a}")
        lo = _div(lo, g) * g if mode == "grow" else _div(lo + g - 1, g) * g
        hi = _div(hi + g - 1, g) * g if mode == "grow" else _div(hi, g) * g
        out = out.withColumns({f"o{a}": lo, f"s{a}": F.greatest(hi - lo, F.lit(0))})
    return out


def validate(datasets: DataFrame) -> DataFrame:
    """One row: whether all voxel sizes are equal and the class ids run from 1 without a gap. Columns voxel_size, class_id."""
    return datasets.agg(
        (F.countDistinct("voxel_size") <= 1).alias("one_voxel_size"),
        ((F.min("class_id") == 1) & (F.max("class_id") == F.countDistinct("class_id"))).alias("classes_contiguous"),
    )


def tile(spark: SparkSession, offset: Vec, shape: Vec, block: Vec, context: Vec = (0, 0, 0)) -> DataFrame:
    """Write boxes that cover the region, the last of an axis smaller, each with its read box (r columns) grown by ``context``."""
    nz, ny, nx = (-(-s // b) for s, b in zip(shape, block, strict=True))
    number = {"cz": f"id DIV {ny * nx}", "cy": f"id DIV {nx} % {ny}", "cx": f"id % {nx}"}
    df = spark.range(nz * ny * nx).select(*[F.expr(e).alias(c) for c, e in number.items()])
    for k, a in enumerate(AXES):
        o, s, b = offset[k], shape[k], block[k]
        df = df.withColumn(f"o{a}", o + F.col(f"c{a}") * b).withColumn(f"s{a}", F.least(F.lit(b), F.lit(o + s) - F.col(f"o{a}")))
        df = df.withColumns({f"ro{a}": F.col(f"o{a}") - context[k], f"rs{a}": F.col(f"s{a}") + 2 * context[k]})
    return df


def tile_boxes(boxes: DataFrame, block: Vec) -> DataFrame:
    """``tile`` for a table of boxes: each box's write boxes as columns bz, by_, bx (offsets) and tz, ty, tx (shapes)."""
    out = boxes
    for a, b in zip(AXES, block, strict=True):
        n = _div(F.col(f"s{a}") + b - 1, b)
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        out = out.withColumn(f"b{a}", F.col(f"o{a}") + F.col(f"b{a}") * b)
        out = out.withColumn(f"t{a}", F.least(F.lit(b), F.col(f"o{a}") + F.col(f"s{a}") - F.col(f"b{a}")))
    return out


CUBE = 4


def boxes_to_mask(grid: DataFrame, boxes: DataFrame, value: int = 255) -> DataFrame:
    """mask = ``value`` inside any box, else 0, for each voxel of ``grid``.

    A box gives each cube of 4 x 4 x 4 voxels it meets a number with a bit for each voxel; the bits of a cube's boxes are put together
    before they shuffle, and a voxel looks its bit up. However many boxes lie on one place, a cube has one row. Boxes without volume count for nothing.
    """
    spots = boxes.filter(" AND ".join(f"s{a} > 0" for a in AXES)).select(*[f"o{a}" for a in AXES], *[f"s{a}" for a in AXES])
    for a in AXES:
        spots = spots.withColumn(f"c{a}", F.explode(F.sequence(_div(F.col(f"o{a}"), CUBE), _div(F.col(f"o{a}") + F.col(f"s{a}") - 1, CUBE))))
    met = {a: [(F.col(f"c{a}") * CUBE + k >= F.col(f"o{a}")) & (F.col(f"c{a}") * CUBE + k < F.col(f"o{a}") + F.col(f"s{a}")) for k in range(CUBE)] for a in AXES}
    chosen = lambda a, step: sum(F.when(c, F.lit(1 << (k * step))).otherwise(0) for k, c in enumerate(met[a]))
    spots = spots.withColumn("__plane", (chosen("x", 1) * chosen("y", CUBE)).cast("long"))
    bits = F.lit(0).cast("long")
    for k, c in enumerate(met["z"]):
        bits = bits.bitwiseOR(F.when(c, F.shiftleft("__plane", k * CUBE * CUBE)).otherwise(F.lit(0).cast("long")))
    cell = [f"c{a}" for a in AXES]
    cubes = spots.select(*cell, bits.alias("__b")).groupBy(*cell).agg(F.bit_or("__b").alias("__b"))
    rows = grid.select(*AXES, *[_div(F.col(a), CUBE).alias(f"c{a}") for a in AXES]).join(cubes, cell, "left")
    z, y, x = (F.col(a) - F.col(f"c{a}") * CUBE for a in AXES)
    inside = F.coalesce(F.bit_get("__b", ((z * CUBE + y) * CUBE + x).cast("int")), F.lit(0))
    return rows.select(*AXES, (inside * value).cast("int").alias("mask"))


def import_offsets(spec: DataFrame, raw_y: int, resolution: Vec, shift: int | Column = 0) -> DataFrame:
    """Source offsets (x, y, z order, ix, iy, iz with dims dx, dy, dz) as z, y, x in nanometres: a quarter of the offset, y mirrored."""
    quarter = {a: (F.col(f"i{a}") * 0.25).cast("long") for a in AXES}
    y = F.lit(raw_y) - quarter["y"] - (F.col("dy") * 0.5).cast("long") - shift
    return spec.withColumns({"oz_nm": quarter["z"] * resolution[0], "oy_nm": y * resolution[1], "ox_nm": quarter["x"] * resolution[2]})


def block_position(blocks: DataFrame) -> DataFrame:
    """Offset and shape of each block as one struct."""
    return blocks.withColumn("position", F.struct(*[F.col(f"{k}{a}") for k in "os" for a in AXES]))
