"""Sums over boxes of a sparse or crowded volume, without a pair of each box and each row in it.

A tree of cubes, sides 64, 16 and 4: each holds the sums of its rows, and one of side 4 also its rows, at most 64 as rows of
one voxel are added up first. A box takes the sum of a cube that it covers and goes on into the others, down to
the 64 voxels. So what a task holds for a cube doesn't grow with the rows in it, cubes without rows end the way, and the
work for a box grows with its surface.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .roi import AXES

SIDES = (64, 16, 4)
CELL = [f"c{a}" for a in AXES]
BOX = [f"{k}{a}" for k in "os" for a in AXES]


def _floor(value: Column, by: int) -> Column:
    """Division by a power of two, downwards for negative places too."""
    return F.shiftright(value.cast("long"), by.bit_length() - 1)


def sides_for(shape: Sequence[int]) -> tuple[int, ...]:
    """The sides of cubes that a box of this shape can cover, and the lowest."""
    return tuple(s for s in SIDES if s <= min(shape) or s == SIDES[-1])


def cube_tree(rows: DataFrame, values: Sequence[str], sides: Sequence[int] = SIDES) -> dict[int, DataFrame]:
    """{side: (cz, cy, cx, values)} of rows (z, y, x, values), ``sides`` falling; the lowest has ``at`` too, its voxels as structs. The lowest is written once, the others sum it up.

    Rows with a null place count for nothing, null values as 0.
    """
    lowest, own = sides[-1], [f"v_{v}" for v in values]
    at = rows.dropna(subset=list(AXES)).groupBy(*[F.col(a).cast("long").alias(a) for a in AXES]).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(n) for v, n in zip(values, own, strict=True)])
    cells = at.groupBy(*[_floor(F.col(a), lowest).alias(c) for a, c in zip(AXES, CELL, strict=True)])
    tree = {lowest: materialize(cells.agg(*[F.sum(n).alias(n) for n in own], F.collect_list(F.struct(*AXES, *own)).alias("at")), "cubes")}
    for below, side in zip(sides[:0:-1], sides[-2::-1], strict=True):
        tree[side] = tree[below].groupBy(*[_floor(F.col(c), side // below).alias(c) for c in CELL]).agg(*[F.sum(n).alias(n) for n in own])
    return tree


def box_sums(boxes: DataFrame, tree: dict[int, DataFrame], values: Sequence[str]) -> DataFrame:
    """``boxes`` (o*, s*, any others) with the sum of each of ``values`` over the rows of ``cube_tree`` inside, 0 for none.

    Equal boxes are asked for once. A box without volume has sums of 0.
    """
    own, sides = [f"v_{v}" for v in values], sorted(tree, reverse=True)
    front = boxes.select(*[F.col(c).cast("long").alias(c) for c in BOX]).distinct().filter(" AND ".join(f"s{a} > 0" for a in AXES))
    for a, c in zip(AXES, CELL, strict=True):
        front = front.withColumn(c, F.explode(F.sequence(_floor(F.col(f"o{a}"), sides[0]), _floor(F.col(f"o{a}") + F.col(f"s{a}") - 1, sides[0]))))
    found = None
    for side in sides:
        met = front.join(tree[side], CELL)
        covered = F.lit(True)
        for a, c in zip(AXES, CELL, strict=True):
            covered = covered & (F.col(c) * side >= F.col(f"o{a}")) & ((F.col(c) + 1) * side <= F.col(f"o{a}") + F.col(f"s{a}"))
        if side == sides[-1]:
            part = met.select(*BOX, *[F.when(covered, F.col(n)).otherwise(_of_rows(n)).alias(n) for n in own])
        else:
            part, below = met.filter(covered).select(*BOX, *own), sides[sides.index(side) + 1]
            front, times = met.filter(~covered).select(*BOX, *CELL), side // below
            for a, c in zip(AXES, CELL, strict=True):
                first = F.greatest(F.col(c) * times, _floor(F.col(f"o{a}"), below))
                last = F.least(F.col(c) * times + times - 1, _floor(F.col(f"o{a}") + F.col(f"s{a}") - 1, below))
                front = front.withColumn(c, F.explode(F.sequence(first, last)))
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy(*BOX).agg(*[F.sum(n).alias(n) for n in own]).withColumnsRenamed({c: f"__{c}" for c in BOX})
    same = F.lit(True)
    for c in BOX:
        same = same & (F.col(c) == F.col(f"__{c}"))
    out = boxes.join(sums, same, "left").withColumns({v: F.coalesce(F.col(n), F.lit(0)) for v, n in zip(values, own, strict=True)})
    return out.drop(*own, *[f"__{c}" for c in BOX])


def _inside(row: Column) -> Column:
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (row[a] >= F.col(f"o{a}")) & (row[a] < F.col(f"o{a}") + F.col(f"s{a}"))
    return inside


def _of_rows(name: str) -> Column:
    return F.aggregate(F.filter("at", _inside), F.col(name) * 0, lambda total, row: total + row[name])
