"""Sampling of training blocks with draws that depend on (seed, number) only, so a retry draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import with_rank
from .box_sums import box_sums, cube_tree, sides_for
from .project import draw, draw_below
from .roi import AXES, Vec

KEY = list(AXES)


def sample_datasets(datasets: DataFrame, n: int, seed: int) -> DataFrame:
    """(i, dataset) of ``n`` draws with chance in proportion to the datasets' voxels (dataset, voxels).

    The few datasets become one array of cumulated shares, in which every draw looks itself up.
    """
    upto = Window.orderBy("dataset")
    shares = datasets.select("dataset", (F.sum("voxels").over(upto) / F.sum("voxels").over(Window.partitionBy())).alias("upto"))
    table = shares.agg(F.sort_array(F.collect_list(F.struct("upto", "dataset"))).alias("__t"), F.lit(1).alias("__one"))
    draws = datasets.sparkSession.range(n).select(F.col("id").alias("i"), draw(seed, "id").alias("__u"), F.lit(1).alias("__one"))
    hit = F.element_at(F.filter("__t", lambda s: s["upto"] > F.col("__u")), 1)["dataset"]
    return draws.join(F.broadcast(table), "__one").select("i", hit.alias("dataset"))


def possible_shifts(arrays: DataFrame, request: DataFrame, grid: Vec, bounded: bool = False) -> DataFrame:
    """lo_<axis>, hi_<axis> of the shifts that keep every array's request inside what it provides.

    ``arrays`` (array, o*, s*) and ``request`` (array, o*, s*) are small; shifts are snapped inward to ``grid``.
    Ends are exclusive; ``bounded`` gives inclusive ends and lets arrays smaller than the request pass by their offset alone.
    """
    r = request.select("array", *[F.col(f"{k}{a}").alias(f"r{k}{a}") for k in "os" for a in AXES])
    rows, aggs = arrays.join(r, "array"), []
    for a, g in zip(AXES, grid, strict=True):
        lo = F.col(f"o{a}") - F.col(f"ro{a}")
        hi = F.col(f"o{a}") + F.col(f"s{a}") - F.col(f"ro{a}") - F.col(f"rs{a}")
        if bounded:
            lo, hi = F.least(lo, hi), F.greatest(lo, hi)
        low, high = F.max(lo), F.min(hi)
        aggs += [(F.ceil(low / g) * g).alias(f"lo_{a}"), (F.floor(high / g) * g + (0 if bounded else 1)).alias(f"hi_{a}")]
    return rows.agg(*aggs)


def random_locations(shifts: DataFrame, n: int, grid: Vec, seed: int) -> DataFrame:
    """(i, z, y, x): ``n`` even draws on the grid for the one row of ``possible_shifts`` (exclusive ends)."""
    draws = shifts.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1).alias("__one"))
    rows = draws.join(F.broadcast(shifts.withColumn("__one", F.lit(1))), "__one")  # one row
    at = {}
    for k, (a, g) in enumerate(zip(AXES, grid, strict=True)):
        span = F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / g)
        at[a] = (F.col(f"lo_{a}") + draw_below(span, seed + k, "i") * g).cast("long")
    return rows.withColumns(at).select("i", *KEY)


def integral(df: DataFrame, mask: str = "mask") -> DataFrame:
    """(z, y, x, total): voxels with mask > 0 at or below the position on every axis, for a dense table.

    Three running sums, each over lines of the volume; a task sorts lines, never the volume.
    """
    out = df.select(*KEY, F.when(F.col(mask) > 0, 1).otherwise(0).cast("long").alias("total"))
    for k, a in enumerate(AXES):
        rest = [b for j, b in enumerate(AXES) if j != k]
        out = out.withColumn("total", F.sum("total").over(Window.partitionBy(*rest).orderBy(a)))
    return out


def masked_ratio(boxes: DataFrame, table: DataFrame, origin: Vec = (0, 0, 0)) -> DataFrame:
    """Add ratio: share of mask in each box (id, o*, s*), from the summed-area table at its 8 corners. One join for all corners."""
    corners = []
    for c in range(8):
        up = [(c >> 2) & 1, (c >> 1) & 1, c & 1]
        at = [(F.col(f"o{a}") + (F.col(f"s{a}") if u else 0) - 1).alias(a) for a, u in zip(AXES, up, strict=True)]
        corners.append(F.struct(*at, F.lit(1 if sum(up) % 2 else -1).alias("sign")))
    spots = boxes.select("id", F.inline(F.array(*corners)))
    for a, o in zip(AXES, origin, strict=True):
        spots = spots.filter(F.col(a) >= o)
    total = spots.join(table, KEY).groupBy("id").agg(F.sum(F.col("sign") * F.col("total")).alias("__n"))
    volume = F.col("sz") * F.col("sy") * F.col("sx")
    return boxes.join(total, "id", "left").withColumn("ratio", F.coalesce(F.col("__n"), F.lit(0)) / volume).drop("__n")


def accept_location(df: DataFrame, min_masked: float, p_reject: float, seed: int, number: str = "i", also: Column | None = None) -> DataFrame:
    """Keep a location if its ratio is at least ``min_masked``, else with probability 1 - p_reject; ``also`` is a further condition."""
    keep = (F.col("ratio") >= min_masked) | (draw(seed, number) >= p_reject)
    return df.filter(keep if also is None else keep & also)


def first_accepted(df: DataFrame, n: int, number: str = "i") -> DataFrame:
    """The first ``n`` accepted candidates by their number."""
    return df.orderBy(number).limit(n)


def reject(df: DataFrame, block: Sequence[str], mask: str, min_masked: float, p: float, seed: int, points: DataFrame | None = None) -> DataFrame:
    """(block, ratio) of the blocks kept: mean(mask) above ``min_masked``, else a draw above ``p``; with ``points`` only blocks that hold one."""
    means = df.groupBy(*block).agg(F.avg((F.col(mask) > 0).cast("int")).alias("ratio"))
    kept = means.filter((F.col("ratio") > min_masked) | (draw(seed, *block) > p))
    return kept if points is None else kept.join(points.select(*block).distinct(), list(block), "left_semi")


def point_locations(points: DataFrame, shape: Vec, n: int, seed: int) -> DataFrame:
    """(i, z, y, x, n_points): boxes of ``shape`` drawn to contain a drawn point, accepted with chance 1 / points inside.

    Points (id, z, y, x). A draw picks a point by its rank; points inside are counted by ``box_sums``.
    """
    ranked = with_rank(points.select("id", *KEY), "id")
    draws = points.sparkSession.range(n).select(F.col("id").alias("i"))
    picks = draws.select("i", (draw_below(F.lit(points.count()), seed, "i") + 1).alias("rank"))
    got = picks.join(ranked, "rank")
    at = {a: (F.col(a) - F.floor(draw(seed + 1 + k, "i") * s)).cast("long") for k, (a, s) in enumerate(zip(AXES, shape, strict=True))}
    boxes = got.select("i", *[v.alias(f"o{a}") for a, v in at.items()])
    return count_points(boxes, points, shape).filter(draw(seed + 9, "i") * F.col("n_points") < 1).select("i", *[F.col(f"o{a}").alias(a) for a in AXES], "n_points")


def count_points(boxes: DataFrame, points: DataFrame, shape: Vec) -> DataFrame:
    """Add n_points of each box (i, o*) of one shape."""
    tree = cube_tree(points.select(*KEY, F.lit(1).cast("long").alias("n_points")), ["n_points"], sides_for(shape))
    return box_sums(sized(boxes, shape), tree, ["n_points"]).drop(*[f"s{a}" for a in AXES])


def sized(boxes: DataFrame, shape: Vec) -> DataFrame:
    return boxes.withColumns({f"s{a}": F.lit(s).cast("long") for a, s in zip(AXES, shape, strict=True)})


def cut_blocks(voxels: DataFrame, locations: DataFrame, shape: Vec, cell: int = 16) -> DataFrame:
    """Voxels of every sampled box (i, z, y, x = corner), with coordinates from the corner; a voxel meets boxes by cubes of ``cell``."""
    floor = lambda c: F.floor(c / cell).cast("long")
    spots = locations.select("i", *[F.col(a).alias(f"o{a}") for a in AXES])
    for a, s in zip(AXES, shape, strict=True):
        spots = spots.withColumn(f"c{a}", F.explode(F.sequence(floor(F.col(f"o{a}")), floor(F.col(f"o{a}") + s - 1))))
    rows = voxels.withColumns({f"c{a}": floor(F.col(a)) for a in AXES}).join(spots, [f"c{a}" for a in AXES])
    for a, s in zip(AXES, shape, strict=True):
        rows = rows.filter((F.col(a) >= F.col(f"o{a}")) & (F.col(a) < F.col(f"o{a}") + s))
    return rows.withColumns({a: F.col(a) - F.col(f"o{a}") for a in AXES}).drop(*[f"c{a}" for a in AXES])
