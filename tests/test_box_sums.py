"""Sums over boxes, masks of boxes and curves of scores against plain versions, on crowded and deep tables."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import box_sums, metrics, roi, sample

BOX = "i long, oz long, oy long, ox long, sz long, sy long, sx long"


def inside(p, b):
    return all(o <= v < o + s for v, o, s in zip(p, b[1:4], b[4:7]))


def crowded(n, seed=3):
    """Nine tenths of the points in a cube of 8, a third on one voxel; the rest over a volume 10,000 deep, below zero too."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 0:
            out.append((5, 5, 5))
        elif k % 10:
            out.append(tuple(rnd.randrange(8) for _ in range(3)))
        else:
            out.append((rnd.randrange(-5000, 5000), rnd.randrange(-40, 40), rnd.randrange(90)))
    return out


def test_sums_of_boxes_equal_a_plain_count(spark):
    rnd = random.Random(1)
    points = crowded(3000)
    weights = [rnd.randrange(5) for _ in points]
    boxes = [(k, rnd.randrange(-200, 200), rnd.randrange(-50, 30), rnd.randrange(-10, 60), *(rnd.choice((1, 4, 17, 64, 130)) for _ in "zyx")) for k in range(60)]
    boxes += [(60, -5000, -40, 0, 10_000, 80, 90), (61, 0, 0, 0, 0, 5, 5), (62, 5, 5, 5, 1, 1, 1), (63, 5, 5, 5, 1, 1, 1), (64, -9000, 0, 0, 5, 5, 5)]
    rows = spark.createDataFrame([(*p, w, 1) for p, w in zip(points, weights)] + [(None, 1, 1, 9, 1), (5, 5, 5, None, 0)], "z int, y int, x int, w int, n int")
    tree = box_sums.cube_tree(rows, ["w", "n"])
    got = {r.i: (r.w, r.n) for r in box_sums.box_sums(spark.createDataFrame(boxes, BOX), tree, ["w", "n"]).collect()}
    for b in boxes:
        hit = [w for p, w in zip(points, weights) if inside(p, b)]
        assert got[b[0]] == (sum(hit), len(hit)), b
    assert got[60] == (sum(weights), len(points))


def test_a_cube_holds_64_rows_at_most_however_crowded(spark):
    rows = spark.createDataFrame([(*p, 1) for p in crowded(5000)], "z int, y int, x int, n int")
    tree = box_sums.cube_tree(rows, ["n"])
    assert tree[4].agg(F.max(F.size("at"))).first()[0] <= 64
    assert all(tree[s].agg(F.sum("v_n")).first()[0] == 5000 and tree[s].select(*box_sums.CELL).distinct().count() == tree[s].count() for s in box_sums.SIDES)


def test_no_rows_and_no_boxes(spark):
    rows, boxes = spark.createDataFrame([], "z int, y int, x int, n int"), spark.createDataFrame([(1, 0, 0, 0, 2, 2, 2)], BOX)
    assert box_sums.box_sums(boxes, box_sums.cube_tree(rows, ["n"]), ["n"]).collect()[0].n == 0
    full = box_sums.cube_tree(spark.createDataFrame([(0, 0, 0, 1)], "z int, y int, x int, n int"), ["n"])
    assert box_sums.box_sums(boxes.filter("false"), full, ["n"]).count() == 0


def test_point_boxes_count_their_points(spark):
    points = crowded(600)
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, z long, y long, x long")
    got = sample.point_locations(table, (3, 5, 7), 400, 9).collect()
    assert got
    for r in got:
        assert r.n_points == sum(inside(p, (0, r.z, r.y, r.x, 3, 5, 7)) for p in points) >= 1


def test_mask_of_boxes_that_overlap_at_one_place(spark):
    rnd = random.Random(4)
    boxes = [(k, rnd.randrange(-3, 3), rnd.randrange(-3, 3), rnd.randrange(-3, 3), *(rnd.randrange(0, 5) for _ in "zyx")) for k in range(200)]
    boxes += [(200 + k, 7, 6, 5, 2, 3, 4) for k in range(300)] + [(999, 2, 12, -6, 1, 1, 30)]
    grid = spark.range(20 * 24 * 30).selectExpr("id DIV 720 - 6 AS z", "id DIV 30 % 24 - 6 AS y", "id % 30 - 8 AS x")
    got = roi.boxes_to_mask(grid, spark.createDataFrame(boxes, BOX)).collect()
    assert len(got) == 20 * 24 * 30
    kinds = {b[1:] for b in boxes}
    assert all(r["mask"] == 255 * any(inside((r.z, r.y, r.x), (0, *b)) for b in kinds) for r in got)
    assert {r["mask"] for r in roi.boxes_to_mask(grid, spark.createDataFrame([], BOX)).collect()} == {0}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_curve_of_scores_that_crowd_at_the_ends(spark, by):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", None]), int(rnd.random() < 0.4), rnd.choice([rnd.random() * 1e-6, 1 - rnd.random() * 1e-6, 0.0, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, s double")
    curve = metrics.pr_curve(df, "t", "s", by)
    got = {(r.g if by else 0, r.threshold): (r.tp, r.fp) for r in curve.collect()}
    area = {r.g if by else 0: r.average_precision for r in metrics.average_precision(curve, by).collect()}
    for g in {r[0] if by else 0 for r in rows}:
        mine = [(t, s) for h, t, s in rows if not by or h == g]
        want, last, total = {}, 0.0, 0.0
        for at in sorted({s for _, s in mine if s}, reverse=True) + [0.0]:
            hit = [t for t, s in mine if at == 0 or (s is not None and s >= at)]
            want[g, at] = sum(hit), len(hit) - sum(hit)
            recall = sum(hit) / sum(t for t, _ in mine)
            total, last = total + (recall - last) * sum(hit) / len(hit), recall
        assert {k: v for k, v in got.items() if k[0] == g} == want
        assert area[g] == pytest.approx(total, abs=1e-9)
