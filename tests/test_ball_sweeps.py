"""Openings and closings by round balls on words of 64 voxels along x."""

from itertools import product

import numpy as np
import pytest

from voxlake.operators import neighbourhood as N

BOXES = [((0, 0, 0), (4, 6, 150)), ((-3, 5, -70), (5, 7, 64)), ((2, -4, 9), (1, 5, 129)), ((0, 0, 0), (6, 6, 1))]


def plain(fg, radius, box, passes):
    """A voxel at a time."""
    ball = N.round_ball(radius)
    volume = set(product(*[range(o, o + s) for o, s in zip(*box)]))
    for grow in passes:
        near = {p: [(p[0] + z, p[1] + y, p[2] + x) for z, y, x in ball] for p in volume}
        fg = {p for p, qs in near.items() if (any(q in fg for q in qs) if grow else all(q in fg or q not in volume for q in qs))}
    return fg


def voxels(box, share, seed):
    rng = np.random.default_rng(seed)
    return {tuple(map(int, p + np.array(box[0]))) for p in np.argwhere(rng.random(box[1]) < share)}


def table(spark, fg):
    return spark.createDataFrame(sorted(fg), "z int, y long, x int")


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("radius,box", [(0, BOXES[0]), *[(1, b) for b in BOXES], *[(2, b) for b in BOXES], (3, BOXES[1]), (6, BOXES[0])])
def test_equal_a_plain_version(spark, radius, box):
    dense, thin = voxels(box, 0.97 if radius < 3 else 0.997, radius), voxels(box, 0.1 if radius < 3 else 0.01, radius)
    opened, closed = N.open_ball(table(spark, dense), radius, box), N.close_ball(table(spark, thin), radius, box)
    assert found(opened) == plain(dense, radius, box, (False, True))
    assert found(closed) == plain(thin, radius, box, (True, False))
    assert opened.dtypes == closed.dtypes == [("z", "int"), ("y", "bigint"), ("x", "int")]


def test_rows_given_twice_and_voxels_outside_the_box(spark):
    """What lies outside is foreground to an erosion, whether there is a row for it or not, and is dilated like any other."""
    box, out = BOXES[0], {(0, 0, -1), (0, 2, 150), (1, 2, 151), (4, 3, 70), (-1, 5, 64), (0, -2, 63), (9, 9, 999)}
    dense, thin = voxels(box, 0.97, 7), voxels(box, 0.05, 7)
    twice = table(spark, dense | out).unionByName(table(spark, dense))
    assert found(N.open_ball(twice, 2, box)) == plain(dense, 2, box, (False, True))
    twice = table(spark, thin | out).unionByName(table(spark, thin))
    assert found(N.close_ball(twice, 2, box)) == plain(thin | out, 2, box, (True, False))
    assert found(N.close_ball(twice.filter("false"), 2, box)) == found(N.open_ball(twice.filter("false"), 2, box)) == set()


def test_moved_bits_reach_over_several_words(spark):
    word = spark.sql("SELECT -9223372036854775807L AS bits")  # the first and the last voxel
    got = word.select(*[c.alias(f"b{k}") for k, c in enumerate(N._along_x(word.bits, 70, 2))]).first()
    at = [64 * k + i for k, v in enumerate(got) for i in range(64) if v >> i & 1]
    assert at == list(range(128 - 70, 191 + 70 + 1))


def _made(plan):
    """Rows that the generators of a plan have given out."""
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(_made(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("operator", [N.open_ball, N.close_ball])
def test_a_sweep_does_not_send_every_voxel_to_its_ball(spark, operator):
    """It made 33 rows of a voxel for each of its two passes."""
    n = 3 * 40 * 128
    cube = spark.range(n).selectExpr("id DIV 5120 AS z", "id DIV 128 % 40 AS y", "id % 128 AS x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        swept = operator(cube, 2, ((0, 0, 0), (3, 40, 128)))
        assert len(swept.collect()) == n  # the cube fills its box
        assert n <= _made(swept._jdf.queryExecution().executedPlan()) < 4 * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
