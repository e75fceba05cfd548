"""Summed-area tables and pyramids on blocks, running sums over ranges, histogram matching of floats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import back, volume, voxels
from voxlake.functions.ranks import nearest_known, ordered_parts, running_sum
from voxlake.operators import block_sums as S
from voxlake.operators import blocks as B
from voxlake.operators import histogram as H


def as_blocks(spark, a, chunk, kind="int32"):
    return B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, kind)


@pytest.mark.parametrize("chunk", [(6, 9, 7), (2, 4, 3), (1, 1, 2), (5, 9, 1)])
def test_sums_and_boxes_equal_numpy(spark, chunk):
    a = volume() * (np.random.default_rng(3).random((6, 9, 7)) < 0.6)
    want = (a > 0).cumsum(0).cumsum(1).cumsum(2)
    table = S.integral_blocks(as_blocks(spark, a, chunk))
    assert (back(B.blocks_to_voxels(table), a.shape) == want).all()
    rng = np.random.default_rng(4)
    boxes = []
    for i in range(40):
        o = [int(rng.integers(0, n)) for n in a.shape]
        boxes.append((i, *o, *[int(rng.integers(1, n - p + 1)) for n, p in zip(a.shape, o)]))
    df = spark.createDataFrame(boxes, "id int, oz int, oy int, ox int, sz int, sy int, sx int")
    got = {r.id: r.ratio for r in S.masked_ratio_blocks(df, table, ((0, 0, 0), a.shape), chunk).collect()}
    for i, z, y, x, d, h, w in boxes:
        assert got[i] == pytest.approx((a[z : z + d, y : y + h, x : x + w] > 0).mean())


def test_many_boxes_in_one_chunk_are_answered_as_they_stream(spark):
    a = np.ones((4, 4, 4), int)
    boxes = spark.range(30_000).selectExpr("id", "0 AS oz", "0 AS oy", "1 AS ox", "4 AS sz", "CAST(1 + id % 4 AS INT) AS sy", "2 AS sx")
    got = S.box_sums(boxes, S.integral_blocks(as_blocks(spark, a, (4, 4, 4))), ((0, 0, 0), a.shape), (4, 4, 4))
    assert got.filter("total = 8 * (1 + id % 4)").count() == 30_000


def test_only_rims_go_through_the_running_sums(spark):
    rims = S._rims(as_blocks(spark, volume((8, 8, 8)), (4, 4, 4)))
    assert rims.agg(F.sum(F.length("data"))).first()[0] == 8 * 8 * (3 * 16 + 3 * 4 + 1)


def reduced(a, f, kind):
    full = np.pad(a, [(0, -n % k) for n, k in zip(a.shape, f)])
    if kind == "label":
        return full[f[0] // 2 :: f[0], f[1] // 2 :: f[1], f[2] // 2 :: f[2]]
    z, y, x = (n // k for n, k in zip(full.shape, f))
    return np.array([[[full[i * f[0] : (i + 1) * f[0], j * f[1] : (j + 1) * f[1], k * f[2] : (k + 1) * f[2]].sum() // (f[0] * f[1] * f[2]) for k in range(x)] for j in range(y)] for i in range(z)])


@pytest.mark.parametrize("kind", ["mean", "label"])
@pytest.mark.parametrize("shape", [(7, 13, 20), (8, 16, 16), (1, 2, 3)])
def test_levels_equal_reduced_arrays(spark, kind, shape):
    a = np.random.default_rng(1).integers(0, 200, shape)
    scales = [2, (1, 2, 2), 2]
    levels = S.pyramid_blocks(as_blocks(spark, a, (4, 8, 8)), ((0, 0, 0), shape), (4, 8, 8), scales, kind)
    want = a
    for level, f in zip(levels, scales):
        want = reduced(want, (f,) * 3 if isinstance(f, int) else f, kind)
        assert (back(B.blocks_to_voxels(level), want.shape) == want).all()
    plan = levels[2]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan  # a written level, nothing of those before
    with pytest.raises(ValueError, match="multiples"):
        S.pyramid_blocks(as_blocks(spark, a, (3, 8, 8)), ((0, 0, 0), shape), (3, 8, 8), [2], kind)


def test_running_sums_and_nearest_values_go_across_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), int(n), float(v) if rng.random() < 0.02 else None) for v, n in zip(rng.permutation(5000), rng.integers(0, 9, 5000))]
    df = spark.createDataFrame(rows, "v double, n long, mark double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as little data as this would be one range
    try:
        parts = ordered_parts(df.repartition(7), [F.col("v")], "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.select("__part").distinct().count() > 3
    up = {r.v: r.s for r in running_sum(parts, "n", "s").collect()}
    near = {r.v: (r.lo, r.hi) for r in nearest_known(parts, F.col("mark"), "lo", "hi").collect()}
    total, known = 0, sorted(m for _, _, m in rows if m is not None)
    for v, n, _ in sorted(rows):
        total += n
        assert up[v] == total
        assert near[v] == (max((m for m in known if m <= v), default=None), min((m for m in known if m >= v), default=None))


def test_matching_of_floats_equals_numpy(spark):
    rng = np.random.default_rng(6)
    src, tmpl = rng.normal(0, 1, 3000).round(3), rng.gamma(2, 3, 2000)
    df = spark.createDataFrame([(float(v), 1) for v in src], "v double, mask int").repartition(5)
    other = spark.createDataFrame([(float(v), 1) for v in tmpl] + [(1e9, 0)], "v double, mask int")
    values, counts = np.unique(src, return_counts=True)
    tv, tc = np.unique(tmpl, return_counts=True)
    want = dict(zip(values, np.interp(counts.cumsum() / len(src), tc.cumsum() / len(tmpl), tv)))
    got = H.match_histograms(df, other).collect()
    assert len(got) == 3000 and all(r.mapped == pytest.approx(want[r.v], rel=1e-9, abs=1e-9) for r in got)


def test_a_value_outside_the_mask_only_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (None, 1)], "v int, mask int")
    tmpl = spark.createDataFrame([(5, 1), (6, 1)], "v int, mask int")
    with pytest.raises(Exception, match="outside the mask only: 9"):
        H.match_histograms(df, tmpl).collect()
    assert sorted(((r.v, r.mapped) for r in H.match_histograms(df.filter("mask = 1"), tmpl).collect()), key=str) == [(1, 5.0), (2, 6.0), (None, None)]
    assert [r.mapped for r in H.match_histograms(df.filter("v < 3"), tmpl.filter("false")).collect()] == [None, None]
