"""Unit cases: constant labels through padding and augmentation, downsampling of positions, merging of overlapping labels, channel axes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.functions.ranks import with_rank
from voxlake.operators import merge, metrics, project, resample, roi, sample
from voxlake.plans import jobs


def cube(spark, n):
    return resample.dense_box(spark.range(1), (0, 0, 0), (n, n, n))


@pytest.mark.parametrize("value", [0, 5])
def test_constant_label_keeps_its_value(spark, value):
    df = project.constant_like(cube(spark, 10), "v", value)
    assert df.agg(F.sum("v")).first()[0] == value * 1000


@pytest.mark.parametrize("value", [0, 3, 5])
def test_constant_label_survives_crop_pad_and_mirror(spark, value):
    df = project.constant_like(roi.crop(cube(spark, 12), (1, 1, 1), (10, 10, 10)), "v", value)
    df = resample.pad(df, (0, 0, 0), (12, 12, 12), {"v": value}).withColumn("b", F.lit(1))
    df = resample.simple_augment(df, ["b"], 12, 4)
    assert {r.v for r in df.select("v").distinct().collect()} == {value}
    assert df.select("z", "y", "x").distinct().count() == 12**3


def test_downsample_of_positions(spark):
    df = cube(spark, 12).withColumn("v", F.col("z") + F.col("y") + F.col("x"))
    got = {(r.z, r.y, r.x): r.v for r in resample.downsample(roi.crop(df, (4, 4, 4), (8, 8, 8)), 2, (4, 4, 4)).collect()}
    assert got[0, 0, 0] == 12 and got[1, 0, 0] == 14 and len(got) == 64


@pytest.mark.parametrize("mode,at_overlap", [("max", 2), ("background", 0)])
def test_merge_of_overlapping_labels(spark, mode, at_overlap):
    df = cube(spark, 3).withColumns({"a": F.when((F.col("z") == 0) | ((F.col("z") == 1) & (F.col("y") == 0) & (F.col("x") == 0)), 1).otherwise(0), "b": F.when(F.col("z") == 1, 1).otherwise(0)})
    got = {(r.z, r.y, r.x): r.label for r in merge.merge_labels(df, {"a": 1, "b": 2}, mode).collect()}
    assert got[0, 1, 1] == 1 and got[1, 1, 1] == 2 and got[1, 0, 0] == at_overlap
    with pytest.raises(NotImplementedError):
        merge.merge_labels(df, {"a": 1}, "preference")


def test_channel_axes(spark):
    df = project.unsqueeze(cube(spark, 2).withColumn("v", F.lit(1)))
    assert project.squeeze(df).columns == ["z", "y", "x", "v"]
    with pytest.raises(ValueError):
        project.squeeze(project.stack_channels([df.drop("c")] * 2))
    with pytest.raises(ValueError):
        project.stack_channels([df])


def test_argmax_ties_go_to_the_lowest_channel(spark):
    df = spark.createDataFrame([(0, 0, 0, c, v) for c, v in enumerate([0.2, 0.4, 0.4])], "z long, y long, x long, c int, v double")
    assert merge.argmax_segment(df).first().seg == 1


def test_conversions_check_their_range(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (-0.5,)], "v double")
    assert [r.v for r in project.float_to_uint8(df, "v").collect()] == [128, 0, 255, 0]
    with pytest.raises(PySparkException):
        project.float_to_uint8(spark.createDataFrame([(1.5,)], "v double"), "v").collect()
    with pytest.raises(PySparkException):
        project.export_uint8(spark.createDataFrame([(300,)], "v int"), "v", "uint16").collect()
    wrapped = project.to_dtype(spark.createDataFrame([(-1,), (256,), (300,)], "v long"), ["v"], "uint8")
    assert [r.v for r in wrapped.collect()] == [255, 0, 44]
    signed = project.to_dtype(spark.createDataFrame([(127,), (128,)], "v long"), ["v"], "int8")
    assert [r.v for r in signed.collect()] == [127, -128]


def test_region_arithmetic(spark):
    box = spark.createDataFrame([(5, 5, 5, 3, 10, 4)], "oz long, oy long, ox long, sz long, sy long, sx long")
    assert tuple(roi.grow_to(box, (6, 6, 5)).first()) == (4, 5, 5, 6, 10, 5)
    assert tuple(roi.snap(box, (4, 4, 4), "grow").first()) == (4, 4, 4, 4, 12, 8)
    assert tuple(roi.snap(box, (4, 4, 4), "shrink").first()) == (8, 8, 8, 0, 4, 0)
    with pytest.raises(ValueError):
        roi.assert_contains(box, ((0, 0, 0), (1, 1, 1)))
    tiles = roi.tile(spark, (0, 10, 0), (5, 4, 3), (2, 4, 2), (1, 1, 1)).collect()
    assert len(tiles) == 6 and sum(t.sz * t.sy * t.sx for t in tiles) == 60
    assert {(t.oz, t.roz, t.rsz) for t in tiles} == {(0, -1, 4), (2, 1, 4), (4, 3, 3)}


def test_scores_of_empty_classes(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.1)], "t int, p double")
    row = metrics.sweep(df, "t", "p", [0.5]).first()
    assert row.jaccard == 1.0 and row.dice != row.dice and row.precision == 0.0 and row.recall == 0.0
    best = metrics.best_threshold(metrics.sweep(df, "t", "p", [0.3, 0.5]), "jaccard").first()
    assert (best.score, best.threshold) == (1.0, 0.5)
    assert metrics.thresholds(0.1, 0.5, 0.2) == [0.1, 0.3, 0.5]


def test_draws_do_not_depend_on_partitions(spark):
    a, b = (spark.range(100, numPartitions=k).select("id", project.draw(7, "id").alias("u")).orderBy("id").collect() for k in (1, 5))
    assert a == b and len({r.u for r in a}) > 90 and all(0 <= r.u < 1 for r in a)


def test_training_blocks_repeat_and_are_complete(spark):
    df = cube(spark, 12).withColumns({"raw": F.lit(0.5), "label": (F.col("x") % 2).cast("int"), "mask": F.lit(1)})
    runs = [sorted(map(tuple, jobs.build_training_blocks(df.repartition(k), ((0, 0, 0), (12, 12, 12)), (4, 4, 4), 5, 3).collect())) for k in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == 5 * 64


def test_possible_shifts_of_arrays(spark):
    box = "array string, oz long, oy long, ox long, sz long, sy long, sx long"
    arrays = spark.createDataFrame([("raw", 0, 0, 0, 20, 20, 20), ("label", 5, 5, 5, 10, 10, 10)], box)
    request = spark.createDataFrame([("raw", 0, 0, 0, 10, 10, 10), ("label", 3, 3, 3, 4, 4, 4)], box)
    row = sample.possible_shifts(arrays, request, (1, 1, 1)).first()
    assert (row.lo_z, row.hi_z) == (2, 9)


def test_ranks_equal_row_numbers(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") % 7919 - 100).alias("k")).distinct()
    got = {r.k: r.rank for r in with_rank(df, "k").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(1, len(got) + 1))


def test_histograms_are_clipped_side_by_side(spark):
    import numpy as np

    from voxlake.operators import histogram

    rng = np.random.default_rng(5)
    many = np.where(rng.random((1300, 256)) < 0.05, rng.integers(0, 900, (1300, 256)), rng.integers(0, 9, (1300, 256)))
    many[7], many[8, 1:], many[9] = 0, 0, 10_000
    alone = np.array([histogram.clip_counts(h, 10) for h in many])
    assert (histogram.clip_counts(many, 10) == alone).all()
    rows = spark.createDataFrame([(0, k // 100, k % 100, b, int(h[b])) for k, h in enumerate(many) for b in np.flatnonzero(h).tolist()], "tz long, ty long, tx long, bin int, n long")
    out = histogram.clip_histogram(rows, 10)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # a call into Python for each tile
    got = np.zeros((1300, 256), np.int64) - 1
    for r in out.collect():
        got[r.ty * 100 + r.tx, r.bin] = r.n
    there = many.any(1)
    assert (got[there] == alone[there]).all() and (got[~there] == -1).all()
