import pytest
from pyspark.sql import functions as F

from voxlake.operators import resample
from voxlake.plans import jobs


def test_few_labels_still_give_all_blocks(spark):
    df = resample.dense_box(spark.range(1), (0, 0, 0), (12, 12, 12))
    df = df.withColumns({"raw": F.lit(0.5), "label": ((F.col("z") < 3) & (F.col("y") < 3) & (F.col("x") < 3)).cast("int"), "mask": F.lit(1)})
    got = jobs.build_training_blocks(df, ((0, 0, 0), (12, 12, 12)), (3, 3, 3), 6, 3, p_reject=1.0)
    assert got.select("i").distinct().count() == 6 and got.count() == 6 * 27


def test_volumes_are_drawn_by_voxels_and_blocks_deformed(spark):
    def volume(n, value):
        df = resample.dense_box(spark.range(1), (0, 0, 0), (n, n, n))
        return df.withColumns({"raw": F.lit(value), "label": (F.col("x") % 2).cast("int"), "mask": F.lit(1)}), ((0, 0, 0), (n, n, n))

    sets = {"large": volume(24, 0.25), "small": volume(8, 0.75)}
    runs = [sorted(map(tuple, jobs.build_training_sets(sets, (4, 4, 4), 20, 3, factor=2, elastic=(2, 0.5, (0.0, 1.0)), scale=(1.0, 1.0), shift=(0.0, 0.0)).collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 20 * 64
    blocks = jobs.build_training_sets(sets, (4, 4, 4), 20, 3, factor=2, elastic=(2, 0.5, (0.0, 1.0)), scale=(1.0, 1.0), shift=(0.0, 0.0))
    n = {r.dataset: (r.n, r.low, r.high) for r in blocks.groupBy("dataset").agg(F.count_distinct("i").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).collect()}
    assert n["large"][0] >= 17 and n["large"][1:] == pytest.approx((-0.5, -0.5))  # 27 times the voxels; 2 v - 1 of a constant


def test_other_boxes_are_mirrored_and_swap_equal_axes(spark):
    df = resample.dense_box(spark.range(1), (0, 0, 0), (2, 3, 3)).withColumns({"v": F.col("z") * 9 + F.col("y") * 3 + F.col("x")})
    df = df.crossJoin(spark.range(40).withColumnRenamed("id", "b"))
    got = resample.simple_augment(df, ["b"], (2, 3, 3), 5)
    assert got.select("b", "z", "y", "x").distinct().count() == 40 * 18 and got.agg(F.max("z"), F.max("y"), F.max("x")).first() == (1, 2, 2)
    at = {(r.b, r.x): r.v for r in got.filter("z = 0 AND y = 0 AND x < 2").collect()}
    assert len({at[b, 0] for b in range(40)}) > 1
    assert {abs(at[b, 1] - at[b, 0]) for b in range(40)} == {1, 3}  # along x, and along what was y
