"""Queries that must cover all rows of their tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxlake.operators import loss, neighbourhood
from voxlake.plans.views import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_entry_counts_every_voxel_inside_the_masks(spark):
    n = view(spark, SF, "vox").filter("mask != 0 AND mmask != 0").count()
    assert {r.tp + r.fp + r.fn + r.tn for r in __spark_entry__.entry(spark).collect()} == {n}


def test_evaluation_leaves_out_the_padding_only(spark):
    vox = view(spark, SF, "vox")
    top = vox.agg(*[F.max(a) for a in "zyx"]).first()
    n = vox.filter("mask != 0 AND mmask != 0 AND z > 0 AND y > 0 AND x > 0").filter((F.col("z") < top[0]) & (F.col("y") < top[1]) & (F.col("x") < top[2])).count()
    assert {r.tp + r.fp + r.fn + r.tn for r in run(spark, "agg_08_evaluate_whole").collect()} == {n}


def test_import_keeps_every_second_y(spark):
    vox = view(spark, SF, "vox").filter("z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
    got = run(spark, "res_06_import_gt_whole")
    assert got.count() == vox.count() and got.agg(F.min("y")).first()[0] == 0
    assert got.select("y").distinct().count() == vox.select("y").distinct().count()


@pytest.mark.parametrize("mode", ["max", "background"])
def test_every_id_and_channel_is_merged(spark, mode):
    got = run(spark, f"mrg_05_descriptors_{mode}_whole")
    assert got.count() == view(spark, SF, "desc").count() == got.select("vec_id").distinct().count() * 64


def test_every_configuration_is_in_the_union(spark):
    assert run(spark, "src_04_split_union_configs_whole").count() == view(spark, SF, "boxes").count()


def test_the_grid_is_made_in_stripes_by_many_tasks(spark):
    grid, top = view(spark, SF, "grid"), view(spark, SF, "vox").agg(F.max("y")).first()[0]
    assert grid.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, grid.collect())) == [(z, y, x) for z in range(7) for y in range(top + 1) for x in range(100)]


def test_copies_of_all_rows_do_not_change_the_dice_loss(spark):
    def dice(n):
        rows = spark.range(n).select((F.col("id") % 7 / 7).alias("s0"), (F.col("id") % 5 / 5).alias("s1"), (F.col("id") % 35 > 20).cast("int").alias("t"))
        return loss.generalized_dice(rows, ["s0", "s1"], "t").first()[0]

    assert dice(35) == pytest.approx(dice(35 * 400_000), abs=1e-9)


def test_augmentation_of_blocks_beyond_the_draws_equals_its_sql(spark, tmp_path):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey < 300").withColumn("l_orderkey", F.col("l_orderkey") + 7_001_000)
    lineitem.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["res_07_simple_augment"](lineitem.sparkSession, with_part(spark, tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'; CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["res_07_simple_augment"])
    names = [d[0] for d in want.description]
    assert got.agg(F.min("b")).first()[0] > 1_000_003
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def with_part(spark, folder):
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_what_neighbours_send_is_summed_before_it_shuffles(spark):
    cube = spark.range(20**3).repartition(16).selectExpr("id DIV 400 AS z", "id DIV 20 % 20 AS y", "id % 20 AS x")
    sent = neighbourhood.spread(cube, neighbourhood.cross_ball(2)).select("z", "y", "x", F.spark_partition_id().alias("p"))
    assert sent.count() == 25 * 20**3
    assert sent.distinct().count() == sent.select("z", "y", "x").distinct().count()
