"""A grid is made of few rows by explode, and Spark takes it for as small as those: no join may send it whole to every executor."""

from pyspark.sql import functions as F

from voxlake.operators import neighbourhood


def test_foreground_mask_reads_a_written_volume(spark):
    grid = spark.sql("SELECT z, y, explode(sequence(0, 9)) AS x FROM (SELECT z, explode(sequence(0, 9)) AS y FROM (SELECT explode(sequence(0, 6)) AS z))")
    values = grid.select("z", "y", "x", (F.col("z") * 40 + F.col("x")).alias("v")).filter("x < 8")
    raw = grid.join(values, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))
    mask = neighbourhood.foreground_mask(raw, ((0, 0, 0), (7, 10, 10)), 2, 250, 1, 1, 50)
    assert "explode" not in mask._jdf.queryExecution().optimizedPlan().toString()
    assert mask.count() == 700 and mask.filter("mask = 255").count() > 0


def test_what_is_made_of_the_grid_is_not_broadcast(spark, tmp_path):
    from voxlake.plans.views import view

    for table, rows in {
        "part": "SELECT id AS p_partkey, 7 AS p_size FROM range(10)",
        "lineitem": """SELECT id * 1000 AS l_orderkey, id % 10 AS l_partkey, id % 10 AS l_suppkey, 1 AS l_linenumber, 3D AS l_quantity, 0D AS l_discount,
            0D AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus FROM range(3000)""",
    }.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{table}.parquet")
    grid, blob = view(spark, str(tmp_path), "grid"), view(spark, str(tmp_path), "blob")
    for rows in (grid, blob):  # 20,993,700 rows
        assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 20_993_700
    mask = neighbourhood.metric_mask(grid, blob.filter("id != 0").select("z", "y", "x"), 2, 2)
    joins = [line for line in mask._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert "SortMergeJoin" in joins[0]  # of the grid with the band; the values are few here
    assert grid.dtypes == [("z", "int"), ("y", "bigint"), ("x", "int")]


def test_the_grid_of_an_empty_table_has_no_row(spark, tmp_path):
    from voxlake.plans.views import view

    spark.sql("SELECT id AS p_partkey, 7 AS p_size FROM range(0)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("""SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 3D AS l_quantity, 0D AS l_discount, 0D AS l_tax, 'R' AS l_returnflag,
        'F' AS l_linestatus FROM range(0)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert view(spark, str(tmp_path), "grid").count() == 0
