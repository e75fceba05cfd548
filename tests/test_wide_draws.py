from pyspark.sql import functions as F

from voxlake.operators import project, sample

N = project.DRAWS


def test_keys_far_apart_draw_apart(spark):
    rows = spark.range(2000).select(project.draw(7, "id").alias("a"), project.draw(7, F.col("id") + N).alias("b"), project.draw(7, F.col("id") + 2 * N).alias("c"))
    assert rows.filter("a = b OR a = c OR b = c").count() < 20
    mean = rows.agg(*[F.avg(c) for c in "abc"]).first()
    assert all(0.45 < m < 0.55 for m in mean)


def test_positions_between_the_coarse_draws_are_reached(spark):
    n = 64 * N
    shifts = spark.sql(f"SELECT 0L AS lo_z, 1L AS hi_z, 0L AS lo_y, {n}L AS hi_y, 0L AS lo_x, 10L AS hi_x")
    got = sample.random_locations(shifts, 4000, (1, 1, 1), 5)
    low, high, kinds = got.agg(F.min("y"), F.max("y"), F.count_distinct(F.pmod(F.col("y"), F.lit(64)))).first()
    assert 0 <= low < n // 100 and n - n // 100 < high < n and kinds == 64


def test_small_spans_draw_as_before(spark):
    n = F.lit(700)
    rows = spark.range(3000).select(project.draw_below(n, 9, "id").alias("a"), F.floor(project.draw(9, "id") * n).alias("b"))
    assert rows.filter("a != b").count() == 0


def test_draws_of_neighbouring_seeds_are_independent(spark):
    bits = [(project.draw(5 + k, "id") < 0.5).cast("int").alias(f"b{k}") for k in range(3)]
    counts = [r["count"] for r in spark.range(8000).select(*bits).groupBy("b0", "b1", "b2").count().collect()]
    assert len(counts) == 8 and all(850 < n < 1150 for n in counts)


def test_all_draws_are_reached(spark):
    assert spark.range(N).select(project.draw(3, "id").alias("u")).distinct().count() > 0.6 * N
