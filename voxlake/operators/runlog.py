"""Run logs (run_id, metric, step, value) and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_scalars(df: DataFrame, every: int) -> DataFrame:
    """Rows of every n-th step; a list of loss components (values) becomes one metric for each, numbered from 0."""
    rows = df.filter(F.col("step") % every == 0)
    if "values" in df.columns:
        rows = rows.select("run_id", "metric", "step", F.posexplode("values").alias("__k", "value"))
        rows = rows.withColumn("metric", F.concat("metric", F.lit("_"), F.col("__k"))).drop("__k")
    return rows.select("run_id", "metric", "step", "value")


def loss_increase(df: DataFrame, factor: float) -> DataFrame:
    """Add jump: previous loss * factor < loss; never at a run's first step."""
    step = Window.partitionBy("run_id").orderBy("step")
    return df.withColumn("jump", F.coalesce(F.lag("value").over(step) * factor < F.col("value"), F.lit(False)))


def latest_checkpoint(df: DataFrame, pattern: str = r"_checkpoint_(\d+)$") -> DataFrame:
    """(run_id, iteration): the largest number that ends a checkpoint's name; 0 if none has one."""
    number = F.regexp_extract("name", pattern, 1)
    return df.groupBy("run_id").agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0).cast("long")).alias("iteration"))


def pick_iteration(df: DataFrame, loss: str, f1: str) -> DataFrame:
    """Per run the step of the smallest loss and of the largest F1, the earliest of equals."""
    low = F.min(F.when(F.col("metric") == loss, F.struct("value", "step")))
    high = F.max(F.when(F.col("metric") == f1, F.struct(F.col("value"), (-F.col("step")).alias("n"))))
    return df.groupBy("run_id").agg(low.alias("a"), high.alias("b")).select("run_id", F.col("a.step").alias("best_loss_step"), (-F.col("b.n")).alias("best_f1_step"))


def with_iteration(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Consecutive numbers from 0 in each run."""
    return df.withColumn("iteration", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def snapshot(df: DataFrame, every: int, also: Column | None = None) -> DataFrame:
    """Rows to keep: every n-th iteration, or where ``also`` holds."""
    keep = F.col("iteration") % every == 0
    return df.filter(keep if also is None else keep | also)


def write_snapshot(df: DataFrame, path: str, every: int, also: Column | None = None) -> None:
    snapshot(df, every, also).write.mode("append").partitionBy("iteration").parquet(path)


def snapshot_arrays(batches: DataFrame, losses: DataFrame, path: str, every: int, also: Column | None = None, value_range: bool = True) -> DataFrame:
    """Write the batches to keep as a table by iteration, with what a viewer needs beside the blocks, and return it reread.

    ``batches``: iteration, array, blocks, offset_nm and resolution (arrays of three numbers); ``losses``: iteration, loss. Kept are every n-th iteration
    and those where ``also``, a condition on the losses' columns, holds. Every row gets the loss and, with ``value_range``, the smallest and largest value of
    its array in that iteration. Ranges are formed a block at a time, so blocks meet no other rows.
    """
    import pandas as pd

    from . import blocks as B

    kept = snapshot(losses, every, also).select("iteration", F.col("loss").cast("double").alias("loss"))
    rows = batches.select("iteration", "array", *B.COLUMNS, "offset_nm", "resolution").join(F.broadcast(kept) if kept.count() < 1 << 20 else kept, "iteration")
    low, high = (F.lit(None).cast("double").alias(c) for c in ("lo", "hi"))
    if value_range:

        def ends(parts):
            for part in parts:
                yield pd.DataFrame([(r.iteration, r.array, float(a.min()), float(a.max())) for r in part.itertuples() if (a := B.array_of(r)).size], columns=["iteration", "array", "lo", "hi"])

        kind = dict(rows.dtypes)["iteration"]
        ranges = rows.select("iteration", "array", *B.COLUMNS).mapInPandas(ends, f"iteration {kind}, array string, lo double, hi double")
        ranges = ranges.groupBy("iteration", "array").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rows = rows.join(F.broadcast(ranges) if ranges.count() < 1 << 20 else ranges, ["iteration", "array"])
    else:
        rows = rows.withColumns({"lo": low, "hi": high})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(path)
    return rows.sparkSession.read.parquet(path)
