"""Joins of arrays and reductions over channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("z", "y", "x")


def align(base: DataFrame, others: Mapping[str, tuple[DataFrame, object]]) -> DataFrame:
    """``base`` with column name from each table (z, y, x, v); a missing voxel gets the given value (labels 0, masks 1)."""
    out = base
    for name, (df, default) in others.items():
        out = out.join(df.select(*KEY, F.col("v").alias(name)), list(KEY), "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


def merge_labels(df: DataFrame, classes: Mapping[str, int], ambiguous: str = "background", out: str = "label") -> DataFrame:
    """Binary arrays to one array of class ids: the largest class, or background where more than one is set."""
    cols = [F.col(c) * k for c, k in classes.items()]
    if ambiguous == "max":
        return df.withColumn(out, F.greatest(*cols) if len(cols) > 1 else cols[0])
    if ambiguous != "background":
        raise NotImplementedError(ambiguous)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    return df.withColumn(out, F.when(total > 1, 0).otherwise(reduce(lambda a, b: a + b, cols)))


def merge_masks(df: DataFrame, masks: Sequence[str], out: str = "mask") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a & b, [F.col(m) != 0 for m in masks]).cast("int"))


def merge_descriptors(dfs: Sequence[DataFrame], key: Sequence[str], ambiguous: str = "max") -> DataFrame:
    """Tables (key, c, v): the largest value of each channel, or their sum, 0 where more than one array is non-zero."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("__a", F.lit(k)) for k, d in enumerate(dfs)])
    if ambiguous == "max":
        return rows.groupBy(*key, "c").agg(F.max("v").alias("v"))
    arrays = rows.filter("v != 0").groupBy(*key).agg(F.countDistinct("__a").alias("__n"))
    sums = rows.groupBy(*key, "c").agg(F.sum("v").alias("v"))
    return sums.join(arrays, list(key), "left").select(*key, "c", F.when(F.col("__n") > 1, 0.0).otherwise(F.col("v")).alias("v"))


def softmax(df: DataFrame, key: Sequence[str] = KEY, out: str = "v") -> DataFrame:
    """Over the channels of each voxel: one shuffle gathers a voxel's few channels into an array."""
    rows = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("__a"))
    rows = rows.withColumn("__m", F.array_max(F.transform("__a", lambda s: s["v"])))
    rows = rows.withColumn("__t", F.aggregate("__a", F.lit(0.0), lambda acc, s: acc + F.exp(s["v"] - F.col("__m"))))
    rows = rows.select(*key, "__m", "__t", F.inline("__a"))
    return rows.select(*key, "c", (F.exp(F.col("v") - F.col("__m")) / F.col("__t")).alias(out))


def argmax_segment(df: DataFrame, key: Sequence[str] = KEY, mask: DataFrame | None = None, out: str = "seg") -> DataFrame:
    """The channel of the largest value, the lowest of equals; 0 outside the mask (key, mask)."""
    seg = df.groupBy(*key).agg((-F.max(F.struct(F.col("v"), (-F.col("c")).alias("n")))["n"]).alias(out))
    if mask is None:
        return seg
    on = F.when(F.coalesce(F.col("mask"), F.lit(0)) != 0, F.col(out)).otherwise(0)
    return seg.join(mask.select(*key, "mask"), list(key), "left").select(*key, on.alias(out))


ORGANELLES = {"mito": (3, 4), "golgi": (6, 7), "er": (16, 17), "np": (22, 23)}  # fixed values of the ground truth


def gt_to_labels(df: DataFrame, organelles: Mapping[str, Sequence[int]] = ORGANELLES, crop: str | None = None) -> DataFrame:
    """(crop, z, y, x, organelle, v = 255) for the ids of each organelle; crops without any give an all-zero background array."""
    spark = df.sparkSession
    ids = spark.createDataFrame([(o, i) for o, x in organelles.items() for i in x], "organelle string, __id long")
    keys = ([crop] if crop else []) + list(KEY)
    hit = df.join(F.broadcast(ids), F.col("gt") == F.col("__id")).select(*keys, "organelle", F.lit(255).alias("v"))
    if crop is None:
        return hit
    present = hit.select(crop).distinct()
    none = df.join(present, crop, "left_anti").select(*keys, F.lit("background").alias("organelle"), F.lit(0).alias("v"))
    return hit.unionByName(none)


def mask_from_gt(df: DataFrame, no_label: int) -> DataFrame:
    """Every second voxel of each axis; 0 where the id says that nothing is labelled, else 255."""
    from .resample import downsample

    return downsample(df, 2).select(*KEY, F.when(F.col("gt") == no_label, 0).otherwise(255).alias("mask"))


def compare_predictions(df: DataFrame, series: Sequence[str], iterations: Sequence[int], raw: DataFrame) -> DataFrame:
    """Predictions (series, iteration, z, y, x, v) beside raw: one column for each chosen series and iteration."""
    cols = [F.max(F.when((F.col("series") == s) & (F.col("iteration") == i), F.col("v"))).alias(f"{s}_{i:06d}") for s in series for i in iterations]
    chosen = df.filter(F.col("series").isin(list(series)) & F.col("iteration").isin(list(iterations)))
    return raw.join(chosen.groupBy(*KEY).agg(*cols), list(KEY), "left")
