"""Dataset configurations: a JSON object from nickname to file, box, voxel size, arrays and masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<file:string,offset:array<int>,shape:array<int>,voxel_size:array<int>,raw:string,labels:map<string,int>,mask:string,metric_masks:array<string>>"


def parse_configs(texts: DataFrame, prefix: str = "") -> DataFrame:
    """One row for each dataset of the JSON texts (column value): nickname in upper case, file below ``prefix``."""
    rows = texts.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("nickname", "c")).select(F.upper("nickname").alias("nickname"), "c.*")
    return rows.withColumn("file", F.concat(F.lit(prefix.rstrip("/") + "/" if prefix else ""), F.col("file")))


def read_configs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return parse_configs(spark.read.text(path, wholetext=True), prefix)


def labels_of(configs: DataFrame) -> DataFrame:
    """(nickname, label, class_id), one row for each label array."""
    return configs.select("nickname", F.explode("labels").alias("label", "class_id"))


def split_configs(configs: DataFrame) -> DataFrame:
    """Add number: the running index of each dataset in order of nickname."""
    from pyspark.sql.window import Window

    return configs.withColumn("number", (F.row_number().over(Window.orderBy("nickname")) - 1).cast("long"))


def union_configs(configs: Sequence[DataFrame]) -> DataFrame:
    """All datasets; ValueError if a nickname occurs more than once."""
    rows = reduce(DataFrame.unionByName, configs)
    twice = duplicates(rows).limit(1).collect()
    if twice:
        raise ValueError(f"nickname {twice[0].nickname} occurs {twice[0].n} times")
    return rows


def duplicates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("nickname").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def configs_from_catalog(spec: DataFrame, organelles: Mapping[str, int], with_metric_mask: Sequence[str] = ("mito", "er", "golgi")) -> DataFrame:
    """(organelle, json) of crops in a catalog (crop, organelle, array, shape_vox, offset_nm, voxel_size_nm): offsets in whole voxels."""
    ids = F.create_map(*[F.lit(x) for kv in organelles.items() for x in kv])
    offset = F.zip_with("offset_nm", "voxel_size_nm", lambda o, s: (o / s).cast("int"))
    metric = F.when(F.col("organelle").isin(list(with_metric_mask)), F.array(F.concat(F.lit("volumes/metric_masks/"), F.col("organelle"))))
    entry = F.struct(
        F.col("file"), offset.alias("offset"), F.transform("shape_vox", lambda v: v.cast("int")).alias("shape"), F.transform("voxel_size_nm", lambda v: v.cast("int")).alias("voxel_size"),
        F.lit("volumes/raw").alias("raw"), F.create_map("array", F.element_at(ids, F.col("organelle"))).alias("labels"), metric.alias("metric_masks"),
    )
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    rows = spec.filter(F.col("organelle").isin(list(organelles))).select("organelle", F.struct(F.concat_ws("_", "crop", "organelle").alias("key"), entry.alias("value")).alias("e"))
    return rows.groupBy("organelle").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e"), by_key))).alias("json"))
