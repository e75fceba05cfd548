"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all runs on one machine, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the reread table.

    The files outlive executors, so a lost executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return reread(spark, path, df.schema)


def reread(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table written at ``path``, which ``discard`` may delete."""
    table = spark.read.schema(schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` or ``reread`` returned, once nothing that is still to run reads them."""
    for table in tables:
        delete(table.sparkSession, _PATHS.pop(table))


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(path, its file system). Spark has no public calls for what is done with them, so Hadoop's own are used, on the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path`` in whichever store it lies."""
    target, store = _hadoop(spark, path)
    store.delete(target, True)


def uri(spark: SparkSession, path: str) -> str:
    """``path`` with its store; without one it lies in Spark's default store."""
    target, store = _hadoop(spark, path)
    return store.makeQualified(target).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if it isn't there."""
    target, store = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    target, store = _hadoop(spark, path)
    stream = store.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place by a rename; False if there is one by that name."""
    target, store = _hadoop(spark, path)
    if store.exists(target):
        return False
    half, _ = _hadoop(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = store.create(half, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not store.rename(half, target):
        store.delete(half, False)
        return False
    return True
