"""Chunked arrays in a folder: <array>/.zarray and .zattrs (JSON) and one file a chunk, raw or zlib."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import uri
from ..operators import blocks as B
from ..operators.roi import Vec

ZARRAY = "shape array<bigint>, chunks array<bigint>, dtype string, compressor struct<id:string,level:int>, fill_value double, dimension_separator string"
ZATTRS = "offset array<double>, resolution array<double>"
DTYPES = {"|u1": "uint8", "<u2": "uint16", "<u4": "uint32", "<u8": "uint64", "|i1": "int8", "<i2": "int16", "<i4": "int32", "<i8": "int64", "<f4": "float32", "<f8": "float64", "|b1": "bool"}


def split_path(path: Column) -> tuple[Column, Column]:
    """Container and array of a path such as .../name.zarr/volumes/raw."""
    return F.regexp_extract(path, r"^(.*\.(?:zarr|n5))/", 1), F.regexp_extract(path, r"^.*?\.(?:zarr|n5)/(.*)$", 1)


def _metadata(spark: SparkSession, root: str) -> list[tuple[str, str, str | None]]:
    """(array, .zarray, .zattrs) below ``root`` by Hadoop's file system: Spark's readers skip files whose name begins with a dot.

    A folder that is an array isn't listed, so the number of its chunks doesn't matter.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def text(folder, name: str) -> str | None:
        file = path(folder, name)
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    found, todo = [], [(top, "")]
    while todo:
        folder, name = todo.pop()
        array = text(folder, ".zarray")
        if array is not None:
            found.append((name, array, text(folder, ".zattrs")))
            continue
        for status in fs.listStatus(folder):
            if status.isDirectory():
                child = status.getPath()
                todo.append((child, f"{name}/{child.getName()}".lstrip("/")))
    return sorted(found)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(array, shape_vox, chunk, dtype, compressor, separator, fill, offset_nm, voxel_size_nm) of every array below ``root``."""
    rows = spark.createDataFrame(_metadata(spark, root), "array string, a string, t string")
    rows = rows.select("array", F.from_json("a", ZARRAY).alias("a"), F.from_json("t", ZATTRS).alias("t"))
    return rows.select(
        "array", F.col("a.shape").alias("shape_vox"), F.col("a.chunks").alias("chunk"), F.element_at(F.create_map(*[F.lit(x) for kv in DTYPES.items() for x in kv]), F.col("a.dtype")).alias("dtype"),
        F.col("a.compressor.id").alias("compressor"), F.coalesce("a.dimension_separator", F.lit(".")).alias("separator"), F.coalesce("a.fill_value", F.lit(0.0)).alias("fill"),
        F.col("t.offset").alias("offset_nm"), F.col("t.resolution").alias("voxel_size_nm"),
    )


def read_blocks(spark: SparkSession, root: str, array: str, spec: dict, box: tuple[Vec, Vec] | None = None) -> DataFrame:
    """Blocks of one array (``spec``: its row of the catalog as a dict); chunk files that are missing are simply absent.

    With ``box`` (in the array's voxels) only files of chunks that meet it are listed for reading; edge chunks lose their filling.
    """
    shape, chunk, dtype, packed = spec["shape_vox"], spec["chunk"], spec["dtype"], spec["compressor"]
    if packed not in (None, "zlib"):
        raise ValueError(f"compressor {packed}")

    def decode(row) -> Iterator[tuple]:
        c = [int(row.cz), int(row.cy), int(row.cx)]
        data = zlib.decompress(row.content) if packed else row.content
        a = np.frombuffer(data, np.dtype(dtype).newbyteorder("<")).reshape(chunk)
        size = [min(k, n - i * k) for k, n, i in zip(chunk, shape, c, strict=True)]
        yield B._row(c, [i * k for i, k in zip(c, chunk, strict=True)], a[tuple(slice(s) for s in size)], dtype)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    folder = f"{root}/{array}"
    if box is not None:
        names = ["{" + ",".join(map(str, range(max(0, o // k), min(-(-n // k) - 1, (o + s - 1) // k) + 1))) + "}" for o, s, k, n in zip(*box, chunk, shape, strict=True)]
        if spec.get("separator") == "/":
            folder = f"{folder}/{names[0]}/{names[1]}"
            files = files.option("pathGlobFilter", names[2])
        else:
            files = files.option("pathGlobFilter", ".".join(names))
    try:
        files = files.load(folder)
    except AnalysisException as e:
        if box is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], B.SCHEMA)  # no chunk of these rows is there
    number = [F.regexp_extract("path", r"/(\d+)[./](\d+)[./](\d+)$", k) for k in (1, 2, 3)]
    files = files.select("content", *[n.alias(a) for n, a in zip(number, B.CHUNK, strict=True)]).filter("cz != ''")
    files = files.select("content", *[F.col(a).cast("long").alias(a) for a in B.CHUNK])
    return files.mapInPandas(B.rows_of(decode, B.COLUMNS), B.SCHEMA)


def fill_missing(blocks: DataFrame, shape: Vec, chunk: Vec, dtype: str, fill: float = 0) -> DataFrame:
    """Add constant blocks where chunks are absent."""
    from ..operators.roi import tile

    there = blocks.select(*B.CHUNK)
    lack = tile(blocks.sparkSession, (0, 0, 0), shape, chunk).join(there, B.CHUNK, "left_anti").select(*B.CHUNK, *B.BOX)

    def make(r) -> Iterator[tuple]:
        yield B._row((r.cz, r.cy, r.cx), (r.oz, r.oy, r.ox), np.full((r.sz, r.sy, r.sx), fill, dtype), dtype)

    return blocks.select(B.COLUMNS).unionByName(lack.mapInPandas(B.rows_of(make, B.COLUMNS), B.SCHEMA))


def _store(root: str):
    """The file system of a URI and the path in it; every task opens its own."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))


def export_blocks(blocks: DataFrame, root: str, array: str, shape: Vec, chunk: Vec, dtype: str, offset_nm: Sequence[float] = (0, 0, 0), resolution: Sequence[float] = (1, 1, 1), level: int = 3) -> None:
    """Write chunk files (zlib) and their metadata below ``root``, in a store that Spark and pyarrow open (file, hdfs, s3, gs).

    Each file is written under another name and renamed, so a task that is run again leaves no half of a chunk.
    """
    root = uri(blocks.sparkSession, root)
    store, top = _store(root)
    folder = f"{top}/{array}"

    def put(rows) -> None:
        import uuid

        own, _ = _store(root)
        for row in rows:
            a = np.zeros(chunk, dtype)
            part = B.array_of(row)
            a[tuple(slice(s) for s in part.shape)] = part
            name = f"{folder}/{row.cz}.{row.cy}.{row.cx}"
            other = f"{folder}/.{uuid.uuid4().hex}"
            with own.open_output_stream(other) as f:
                f.write(zlib.compress(B.bytes_of(a), level))
            own.move(other, name)

    code = next(k for k, v in DTYPES.items() if v == dtype)
    spec = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": code, "compressor": {"id": "zlib", "level": level}, "fill_value": 0, "order": "C", "filters": None}
    store.create_dir(folder, recursive=True)
    for name, text in ((".zarray", spec), (".zattrs", {"offset": list(offset_nm), "resolution": list(resolution)})):
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(json.dumps(text).encode())
    blocks.select(B.COLUMNS).foreachPartition(put)


def write_arrays(blocks: DataFrame, path: str, dataset: str) -> DataFrame:
    """Write blocks with a column array as the partitions (dataset, array) of a Parquet table and return them reread. No shuffle."""
    out = blocks.select(*B.COLUMNS, F.lit(dataset).alias("dataset"), "array")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "array").parquet(path)
    return blocks.sparkSession.read.parquet(path).filter(F.col("dataset") == dataset).select("array", *B.COLUMNS)


def write_blocks(blocks: DataFrame, path: str, dataset: str, array: str, box: tuple[Vec, Vec] | None = None, dtype: str | None = None) -> int:
    """Write the parts of blocks inside ``box`` into the array of a Parquet table; returns the number of chunks that got values.

    What earlier writes left outside the box stays (``arrays.update_blocks``, and ``arrays.read_array`` to read); blocks
    outside are skipped; of blocks that overlap the one that begins last wins; another dtype casts at the first write, which fixes it.
    """
    from .arrays import update_blocks

    return update_blocks(blocks, path, dataset, array, box, dtype=dtype)


def empty_blocks(spark: SparkSession, shape: Vec, chunk: Vec, dtype: str, fill: float = 0) -> DataFrame:
    """A constant array of a shape as blocks."""
    return fill_missing(spark.createDataFrame([], B.SCHEMA), shape, chunk, dtype, fill)


def chunk_numbers(shape: Vec, chunk: Vec) -> list[tuple[int, ...]]:
    return list(product(*[range(-(-n // k)) for n, k in zip(shape, chunk, strict=True)]))


def import_volumes(volumes: dict[str, DataFrame], pairs: Sequence[tuple[str, str]], keep_depth: bool = False, ny: int | None = None) -> DataFrame:
    """(array, z, y, x, v) of source arrays (z, y, x, v) under their target names: raw arrays to 8 bits, ground truth resampled and mirrored."""
    from ..operators.project import to_8bit
    from ..operators.resample import import_gt

    out = None
    for source, target in pairs:
        df = volumes[source]
        if "groundtruth" in source:
            height = ny if ny is not None else df.agg(F.max("y")).first()[0] + 1
            df = import_gt(df, height)
        elif "raw" in source:
            df = to_8bit(df, "v", keep_depth)
        df = df.select(F.lit(target).alias("array"), *[F.col(a).cast("long").alias(a) for a in "zyx"], F.col("v").cast("long").alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


#: Sources of this cell line lie 10 voxels lower (fixed value).
LOWER, LOWER_BY = "jurkat", 10


def import_attributes(specs: DataFrame, pairs: Sequence[tuple[str, str]], raw_y: int, resolution: Vec) -> DataFrame:
    """(array, oz_nm, oy_nm, ox_nm, resolution) of the target arrays: ground truth lies where ``roi.import_offsets`` says, other arrays at 0.

    ``specs``: array, ix, iy, iz, dy of the sources; ``raw_y`` is the height of the raw array in voxels.
    """
    from ..operators.roi import import_offsets

    names = specs.sparkSession.createDataFrame(list(pairs), "array string, target string")
    shift = F.when(F.col("array").contains(LOWER), LOWER_BY).otherwise(0)
    rows = import_offsets(specs.join(names, "array"), raw_y, resolution, shift)
    crop = F.col("array").contains("groundtruth")
    at = [F.when(crop, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("oz_nm", "oy_nm", "ox_nm")]
    return rows.select(F.col("target").alias("array"), *at, F.array(*[F.lit(int(r)) for r in resolution]).alias("resolution"))


def crop_targets(paths: Sequence[str], prefix: str, suffix: str, target: str) -> list[tuple[str, str]]:
    """(source, target) of crops: names between ``prefix`` and ``suffix`` go below ``target``."""
    import re

    pattern = re.compile(rf"{re.escape(prefix)}/([^/]+)/{re.escape(suffix)}$")
    return [(p, f"{target}/{m[1]}") for p in sorted(paths) if (m := pattern.search(p))]
