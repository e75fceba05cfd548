"""Image sections of a volume: scanning, checks, stacking into blocks, and back to planes."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import uri
from ..operators import blocks as B
from ..operators.roi import Vec
from .chunks import _store

NUMBERED = r".*_(\d+).*\.tif$"


def numbered(names: DataFrame, regex: str = NUMBERED) -> DataFrame:
    """(name, number) of the names that match; ordered use goes by the number, not by the name."""
    return names.filter(F.col("name").rlike(regex)).select("name", F.regexp_extract("name", regex, 1).cast("long").alias("number"))


def numbering(sections: DataFrame) -> DataFrame:
    """One row: first, last, n and whether the numbers run without a gap or repeat."""
    out = sections.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("d"))
    return out.select("first", "last", "n", ((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("d") == F.col("n"))).alias("contiguous"))


def scan_sections(spark: SparkSession, folder: str, regex: str = NUMBERED) -> DataFrame:
    """(path, number, height, width, mode, data) of the section images; ValueError if their numbers have a gap."""
    images = spark.read.format("image").load(folder).select("image.*")
    rows = images.withColumn("name", F.regexp_extract("origin", r"([^/]+)$", 1)).filter(F.col("name").rlike(regex))
    rows = rows.select(F.col("origin").alias("path"), F.regexp_extract("name", regex, 1).cast("long").alias("number"), "height", "width", "nChannels", "mode", "data")
    check = numbering(rows).first()
    if check.n and not check.contiguous:
        raise ValueError(f"sections {check.first}..{check.last} are {check.n}")
    return rows


def verify_sections(images: DataFrame) -> DataFrame:
    """Paths of the images that cannot be read."""
    return images.filter(F.col("height") == -1).select("path")


def sections_to_blocks(sections: DataFrame, offset: Vec, shape: Vec, chunk: Vec, invert: bool = False, dtype: str = "uint8") -> DataFrame:
    """Blocks of a box of the stack: z counts from the first section. Every section is cut into tiles where it is read.

    A group is one block, so its size is bounded by the chunk. The box must fit the stack.
    """
    size = sections.agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.min("height").alias("h"), F.min("width").alias("w")).first()
    have = (size.n, size.h, size.w)
    if any(o < 0 or o + s > n for o, s, n in zip(offset, shape, have, strict=True)):
        raise ValueError(f"box {offset} {shape} does not fit {have}")
    if invert and np.dtype(dtype).itemsize > 1:
        raise ValueError("inversion needs 8 bits")
    first = size.first

    def tiles(r) -> Iterator[tuple]:
        z = int(r.number) - first - offset[0]
        if not 0 <= z < shape[0]:
            return
        a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., 0]
        a = a[offset[1] : offset[1] + shape[1], offset[2] : offset[2] + shape[2]].astype(dtype)
        a = 255 - a if invert else a
        for cy in range(-(-shape[1] // chunk[1])):
            for cx in range(-(-shape[2] // chunk[2])):
                part = a[cy * chunk[1] : (cy + 1) * chunk[1], cx * chunk[2] : (cx + 1) * chunk[2]]
                yield B._row((z // chunk[0], cy, cx), (z, cy * chunk[1], cx * chunk[2]), part[None], dtype)

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(), key=lambda r: r.oz)
        c = (rows[0].cz, rows[0].cy, rows[0].cx)
        return pd.DataFrame([B._row(c, (c[0] * chunk[0], rows[0].oy, rows[0].ox), np.concatenate([B.array_of(r) for r in rows]), dtype)], columns=B.COLUMNS)

    cut = sections.select("number", "height", "width", "data").mapInPandas(B.rows_of(tiles, B.COLUMNS), B.SCHEMA)
    return cut.groupBy(*B.CHUNK).applyInPandas(stack, B.SCHEMA)


STRIP = "z long, y long, height long, width long, data binary"


def blocks_to_strips(blocks: DataFrame) -> tuple[DataFrame, Vec]:
    """(strips, shape): strips (z, y, height, width, data), each a plane's rows from one layer of chunks as uint8, places from the array's first.

    A group is one strip, so its size is bounded by a chunk's height times the width of a plane. Absent chunks are 0; strips that meet no chunk are absent.
    """
    ends = blocks.agg(*[F.min(f"o{a}").alias(f"o{a}") for a in "zyx"], *[F.max(F.col(f"o{a}") + F.col(f"s{a}")).alias(f"e{a}") for a in "zyx"]).first()
    lo = [ends[f"o{a}"] for a in "zyx"]
    if lo[0] is None:
        return blocks.sparkSession.createDataFrame([], STRIP), (0, 0, 0)
    size = tuple(ends[f"e{a}"] - o for a, o in zip("zyx", lo, strict=True))

    def planes(r) -> Iterator[tuple]:
        a = B.array_of(r)
        for k in range(a.shape[0]):
            yield r.oz + k - lo[0], r.oy - lo[1], r.ox - lo[2], *a.shape[1:], B.bytes_of(a[k].astype(np.uint8))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["h"].max()), size[2]), np.uint8)
        for r in pdf.itertuples():
            a[: r.h, r.x : r.x + r.w] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
        return pd.DataFrame([(int(pdf["z"].iloc[0]), int(pdf["y"].iloc[0]), *a.shape, B.bytes_of(a))], columns=["z", "y", "height", "width", "data"])

    cut = blocks.select(B.COLUMNS).mapInPandas(B.rows_of(planes, ["z", "y", "x", "h", "w", "data"]), "z long, y long, x long, h long, w long, data binary")
    return cut.groupBy("z", "y").applyInPandas(join, STRIP), size


def blocks_to_sections(blocks: DataFrame) -> DataFrame:
    """(name, z, height, width, data): one plane a row, z from the array's first. For planes that fit a row; ``export_sections`` writes any."""
    strips, (_, height, width) = blocks_to_strips(blocks)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width), np.uint8)
        for r in pdf.itertuples():
            a[r.y : r.y + r.height] = np.frombuffer(r.data, np.uint8).reshape(r.height, width)
        z = int(pdf["z"].iloc[0])
        return pd.DataFrame([(f"section_{z:04d}", z, height, width, B.bytes_of(a))], columns=["name", "z", "height", "width", "data"])

    return strips.groupBy("z").applyInPandas(join, "name string, z long, height long, width long, data binary")


def export_sections(blocks: DataFrame, folder: str) -> int:
    """Write section_<z>.tif for every z of the array's extent, 8-bit grey, z from the array's first, and return their number.

    A file's task takes the plane's strips in order and holds one at a time, however large the plane (a plane of 4 GB is an error, as
    the format counts in 32 bits). A file is written under another name and renamed, so a task that is run again leaves no half of one. An array without a block gives no file.
    """
    strips, (depth, height, width) = blocks_to_strips(blocks)
    if not depth:
        return 0
    body = height * width + height * width % 2
    if 8 + body + 4096 >= 1 << 32:
        raise ValueError(f"a plane of {height} x {width} is too large for one image")
    spark = blocks.sparkSession
    root = uri(spark, folder)
    store, top = _store(root)
    store.create_dir(top, recursive=True)

    def finish(own, f, name: str, other: str, at: int) -> None:
        _zeros(f, body - at)  # rows below the last chunk, and to an even place
        f.write(_directory(height, width))
        f.close()
        own.move(other, name)

    def put(rows) -> None:
        own, _ = _store(root)
        z = f = None
        for row in rows:  # by z, then y; each z begins with a row without data
            if row.z != z:
                if f is not None:
                    finish(own, f, name, other, at)
                z, at, name, other = row.z, 0, f"{top}/section_{row.z:04d}.tif", f"{top}/.{uuid.uuid4().hex}"
                f = own.open_output_stream(other)
                f.write(struct.pack("<2sHI", b"II", 42, 8 + body))
            if row.data is not None:
                _zeros(f, row.y * width - at)
                f.write(row.data)
                at = (row.y + row.height) * width
        if f is not None:
            finish(own, f, name, other, at)

    first = spark.range(depth).selectExpr("id AS z", "-1L AS y", "0L AS height", f"{width}L AS width", "CAST(NULL AS BINARY) AS data")
    strips.unionByName(first).repartition("z").sortWithinPartitions("z", "y").foreachPartition(put)
    return depth


def spoil(names: DataFrame, folder: str) -> None:
    """Overwrite the files ``names`` (name) of a folder with what is no image: what a broken transfer leaves, for tests of ``verify_sections``."""
    root = uri(names.sparkSession, folder)

    def put(rows) -> None:
        own, top = _store(root)
        for row in rows:
            with own.open_output_stream(f"{top}/{row.name}") as f:
                f.write(b"broken")

    names.foreachPartition(put)


FILL = 1 << 20


def _zeros(f, n: int) -> None:
    for k in range(0, n, FILL):
        f.write(bytes(min(FILL, n - k)))


def _directory(height: int, width: int) -> bytes:
    """The tags of an 8-bit grey image without compression, its rows from byte 8 on as one strip (fixed values of the format)."""
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, height * width)]
    return struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags) + bytes(4)


def differing_boxes(specs: DataFrame) -> DataFrame:
    """One row: whether the listed arrays (offset, shape) differ."""
    return specs.agg((F.countDistinct("offset", "shape") > 1).alias("differ"))
