"""Chunked arrays as a data source of Spark: ``spark.read.format("chunks")`` and ``df.write.format("chunks")``.

Reading: partitions follow from the array's metadata, no folder is listed. Filters on cz, cy and cx are pushed down
(``spark.sql.python.filterPushdown.enabled``), so only chunks that they allow are opened. A chunk without a file is a block of the fill value, or is
left out with the option absent = skip. Options: path, array, chunks_per_task.

Writing: every task writes its chunks under other names and renames them. The metadata come last, when all
tasks are through; a new array whose write is aborted goes as a whole. Options: path, array, shape, chunk, dtype, offset, resolution
(numbers separated by commas), level. Stores: those that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..operators import blocks as B
from .chunks import DTYPES, _store


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)


def _numbers(text: str) -> list[int]:
    return [int(v) for v in text.split(",")]


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return B.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(dict(self.options), overwrite)


@dataclass
class Chunks(InputPartition):
    """Numbers first .. end - 1 of the chunks that are wanted, in order of z, y, x."""

    first: int
    end: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.array = options["path"], options["array"]
        self.skip = options.get("absent", "fill") == "skip"
        self.per_task = int(options.get("chunks_per_task", 64))
        store, top = _store(self.path)
        with store.open_input_stream(f"{top}/{self.array}/.zarray") as f:
            meta = json.loads(f.read())
        self.shape, self.chunk, self.dtype = meta["shape"], meta["chunks"], DTYPES[meta["dtype"]]
        packed = (meta.get("compressor") or {}).get("id")
        if packed not in (None, "zlib"):
            raise ValueError(f"compressor {packed}")
        self.packed, self.separator, self.fill = packed == "zlib", meta.get("dimension_separator", "."), meta.get("fill_value") or 0
        self.wanted = [range(-(-n // k)) for n, k in zip(self.shape, self.chunk, strict=True)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take conditions on chunk numbers; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in B.CHUNK or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) or f.value is None:
                yield f
                continue
            tests = {
                EqualTo: lambda n: n == f.value, GreaterThan: lambda n: n > f.value, GreaterThanOrEqual: lambda n: n >= f.value,  # noqa: B023
                LessThan: lambda n: n < f.value, LessThanOrEqual: lambda n: n <= f.value, In: lambda n: n in f.value,  # noqa: B023
            }
            axis = B.CHUNK.index(column)
            self.wanted[axis] = [n for n in self.wanted[axis] if tests[type(f)](n)]

    def partitions(self) -> list[Chunks]:
        n = len(self.wanted[0]) * len(self.wanted[1]) * len(self.wanted[2])
        return [Chunks(k, min(n, k + self.per_task)) for k in range(0, n, self.per_task)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[tuple]:
        store, top = _store(self.path)
        ny, nx = len(self.wanted[1]), len(self.wanted[2])
        for k in range(partition.first, partition.end):
            c = self.wanted[0][k // (ny * nx)], self.wanted[1][k // nx % ny], self.wanted[2][k % nx]
            size = [min(s, n - i * s) for s, n, i in zip(self.chunk, self.shape, c, strict=True)]
            try:
                with store.open_input_stream(f"{top}/{self.array}/{self.separator.join(map(str, c))}", compression=None) as f:
                    data = f.read()
            except FileNotFoundError:
                if self.skip:
                    continue
                a = np.full(size, self.fill, self.dtype)
            else:
                a = np.frombuffer(zlib.decompress(data) if self.packed else data, np.dtype(self.dtype).newbyteorder("<")).reshape(self.chunk)
                a = a[tuple(slice(s) for s in size)]
            yield B._row(c, [i * s for i, s in zip(c, self.chunk, strict=True)], a, self.dtype)


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ChunkWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.array = options["path"], options["array"]
        self.shape, self.chunk, self.dtype = _numbers(options["shape"]), _numbers(options["chunk"]), options["dtype"]
        self.level = int(options.get("level", 3))
        self.attributes = {"offset": [float(v) for v in options.get("offset", "0,0,0").split(",")], "resolution": [float(v) for v in options.get("resolution", "1,1,1").split(",")]}
        store, top = _store(self.path)
        self.folder = f"{top}/{self.array}"
        self.existed = store.get_file_info(f"{self.folder}/.zarray").is_file
        if self.existed and not overwrite:
            raise ValueError(f"array {self.array} is there; use mode overwrite to replace chunks of it")
        store.create_dir(self.folder, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        store, _ = _store(self.path)
        n = 0
        for row in rows:
            a = np.zeros(self.chunk, self.dtype)
            part = B.array_of(row)
            a[tuple(slice(s) for s in part.shape)] = part
            half = f"{self.folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(half) as f:
                f.write(zlib.compress(B.bytes_of(a), self.level))
            store.move(half, f"{self.folder}/{row.cz}.{row.cy}.{row.cx}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        code = next(k for k, v in DTYPES.items() if v == self.dtype)
        spec = {"zarr_format": 2, "shape": self.shape, "chunks": self.chunk, "dtype": code, "compressor": {"id": "zlib", "level": self.level}, "fill_value": 0, "order": "C", "filters": None}
        store, _ = _store(self.path)
        for name, text in ((".zattrs", self.attributes), (".zarray", spec)):
            half = f"{self.folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(half) as f:
                f.write(json.dumps(text).encode())
            store.move(half, f"{self.folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        if not self.existed:
            _store(self.path)[0].delete_dir(self.folder)
