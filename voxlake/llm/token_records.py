"""Token ids in length-delimited binary files with an offset index.

File format: records one after another, each
    u32  length of the payload
    u32  masked CRC of those four bytes
    payload: u8 flags (1: ids of 4 bytes, 2: no document id), i64 document id, u32 number of ids, ids of 2 or 4 bytes
    u32  masked CRC of the payload
    0x0A
all little-endian; masked CRC = rotate the CRC-32 right by 15 bits and add 0xA282EAD8,
so that a checksum over bytes that hold checksums stays sound. The files are written by
Spark's own writer and committer: a lost task is written again and leaves no part behind.

Records are in ascending (id, hash of the text) order over the files as sorted by their part number.
Records are handed to the writer in rows of FILE_BYTES / FILE_ROWS bytes at most, and a file gets FILE_ROWS of
them, so it takes no more than FILE_BYTES however many documents a task holds (a record longer than a row
is a row by itself). A task that reads files back needs memory for one file at a time, and a list of one file's
records is bounded too. Rows that share an id are dealt by the hash.

Null texts hold only the end id; a null id comes first and is read back as null; rows that
repeat an id each have a record; an empty table gives no record; a very long text is one record,
of at most 2**32 - 1 bytes. Ids are integers of 64 bits, as the format has them; others are an error. Columns other than id and text are not written, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scratch import delete
from .tokens import encoded_batches

HEAD, BODY, CRC = struct.Struct("<II"), struct.Struct("<BqI"), struct.Struct("<I")
WIDE, NO_ID = 1, 2
FILE_BYTES, FILE_ROWS = 1 << 26, 64
INDEX = "file string, ordinal bigint, byte_offset bigint, byte_length bigint, doc_id bigint, n_tokens bigint"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = WIDE * wide | NO_ID * (doc_id is None)
    payload = BODY.pack(flags, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = CRC.pack(len(payload))
    return size + CRC.pack(masked_crc(size)) + payload + CRC.pack(masked_crc(payload)) + b"\n"


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids as u32, offset of the next record); ValueError if a checksum is wrong."""
    size, crc = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 4]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + 8 : at + 8 + size]
    if len(payload) < size or CRC.unpack_from(data, at + 8 + size)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {at}")
    flags, doc_id, n = BODY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", n, BODY.size).astype("<u4")
    return None if flags & NO_ID else doc_id, ids, at + size + 13


def walk(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, document id, ids) of every record of a file."""
    at = 0
    while at < len(data):
        doc_id, ids, after = unframe(data, at)
        yield at, after - at, doc_id, ids
        at = after


def write_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, text: str = "text", id_col: str = "doc_id", added: bool = False, file_bytes: int = FILE_BYTES
) -> None:
    """Encode and write all documents. One shuffle: texts are dealt by ranges of (id, hash of the text) and sorted there."""

    most = file_bytes // FILE_ROWS

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole records, joined up to ``most`` bytes; a longer record is a row of its own."""
        end = b"" if end_id is None else struct.pack("<I", end_id)
        group, size = [], 0
        for part, ids in encoded_batches(batches, text, tokenizer, added):
            full = []
            for k, x in zip(part.column(id_col).to_pylist(), ids, strict=True):
                record = frame(k, np.frombuffer(x + end, "<u4"))
                if size + len(record) > most and group:
                    full.append(b"".join(group)[:-1])
                    group, size = [], 0
                group.append(record)
                size += len(record)
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], ["r"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(group)[:-1]], pa.binary())], ["r"])

    # the text writer copies the bytes of each row as they are and adds the line feed that ends a record
    place = [F.col(id_col), F.xxhash64(F.col(text))]
    dealt = docs.select(id_col, text).repartitionByRange(*place).sortWithinPartitions(*place)
    out = dealt.mapInArrow(records, "r binary").select(F.col("r").cast("string"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read all records and verify their checksums: the columns of INDEX and ids_crc32 of the ids as u32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, k, at, n, d, len(ids), zlib.crc32(ids.tobytes())) for k, (at, n, d, ids) in enumerate(walk(data.as_py()))]
                if rows:
                    kinds = [pa.string(), *[pa.int64()] * 6]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["file", "ordinal", "byte_offset", "byte_length", "doc_id", "n_tokens", "ids_crc32"],
                    )

    return _files(spark, path).mapInArrow(read, INDEX + ", ids_crc32 bigint")


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The offset index of the files in ``path`` as Parquet: INDEX, ids_crc32 and start (ids of all records before)."""
    tmp = index.rstrip("/") + "-parts"
    scan(spark, path).write.parquet(tmp)
    rows = spark.read.parquet(tmp)
    number = F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long")
    # up to the dot of the ending: the id of the job, before it, may hold -c and digits too
    piece = F.regexp_extract("file", r"-c(\d+)(?:\.[^/]*)?$", 1).cast("long")
    # one row for each file, of which there are no more than Spark had write tasks
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("t")).select("file", "t", number.alias("p"), piece.alias("c"))
    order = W.Window.orderBy("p", "c").rowsBetween(W.Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("t").over(order), F.lit(0)).cast("long").alias("base"))
    before = W.Window.partitionBy("file").orderBy("ordinal").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    rows.withColumn("start", inside).join(base, "file").withColumn("start", (F.col("start") + F.col("base")).cast("long")).drop(
        "base"
    ).write.parquet(index)
    delete(spark, tmp)


def read_shuffled(spark: SparkSession, path: str, index: str, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in an order drawn by ``seed``: each file meets the offsets that the index has for it, and only those places are read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, spots in zip(batch.column("content"), batch.column("spots").to_pylist(), strict=True):
                whole = data.as_py()
                got = [(s["draw"], *unframe(whole, s["byte_offset"])[:2]) for s in spots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.int64()))],
                    ["draw", "doc_id", "ids"],
                )

    spots = spark.read.parquet(index).groupBy("file").agg(
        F.collect_list(F.struct(F.xxhash64(F.lit(seed), "file", "ordinal").alias("draw"), "byte_offset")).alias("spots")
    )
    found = _files(spark, path).join(spots, F.col("path") == F.col("file")).select("content", "spots")
    return found.mapInArrow(fetch, "draw bigint, doc_id bigint, ids array<bigint>").orderBy("draw").select("doc_id", "ids")
