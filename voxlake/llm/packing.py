"""Cost-balanced packing of encoded documents into sequences of bounded length.

A document's attention cost is estimated as LINEAR * n + n * n / SEQ. Each task packs
blocks of the rows that it reads, so nothing shuffles: documents go in descending order
of length to the sequence of the lowest cost that has room for them. Whole multiples of
``seq`` are cut off into sequences of their own first, and a piece that fits nowhere is
cut over the roomiest sequences. A block opens ceil(ids / seq) sequences, so it wastes
less than one of them; the room left at the end is moved into one sequence and that
sequence is split at powers of two, which need no padding.

Null and empty texts hold only the end id; rows that repeat an id are packed each on its
own; an empty table gives no piece; ties go by order in the block; a very long text is cut into sequences, its ids held whole in one task. Columns other than id
and text are ignored. A retried task reads the same rows and packs them alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoded_batches

LINEAR = 1.0
BLOCK_DOCS = 4096
BLOCK_IDS = 1 << 22
SCHEMA = "{id} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cost(n: int, seq: int) -> float:
    return LINEAR * n + n * n / seq


def pack(lengths: list[int], seq: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; the sequences are numbered from 0."""
    pieces, n_seq = [], 0
    rest = []
    for k, n in enumerate(lengths):
        whole = n // seq
        pieces += [(k, i * seq, seq, n_seq + i, 0) for i in range(whole)]
        n_seq += whole
        if n % seq:
            rest.append((n % seq, k, whole * seq))
    total = sum(n for n, _, _ in rest)
    n_open = -(-total // seq)
    if not n_open:
        return pieces
    costs, room = np.zeros(n_open), np.full(n_open, seq)
    held: list[list[list[int]]] = [[] for _ in range(n_open)]  # [document, start, length]

    def put(b: int, k: int, start: int, n: int) -> None:
        held[b].append([k, start, n])
        costs[b] += cost(n, seq)
        room[b] -= n

    for n, k, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = np.where(room >= n, costs, np.inf)
        b = int(fits.argmin())
        if np.isfinite(fits[b]):
            put(b, k, start, n)
            continue
        while n:
            b = int(room.argmax())
            m = min(n, int(room[b]))
            put(b, k, start, m)
            start, n = start + m, n - m
    # all room, which is less than one sequence, into the roomiest: it holds more ids than the others miss
    last = int(room.argmax())
    for b in np.flatnonzero(room):
        while b != last and room[b]:
            k, start, n = held[last].pop()
            m = min(n, int(room[b]))
            if m < n:
                held[last].append([k, start, n - m])
            room[last] += m
            put(int(b), k, start + n - m, m)
    for b in range(n_open):
        if room[b] == 0:
            at = 0
            for k, start, n in held[b]:
                pieces.append((k, start, n, n_seq, at))
                at += n
            n_seq += 1
    for b in np.flatnonzero(room):
        queue = [list(x) for x in held[b]]
        left = sum(x[2] for x in queue)
        while left:
            target = 1 << (left.bit_length() - 1)
            left, at = left - target, 0
            while at < target:
                k, start, n = queue[0]
                m = min(n, target - at)
                pieces.append((k, start, m, n_seq, at))
                at += m
                queue[0] = [k, start + m, n - m]
                if n == m:
                    queue.pop(0)
            n_seq += 1
    return pieces


def packed(docs: DataFrame, tokenizer: str, end_id: int, seq: int = 1024, text: str = "text", id_col: str = "doc_id", added: bool = False) -> DataFrame:
    """Pieces of all documents. sequence_id is the task's number times 2**40 plus a running number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        keys, ids, held, n_seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal n_seq
            got = pack([len(x) // 4 for x in ids], seq)
            cols = list(zip(*got, strict=True))
            at = [(d, 4 * s, 4 * (s + n)) for d, s, n, _, _ in got]
            crc = [zlib.crc32(ids[d][a:b]) for d, a, b in at]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in cols[0]], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([len(ids[d]) // 4 for d in cols[0]], pa.int64()), pa.array([base + n_seq + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()),
                ],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            n_seq += max(cols[3]) + 1
            return out

        kind = None
        for part, got in encoded_batches(batches, text, tokenizer, added):
            kind = part.schema.field(id_col).type
            for k, x in zip(part.column(id_col).to_pylist(), got, strict=True):
                keys.append(k)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if ids:
            yield flush()

    return docs.select(id_col, text).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", kind=dict(docs.dtypes)[id_col]))
