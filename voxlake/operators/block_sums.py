"""Summed-area tables and mean or label pyramids over blocks.

Summed-area table: a chunk sums inside itself; what lies before it is carried to it along each axis: faces of the chunks before it on one
axis, edges of those before on two, a number for those before on all three. A carry is a running sum along lines of chunks, streamed in a
task that holds one face; what shuffles is faces, edges and numbers and, once, the chunks.

Pyramid: a chunk is reduced where it is, the reduced children of a parent meet once a level, and every level is written before the
next one reads it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from . import blocks as B
from .roi import AXES, Vec

_CARRY = "cz long, cy long, cx long, along string, data binary"
#: What is carried: the axes on which the chunks lie before.
BEFORE = ["".join(c) for n in (1, 2, 3) for c in combinations(AXES, n)]


def _rims(blocks: DataFrame) -> DataFrame:
    """(chunk, along, data): for each set of axes the chunk's sums at its end on them, as int64."""

    def ends(r) -> Iterator[tuple]:
        sums = local_sums(B.array_of(r))
        for along in BEFORE:
            part = sums[tuple(-1 if a in along else slice(None) for a in AXES)]
            yield r.cz, r.cy, r.cx, along, np.asarray(part, "<i8").tobytes()

    return blocks.select(B.COLUMNS).mapInPandas(B.rows_of(ends, [*B.CHUNK, "along", "data"]), _CARRY)


def local_sums(a: np.ndarray) -> np.ndarray:
    out = (a > 0).astype(np.int64)
    for axis in range(3):
        np.cumsum(out, axis, out=out)
    return out


def _carried(rows: DataFrame, axis: str) -> DataFrame:
    """What lies before each chunk on lines along ``axis``: running sums that leave the chunk's own out."""
    step = f"c{axis}"
    line = [c for c in B.CHUNK if c != step]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                own = np.frombuffer(r.data, "<i8")
                here = (r.along, *[getattr(r, c) for c in line])
                if here != at:
                    at, total = here, np.zeros_like(own)
                out.append((r.cz, r.cy, r.cx, r.along, total.tobytes()))
                total = total + own
            yield pd.DataFrame(out, columns=[*B.CHUNK, "along", "data"])

    return rows.repartition("along", *line).sortWithinPartitions("along", *line, step).mapInPandas(run, _CARRY)


def integral_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (int64) of the number of voxels above 0 at or before each voxel on every axis. All chunks of the box must be there (``chunks.fill_missing``)."""
    rims = materialize(_rims(blocks), "sum-rims")
    parts = []
    for along in BEFORE:
        own = rims.filter(F.col("along") == along)
        for a in along:
            own = _carried(own, a)
        parts.append(own)
    carries = parts[0]
    for p in parts[1:]:
        carries = carries.unionByName(p)
    carries = materialize(carries.groupBy(*B.CHUNK).agg(F.collect_list(F.struct("along", "data")).alias("carries")), "sum-carries")  # seven a chunk
    discard(rims)

    def one(r) -> Iterator[tuple]:
        sums = local_sums(B.array_of(r))
        for c in r.carries:
            sums += np.frombuffer(c["data"], "<i8").reshape([1 if a in c["along"] else n for a, n in zip(AXES, sums.shape, strict=True)])
        yield B._row((r.cz, r.cy, r.cx), (r.oz, r.oy, r.ox), sums, "int64")

    return blocks.select(B.COLUMNS).join(carries, B.CHUNK).mapInPandas(B.rows_of(one, B.COLUMNS), B.SCHEMA)


def box_sums(boxes: DataFrame, table: DataFrame, box: tuple[Vec, Vec], chunk: Vec) -> DataFrame:
    """(id, total) of boxes (id, o*, s*; inside ``box``) from a summed-area table in blocks, looked up at 8 corners each.

    Corners and chunks meet by chunk number, the chunk first, and are answered as they stream by: a task holds one chunk, however many
    corners lie in it.
    """
    corners = []
    for up in range(8):
        ends = [(up >> 2) & 1, (up >> 1) & 1, up & 1]
        at = [(F.col(f"o{a}") + (F.col(f"s{a}") if e else 0) - 1).cast("long").alias(a) for a, e in zip(AXES, ends, strict=True)]
        corners.append(F.struct(*at, F.lit(1 if sum(ends) % 2 else -1).alias("sign")))
    spots = boxes.select(F.col("id").cast("long").alias("id"), F.inline(F.array(*corners)))
    for a, o in zip(AXES, box[0], strict=True):
        spots = spots.filter(F.col(a) >= o)
    number = [F.floor((F.col(a) - o) / k).cast("long").alias(c) for c, a, o, k in zip(B.CHUNK, AXES, box[0], chunk, strict=True)]
    nothing = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    asked = spots.select(*number, "id", *AXES, "sign", *nothing(*[(c, "long") for c in B.BOX], ("dtype", "string"), ("data", "binary")))
    held = table.select(*B.CHUNK, *nothing(("id", "long"), *[(a, "long") for a in AXES], ("sign", "int")), *B.BOX, "dtype", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums, lo = None, None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                here = (r.cz, r.cy, r.cx)
                if r.data is not None:
                    lo = [int(r.oz), int(r.oy), int(r.ox)]
                    sums = np.frombuffer(r.data, np.dtype(r.dtype).newbyteorder("<")).reshape(int(r.sz), int(r.sy), int(r.sx))
                    at = here
                elif here == at:
                    out.append((int(r.id), int(r.sign) * int(sums[int(r.z) - lo[0], int(r.y) - lo[1], int(r.x) - lo[2]])))
            yield pd.DataFrame(out, columns=["id", "n"])

    both = held.unionByName(asked).repartition(*B.CHUNK).sortWithinPartitions(*B.CHUNK, F.col("data").isNull())
    found = both.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("total"))
    return boxes.select(F.col("id").cast("long").alias("id")).join(found, "id", "left").select("id", F.coalesce("total", F.lit(0)).alias("total"))


def masked_ratio_blocks(boxes: DataFrame, table: DataFrame, box: tuple[Vec, Vec], chunk: Vec) -> DataFrame:
    """Add ratio: the share of each box's voxels that the table counts."""
    volume = F.col("sz") * F.col("sy") * F.col("sx")
    return boxes.join(box_sums(boxes, table, box, chunk), "id").withColumn("ratio", F.col("total") / volume).drop("total")


def reduce_block(a: np.ndarray, factor: Vec, kind: str) -> np.ndarray:
    """One chunk by cells of ``factor``: ``mean`` (what lies outside is 0; truncated for integers) or ``label`` (the voxel at factor // 2)."""
    short = [-n % f for n, f in zip(a.shape, factor, strict=True)]
    full = np.pad(a, [(0, s) for s in short])
    cells = full.reshape([k for n, f in zip(full.shape, factor, strict=True) for k in (n // f, f)])
    if kind == "label":
        return cells[:, factor[0] // 2, :, factor[1] // 2, :, factor[2] // 2]
    sums = cells.sum((1, 3, 5), dtype=np.float64 if a.dtype.kind == "f" else np.int64)
    n = factor[0] * factor[1] * factor[2]
    return (sums / n).astype(a.dtype) if a.dtype.kind == "f" else (np.sign(sums) * (np.abs(sums) // n)).astype(a.dtype)


def pyramid_blocks(blocks: DataFrame, box: tuple[Vec, Vec], chunk: Vec, scales: Sequence[int | Vec], kind: str) -> list[DataFrame]:
    """Levels of a pyramid, each a written table of blocks in the coordinates of its level, made from the one before.

    Chunks keep their shape, and a level has as many fewer; the box begins at a multiple of every factor, and chunks are
    multiples of it. A chunk that is absent is 0; a parent is there if one of its children is.
    """
    out, offset, shape = [], list(box[0]), list(box[1])
    for scale in scales:
        f = (scale,) * 3 if isinstance(scale, int) else tuple(scale)
        if any(k % g or o % g for k, o, g in zip(chunk, offset, f, strict=True)):
            raise ValueError(f"chunks of {chunk} from {offset} aren't multiples of {f}")
        offset, shape = [o // g for o, g in zip(offset, f, strict=True)], [-(-s // g) for s, g in zip(shape, f, strict=True)]
        blocks = materialize(_level(blocks, f, kind, (offset, shape), chunk), "pyramid-level")
        out.append(blocks)
    return out


def _level(blocks: DataFrame, f: Vec, kind: str, box: tuple[Vec, Vec], chunk: Vec) -> DataFrame:
    def reduce(r) -> Iterator[tuple]:
        small = reduce_block(B.array_of(r), f, kind)
        if small.size:
            yield B._row([c // g for c, g in zip((r.cz, r.cy, r.cx), f, strict=True)], [o // g for o, g in zip((r.oz, r.oy, r.ox), f, strict=True)], small, r.dtype)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        c = [int(pdf[k].iloc[0]) for k in B.CHUNK]
        lo = [o + i * k for o, i, k in zip(box[0], c, chunk, strict=True)]
        size = [min(k, o + n - b) for k, o, n, b in zip(chunk, *box, lo, strict=True)]
        a = np.zeros(size, pdf["dtype"].iloc[0])
        for r in pdf.itertuples():
            a[tuple(slice(o - b, o - b + s) for o, b, s in zip((r.oz, r.oy, r.ox), lo, (r.sz, r.sy, r.sx), strict=True))] = B.array_of(r)
        return pd.DataFrame([B._row(c, lo, a, r.dtype)], columns=B.COLUMNS)

    return blocks.select(B.COLUMNS).mapInPandas(B.rows_of(reduce, B.COLUMNS), B.SCHEMA).groupBy(*B.CHUNK).applyInPandas(join, B.SCHEMA)
