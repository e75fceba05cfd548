"""Stored arrays that are written box by box: an upsert of chunks with a manifest.

An array lies in <path>/dataset=<d>/array=<a>. Its first write fixes offset, shape, chunk and type. A write merges what it
brings with the chunks that its box touches and puts the whole chunks into a folder of its own (write=<n>-<uuid>); nothing else is
read or rewritten. When all tasks are through, the next manifest (_state/<n>.json: the layout, and number, folder and chunk range of every
write that still counts) is put in place by a rename, so readers see all of a write or nothing of it, and a write that
fails leaves the array as it was.

Every write holds all chunks of its range that have a value. A row is therefore outdated if a later write's range covers
its chunk: reading is a filter on chunk numbers, which Parquet's statistics prune by, without a join or a
shuffle; block-wise jobs whose boxes don't share chunks need no condition at all. ``compact`` rewrites an array as one write.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from itertools import product
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..operators import blocks as B
from ..operators.roi import Vec

Range = tuple[tuple[int, ...], tuple[int, ...]]


@dataclass
class Layout:
    """What the first write fixes."""

    offset: Sequence[int]
    shape: Sequence[int]
    chunk: Sequence[int]
    dtype: str
    fill: float = 0


@dataclass
class State:
    """A manifest: ``writes`` are (number, folder, first chunk, chunk after the last) in the order they were made."""

    layout: Layout
    last: int = 0
    writes: list[tuple[int, str, list[int], list[int]]] = field(default_factory=list)


class ConcurrentWrite(RuntimeError):
    """Another write of the same array was committed in between; the array is as that one left it."""


def folder(path: str, dataset: str, array: str) -> str:
    return f"{path.rstrip('/')}/dataset={quote(dataset, safe='')}/array={quote(array, safe='')}"


def state(spark: SparkSession, path: str, dataset: str, array: str) -> State | None:
    """The newest manifest, None for an array that was never written."""
    names = [n for n in scratch.names(spark, f"{folder(path, dataset, array)}/_state") if n.endswith(".json")]
    if not names:
        return None
    got = json.loads(scratch.read_text(spark, f"{folder(path, dataset, array)}/_state/{max(names)}"))
    return State(Layout(**got["layout"]), got["last"], [tuple(w) for w in got["writes"]])


def _new_folder(number: int) -> str:
    """Two writers that take one number don't meet in a folder."""
    return f"write={number:010d}-{uuid.uuid4().hex}"


def _commit(spark: SparkSession, where: str, new: State) -> None:
    """Put a manifest in place; its newest write goes if another one came first."""
    if not scratch.put_text(spark, f"{where}/_state/{new.last:010d}.json", json.dumps(asdict(new))):
        scratch.delete(spark, f"{where}/{new.writes[-1][1]}")
        raise ConcurrentWrite(where)


def _meets(a: Sequence, b: Sequence) -> bool:
    return all(max(p, r) < min(q, s) for p, q, r, s in zip(a[0], a[1], b[0], b[1], strict=True))


def _inside(lo: Sequence[int], hi: Sequence[int]) -> Column:
    cond = F.lit(True)
    for c, a, b in zip(B.CHUNK, lo, hi, strict=True):
        cond = cond & (F.col(c) >= a) & (F.col(c) < b)
    return cond


def _chunks(layout: Layout, box: tuple[Vec, Vec]) -> Range:
    lo = tuple((o - a) // k for o, a, k in zip(box[0], layout.offset, layout.chunk, strict=True))
    return lo, tuple(-(-(o + s - a) // k) for o, s, a, k in zip(*box, layout.offset, layout.chunk, strict=True))


def _live(spark: SparkSession, where: str, now: State, chunks: Range | None = None) -> DataFrame | None:
    """Blocks of an array, of the chunks asked for; None if no write can have any."""
    out = None
    for n, name, lo, hi in now.writes:
        if chunks is not None and not _meets((lo, hi), chunks):
            continue
        rows = spark.read.schema(B.SCHEMA).parquet(f"{where}/{name}")
        for later, _, a, b in now.writes:
            if later > n and _meets((lo, hi), (a, b)):
                rows = rows.filter(~_inside(a, b))
        out = rows if out is None else out.unionByName(rows)
    return out if out is None or chunks is None else out.filter(_inside(*chunks))


def read_array(spark: SparkSession, path: str, dataset: str, array: str, box: tuple[Vec, Vec] | None = None) -> DataFrame:
    """The blocks of a stored array, with ``box`` those that meet it; chunks without a value are absent."""
    now = state(spark, path, dataset, array)
    if now is None:
        raise ValueError(f"no array {array} of {dataset} in {path}")
    rows = _live(spark, folder(path, dataset, array), now, None if box is None else _chunks(now.layout, box))
    return spark.createDataFrame([], B.SCHEMA) if rows is None else rows


def _cut(blocks: DataFrame, layout: Layout, target: tuple[Vec, Vec]) -> DataFrame:
    """The parts of blocks (on any grid of chunks) inside the target box, cut at the array's chunks."""

    def parts(r) -> Iterator[tuple]:
        a, lo = B.array_of(r), (r.oz, r.oy, r.ox)
        s = [max(o, b) for o, b in zip(target[0], lo, strict=True)]
        e = [min(o + m, b + n) for o, m, b, n in zip(*target, lo, a.shape, strict=True)]
        if any(x >= y for x, y in zip(s, e, strict=True)):
            return
        first, last = _chunks(layout, (s, [y - x for x, y in zip(s, e, strict=True)]))
        for c in product(*[range(p, q) for p, q in zip(first, last, strict=True)]):
            begin = [max(x, o + k * i) for x, o, k, i in zip(s, layout.offset, layout.chunk, c, strict=True)]
            end = [min(y, o + k * (i + 1)) for y, o, k, i in zip(e, layout.offset, layout.chunk, c, strict=True)]
            part = a[tuple(slice(x - b, y - b) for x, y, b in zip(begin, end, lo, strict=True))]
            yield B._row(c, begin, part.astype(layout.dtype), layout.dtype)

    return blocks.select(B.COLUMNS).mapInPandas(B.rows_of(parts, B.COLUMNS), B.SCHEMA)


def _merge(layout: Layout):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One chunk: what was there, then what is new in the order of its first voxel."""
        c = [int(pdf[k].iloc[0]) for k in B.CHUNK]
        lo = [o + k * i for o, k, i in zip(layout.offset, layout.chunk, c, strict=True)]
        size = [min(k, o + n - b) for k, o, n, b in zip(layout.chunk, layout.offset, layout.shape, lo, strict=True)]
        a = np.full(size, layout.fill, layout.dtype)
        for r in pdf.sort_values(["fresh", "oz", "oy", "ox"]).itertuples():
            a[tuple(slice(o - b, o - b + s) for o, b, s in zip((r.oz, r.oy, r.ox), lo, (r.sz, r.sy, r.sx), strict=True))] = B.array_of(r)
        return pd.DataFrame([(*B._row(c, lo, a, layout.dtype), bool(pdf["fresh"].any()))], columns=[*B.COLUMNS, "fresh"])

    return run


def infer_layout(blocks: DataFrame, dtype: str | None = None) -> Layout | None:
    """Offset, shape, chunk and type of a table of blocks on one grid; None if it is empty."""
    lows, highs = [F.min(f"o{a}") for a in "zyx"], [F.max(F.col(f"o{a}") + F.col(f"s{a}")) for a in "zyx"]
    row = blocks.agg(*lows, *highs, *[F.max(f"s{a}") for a in "zyx"], F.min("dtype")).first()
    if row[0] is None:
        return None
    return Layout(list(row[0:3]), [h - o for o, h in zip(row[0:3], row[3:6], strict=True)], list(row[6:9]), dtype or row[9])


def update_blocks(
    blocks: DataFrame, path: str, dataset: str, array: str, box: tuple[Vec, Vec] | None = None, layout: Layout | None = None, dtype: str | None = None,
) -> int:
    """Write the parts of ``blocks`` inside ``box`` into a stored array; returns the number of chunks that got new values.

    The first write needs ``layout``, or takes that of ``blocks``; later ones keep the array's, so values are cast and what
    lies outside its box is left out. A box that misses the array is skipped with a warning. Of blocks that overlap
    the one that begins last wins.
    """
    spark, where = blocks.sparkSession, folder(path, dataset, array)
    now = state(spark, path, dataset, array)
    if now is None:
        layout = layout or infer_layout(blocks, dtype)
        if layout is None:
            return 0
        now = State(layout)
    layout = now.layout
    asked = (layout.offset, layout.shape) if box is None else box
    lo = [max(a, o) for a, o in zip(asked[0], layout.offset, strict=True)]
    hi = [min(a + n, o + s) for a, n, o, s in zip(*asked, layout.offset, layout.shape, strict=True)]
    if any(a >= b for a, b in zip(lo, hi, strict=True)):
        warnings.warn(f"box {asked} lies outside array {array} of {dataset}", stacklevel=2)
        return 0
    target = lo, [b - a for a, b in zip(lo, hi, strict=True)]
    pieces = _cut(blocks, layout, target)
    if box is None:  # what is brought may be a small part of the array
        span = pieces.agg(*[F.min(c) for c in B.CHUNK], *[F.max(c) for c in B.CHUNK]).first()
        if span[0] is None:
            return 0
        chunks = tuple(span[:3]), tuple(k + 1 for k in span[3:])
    else:
        chunks = _chunks(layout, target)
    rows = pieces.withColumn("fresh", F.lit(True))
    old = _live(spark, where, now, chunks)
    if old is not None:
        rows = rows.unionByName(old.withColumn("fresh", F.lit(False)))
    number = now.last + 1
    name = _new_folder(number)
    out = f"{where}/{name}"
    merged = rows.groupBy(*B.CHUNK).applyInPandas(_merge(layout), B.SCHEMA + ", fresh boolean")
    merged.write.parquet(out)
    fresh = spark.read.parquet(out).filter("fresh").count()
    if not fresh:
        scratch.delete(spark, out)
        return 0
    span = list(chunks[0]), list(chunks[1])
    covered = lambda w: all(a <= p and q <= b for a, b, p, q in zip(*span, w[2], w[3], strict=True))
    _commit(spark, where, State(layout, number, [*[w for w in now.writes if not covered(w)], (number, name, *span)]))
    return fresh


def compact(spark: SparkSession, path: str, dataset: str, array: str) -> None:
    """Rewrite an array as one write. Folders of earlier writes stay for readers of earlier manifests until ``vacuum``."""
    where, now = folder(path, dataset, array), state(spark, path, dataset, array)
    if now is None or len(now.writes) < 2:
        return
    number = now.last + 1
    name = _new_folder(number)
    _live(spark, where, now).write.parquet(f"{where}/{name}")
    whole = _chunks(now.layout, (now.layout.offset, now.layout.shape))
    _commit(spark, where, State(now.layout, number, [(number, name, list(whole[0]), list(whole[1]))]))


def vacuum(spark: SparkSession, path: str, dataset: str, array: str) -> None:
    """Delete the folders that the newest manifest doesn't name, and all manifests before it."""
    where, now = folder(path, dataset, array), state(spark, path, dataset, array)
    if now is None:
        return
    kept = {name for _, name, _, _ in now.writes}
    for name in scratch.names(spark, where):
        if name.startswith("write=") and name not in kept:
            scratch.delete(spark, f"{where}/{name}")
    for name in scratch.names(spark, f"{where}/_state"):
        if name != f"{now.last:010d}.json":
            scratch.delete(spark, f"{where}/_state/{name}")
