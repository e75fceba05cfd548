"""Connected components over blocks: labels inside chunks, face planes between them, and removal by size without a voxel row.

A chunk is labelled by union-find over its runs along x. Only face planes of labels go to the neighbour (one small shuffle),
where touching labels become edges of a graph of (chunk, label) numbers; ``components`` joins them, sizes are summed by the component's
smallest number, and every chunk gets the list of its labels that go. What shuffles is faces, numbers and, once, the
chunks themselves. A component of any size costs its labels a row each, never a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from . import blocks as B
from .components import components
from .roi import Vec

#: A node is chunk number * 2**LABEL_BITS + label.
LABEL_BITS = 31
_FACES = "cz long, cy long, cx long, axis int, upper boolean, base long, plane binary"


def label_block(fg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, sizes) of the 6-connected foreground: labels from 1 in the order of their first voxel, 0 elsewhere; sizes[k] is that of label k + 1."""
    starts = fg.copy()
    starts[..., 1:] &= ~fg[..., :-1]
    runs = np.where(fg, np.cumsum(starts.ravel()).reshape(fg.shape), 0)
    n = int(starts.sum())
    root = np.arange(n + 1)
    for axis in (0, 1):
        low, high = (np.take(runs, r, axis).ravel() for r in (range(fg.shape[axis] - 1), range(1, fg.shape[axis])))
        both = (low > 0) & (high > 0)
        pairs = np.unique(low[both] * (n + 1) + high[both])
        a, b = pairs // (n + 1), pairs % (n + 1)
        while len(a):
            la, lb = root[a], root[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
            while (root[root] != root).any():
                root = root[root]
    tops = np.unique(root[1:])
    dense = np.zeros(n + 1, np.int32)
    dense[1:] = np.searchsorted(tops, root[1:]) + 1
    labels = dense[runs]
    return labels, np.bincount(labels.ravel(), minlength=len(tops) + 1)[1:]


def _chunk_counts(box: tuple[Vec, Vec], chunk: Vec) -> list[int]:
    counts = [-(-s // k) for s, k in zip(box[1], chunk, strict=True)]
    if counts[0] * counts[1] * counts[2] >= 1 << (63 - LABEL_BITS) or chunk[0] * chunk[1] * chunk[2] >= 1 << LABEL_BITS:
        raise ValueError(f"{counts} chunks of {chunk} can't be numbered in 63 bits")
    return counts


def label_blocks(blocks: DataFrame, box: tuple[Vec, Vec], chunk: Vec, invert: bool = False) -> DataFrame:
    """Written table of the blocks' labels: chunk number, box, base (first node), labels (int32, zlib) and sizes. ``invert`` labels zeros."""
    counts = _chunk_counts(box, chunk)

    def one(r) -> Iterator[tuple]:
        a = B.array_of(r)
        labels, sizes = label_block((a == 0) if invert else (a != 0))
        base = ((r.cz * counts[1] + r.cy) * counts[2] + r.cx) << LABEL_BITS
        yield r.cz, r.cy, r.cx, r.oz, r.oy, r.ox, *a.shape, base, zlib.compress(labels.astype("<i4").tobytes(), 1), sizes.tolist()

    schema = ", ".join(f"{c} long" for c in (*B.CHUNK, *B.BOX, "base")) + ", labels binary, sizes array<long>"
    return materialize(blocks.select(B.COLUMNS).mapInPandas(B.rows_of(one, [*B.CHUNK, *B.BOX, "base", "labels", "sizes"]), schema), "block-labels")


def labels_of(row) -> np.ndarray:
    return np.frombuffer(zlib.decompress(row.labels), "<i4").reshape(row.sz, row.sy, row.sx)


def face_edges(labelled: DataFrame) -> DataFrame:
    """(u, v): nodes of neighbouring chunks that touch. Two planes meet for each pair of neighbours."""

    def planes(r) -> Iterator[tuple]:
        a, c = labels_of(r), (r.cz, r.cy, r.cx)
        for axis in range(3):
            for upper, at in ((False, -1), (True, 0)):  # the chunk below gives its last plane, the one above its first
                plane = np.take(a, at, axis)
                if plane.any():
                    meet = [k + (j == axis and not upper) for j, k in enumerate(c)]
                    yield *meet, axis, upper, r.base, zlib.compress(plane.tobytes(), 1)

    def touch(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        (below, a), (above, b) = [(r.base, np.frombuffer(zlib.decompress(r.plane), "<i4").astype(np.int64)) for r in pdf.sort_values("upper").itertuples()]
        both = (a > 0) & (b > 0)
        pairs = np.unique(np.stack([a[both] + below, b[both] + above], 1), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    rows = labelled.select(*B.CHUNK, "sz", "sy", "sx", "base", "labels").mapInPandas(B.rows_of(planes, [*B.CHUNK, "axis", "upper", "base", "plane"]), _FACES)
    return rows.groupBy(*B.CHUNK, "axis").applyInPandas(touch, "u long, v long")


def _small(labelled: DataFrame, min_size: int, across: bool) -> DataFrame:
    """(cz, cy, cx, gone): the labels of each chunk whose component has fewer than ``min_size`` voxels."""
    nodes = labelled.select(*B.CHUNK, "base", F.posexplode("sizes").alias("k", "n")).withColumn("label", F.col("k") + 1)
    if not across:
        return nodes.filter(F.col("n") < min_size).groupBy(*B.CHUNK).agg(F.collect_list("label").alias("gone"))  # no more than a chunk's labels
    joined = components(face_edges(labelled))
    nodes = nodes.withColumn("u", F.col("base") + F.col("label")).join(joined, "u", "left").withColumn("top", F.coalesce("v", "u"))
    small = nodes.groupBy("top").agg(F.sum("n").alias("all")).filter(F.col("all") < min_size).select("top")
    out = materialize(nodes.filter(F.col("n") < min_size).join(small, "top", "left_semi").groupBy(*B.CHUNK).agg(F.collect_list("label").alias("gone")), "small-labels")
    discard(joined)
    return out


def remove_small_blocks(blocks: DataFrame, min_size: int, box: tuple[Vec, Vec], chunk: Vec, across: bool = True, holes: bool = False) -> DataFrame:
    """Blocks (uint8, 0 and 1) without components of fewer than ``min_size`` voxels; with ``holes`` those of the background are filled instead.

    With ``across`` components go on in neighbouring chunks, else each chunk is judged by itself. Absent chunks are
    background; holes need all chunks of the box (``chunks.fill_missing``).
    """
    labelled = label_blocks(blocks, box, chunk, invert=holes)
    gone = _small(labelled, min_size, across)

    def one(r) -> Iterator[tuple]:
        a = labels_of(r)
        keep = np.ones(len(r.sizes) + 1, np.uint8)
        keep[0] = 0
        if r.gone is not None:
            keep[np.asarray(r.gone, np.int64)] = 0
        out = keep[a]
        yield B._row((r.cz, r.cy, r.cx), (r.oz, r.oy, r.ox), 1 - out if holes else out, "uint8")

    out = materialize(labelled.join(gone, B.CHUNK, "left").mapInPandas(B.rows_of(one, B.COLUMNS), B.SCHEMA), "sized-blocks")
    discard(labelled, *([gone] if across else []))
    return out
