"""Block-wise application of a user's model."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .merge import argmax_segment, softmax
from .roi import Vec


Model = Callable[[np.ndarray], np.ndarray]

#: Models that a worker process holds by their key, the last ones used; tasks that run in it later find them here.
_LOADED: OrderedDict[str, Model] = OrderedDict()
HELD = 2


def held_model(key: str, model_fn: Callable[[], Model], most: int = HELD) -> Model:
    """The model of ``key``, loaded by ``model_fn`` if this process doesn't hold it; beyond ``most`` the longest unused goes."""
    if key not in _LOADED:
        while len(_LOADED) >= most:
            _LOADED.popitem(last=False)
        _LOADED[key] = model_fn()
    _LOADED.move_to_end(key)
    return _LOADED[key]


def model_key(model_fn: Callable[[], Model]) -> str:
    """A key from the function's code and what it closes over."""
    import hashlib

    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(model_fn)).hexdigest()


def cover(box: tuple[Vec, Vec], out_shape: Vec) -> tuple[Vec, Vec]:
    """A box grown to at least one output block, half of the difference before (rounded down)."""
    lack = [max(0, o - s) for o, s in zip(out_shape, box[1], strict=True)]
    return [o - n // 2 for o, n in zip(box[0], lack, strict=True)], [s + n for s, n in zip(box[1], lack, strict=True)]


def predict_blocks(
    blocks: DataFrame, model_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], in_shape: Vec, out_shape: Vec, box: tuple[Vec, Vec], n_classes: int, fill: float = 0, split: bool = True
) -> DataFrame:
    """Blocks (c, then as the input) of the classes' outputs; without ``split`` those of a chunk one after another along z in one row.

    ``blocks`` are chunks of ``out_shape``; each is grown to ``in_shape`` by a halo exchange. ``model_fn``
    loads the model, once for each Python worker process that Spark keeps (``held_model``); it takes the grown block and returns (classes, *out_shape).
    """
    context = [(i - o) // 2 for i, o in zip(in_shape, out_shape, strict=True)]
    key = model_key(model_fn)

    def run(a: np.ndarray) -> np.ndarray:
        out = held_model(key, model_fn)(a)
        return np.concatenate(list(out), axis=0)  # classes one after another along z

    stacked = B.with_halo(blocks, context, run, box, out_shape, fill, "float64")

    if not split:
        return stacked

    def by_class(row) -> Iterator[tuple]:
        a = B.array_of(row)
        depth = a.shape[0] // n_classes
        for c in range(n_classes):
            yield c, *B._row((row.cz, row.cy, row.cx), (row.oz, row.oy, row.ox), a[c * depth : (c + 1) * depth], row.dtype)

    return stacked.mapInPandas(B.rows_of(by_class, ["c", *B.COLUMNS]), "c int, " + B.SCHEMA)


def _arrays_of(row, scores: np.ndarray, masked: bool) -> list[tuple]:
    """Rows (array, block) of the class maps and the segmentation of one chunk."""
    e = np.exp(scores - scores.max(0))
    place = (row.cz, row.cy, row.cx), (row.oz, row.oy, row.ox)
    rows = [(f"prob_maps/class_{c}", *B._row(*place, p.astype(np.float32), "float32")) for c, p in enumerate(e / e.sum(0))]
    best = scores.argmax(0).astype(np.uint8)
    if masked:
        inside = np.frombuffer(row.mask, np.dtype(row.mask_dtype).newbyteorder("<")).reshape(best.shape) != 0 if row.mask is not None else False
        best = np.where(inside, best, 0).astype(np.uint8)
    return [*rows, ("segmentation", *B._row(*place, best, "uint8"))]


def prediction(
    blocks: DataFrame, model_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], in_shape: Vec, out_shape: Vec, box: tuple[Vec, Vec], n_classes: int,
    mask: DataFrame | None = None, fill: float = 0,
) -> DataFrame:
    """Blocks with a column array: prob_maps/class_<c> (softmax, float32) and segmentation (uint8: the class of the highest score, 0 outside the mask).

    The model runs once a block, and all its arrays come from that one output. ``mask``: blocks of the same chunks; a chunk without one is outside.
    """
    scores = predict_blocks(blocks, model_fn, in_shape, out_shape, box, n_classes, fill, split=False)
    masked = mask is not None
    if masked:
        scores = scores.join(mask.select(*B.CHUNK, F.col("dtype").alias("mask_dtype"), F.col("data").alias("mask")), B.CHUNK, "left")
    else:
        scores = scores.withColumns({"mask_dtype": F.lit(None).cast("string"), "mask": F.lit(None).cast("binary")})

    def arrays(row) -> list[tuple]:
        v = B.array_of(row)
        return _arrays_of(row, v.reshape(n_classes, v.shape[0] // n_classes, *v.shape[1:]), masked)

    return scores.mapInPandas(B.rows_of(arrays, ["array", *B.COLUMNS]), "array string, " + B.SCHEMA)


def prediction_sweep(
    blocks: DataFrame, models: Mapping[int, Callable[[], Model]], in_shape: Vec, out_shape: Vec, box: tuple[Vec, Vec],
    mask: DataFrame | None = None, fill: float = 0, run: str = "",
) -> DataFrame:
    """``prediction`` of several checkpoints (iteration -> function that loads the model) with columns iteration and array.

    Blocks are read and their halos exchanged once; then each grown block is handed to every model. A task goes through
    its blocks iteration by iteration, so it holds one model at a time and a worker process loads each at most once a
    task, and not again while it holds it. ``run`` tells models of different runs with equal iterations apart.
    """
    if not models:
        raise ValueError("no iteration")
    context = [(i - o) // 2 for i, o in zip(in_shape, out_shape, strict=True)]
    keys = {k: f"{run}/{k}/{model_key(f)}" for k, f in models.items()}
    grown = B.with_halo(blocks, context, lambda a: a, box, out_shape, fill)
    masked = mask is not None
    if masked:
        grown = grown.join(mask.select(*B.CHUNK, F.col("dtype").alias("mask_dtype"), F.col("data").alias("mask")), B.CHUNK, "left")
    else:
        grown = grown.withColumns({"mask_dtype": F.lit(None).cast("string"), "mask": F.lit(None).cast("binary")})
    each = grown.withColumn("iteration", F.explode(F.array(*[F.lit(int(k)) for k in sorted(models)]))).sortWithinPartitions("iteration")

    def arrays(row) -> list[tuple]:
        model = held_model(keys[row.iteration], models[row.iteration])
        return [(row.iteration, *r) for r in _arrays_of(row, np.asarray(model(B.array_of(row))), masked)]

    return each.mapInPandas(B.rows_of(arrays, ["iteration", "array", *B.COLUMNS]), "iteration int, array string, " + B.SCHEMA)


def iterations(start: int, stop: int, step: int) -> list[int]:
    """Checkpoints from ``start`` to ``stop``, which belongs to them."""
    return list(range(start, stop + 1, step))


def class_maps(scores: DataFrame) -> DataFrame:
    """(z, y, x, c, p): softmax over the classes' scores (z, y, x, c, v)."""
    return softmax(scores, out="p")


def segment(scores: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(z, y, x, seg): the class of the highest score, 0 outside the binarised mask."""
    return argmax_segment(scores, mask=mask)


def sweep_models(score: Callable[[DataFrame, int], DataFrame], df: DataFrame, iterations: Sequence[int]) -> DataFrame:
    """``score(df, iteration)`` for every checkpoint, as one table with column iteration."""
    out = None
    for k in iterations:
        one = score(df, k).withColumn("iteration", F.lit(k))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no iteration")
    return out
