"""Jobs made of several operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from ..operators import box_sums, loss, merge, metrics, project, resample, roi, sample
from ..operators.roi import Vec


def evaluate(voxels: DataFrame, target: str, prob: str, masks: Sequence[str], box: tuple[Vec, Vec], padding: int | Vec, at: Sequence[float]) -> DataFrame:
    """Scores at every threshold over the box without its padding: labels binarised, outside the masks dropped, one pass."""
    pad = (padding,) * 3 if isinstance(padding, int) else padding
    inner = [o + p for o, p in zip(box[0], pad, strict=True)], [s - 2 * p for s, p in zip(box[1], pad, strict=True)]
    rows = roi.crop(voxels, *inner)
    rows = project.binarize(rows, [target])
    if masks:
        rows = metrics.masked(rows, *masks)
    return metrics.sweep(rows, target, prob, at)


def validate_predictions(df: DataFrame, by: Sequence[str], scores: Sequence[str], target: str, mask: str, clip: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(by, loss, jaccard_<class>) of validation voxels: balanced and scaled cross entropy, and the scores of the predicted class."""
    rows = metrics.balance_scale(df, by, target, mask, len(scores), *clip)
    best = F.greatest(*scores)
    pred = F.lit(None).cast("int")
    for k in reversed(range(len(scores))):
        pred = F.when(F.col(scores[k]) == best, k).otherwise(pred)
    rows = rows.withColumn("__pred", pred)
    losses = loss.cross_entropy(rows, scores, target, "scale", mask, by=by)
    report = metrics.score_report(metrics.masked(rows, mask), by, target, "__pred", range(len(scores)))
    wide = report.groupBy(*by).agg(*[F.max(F.when(F.col("cls") == k, F.col("jaccard"))).alias(f"jaccard_{k}") for k in range(len(scores))])
    return losses.join(wide, list(by), "left")


MOST = 4 * 8**4


def _accepted(places: DataFrame, tree: dict[int, DataFrame], shape: Vec, n: int, seed: int, min_masked: float, p_reject: float, reject_below: float, p_keep: float) -> DataFrame:
    """(i, o*) of the first ``n`` accepted candidates at most; a candidate without a voxel is none."""
    volume = float(shape[0] * shape[1] * shape[2])
    boxes = sample.sized(places.select("i", *[F.col(a).alias(f"o{a}") for a in roi.AXES]), shape)
    found = box_sums.box_sums(boxes, tree, ["label", "mask", "n"]).filter("n > 0")
    share = found.withColumns({"ratio": F.col("label") / volume, "masked": F.col("mask") / volume})
    kept = sample.accept_location(share, min_masked, p_reject, seed + 11)
    kept = kept.filter((F.col("masked") > reject_below) | (project.draw(seed + 12, "i") > 1 - p_keep))
    return sample.first_accepted(kept, n).select("i", *[f"o{a}" for a in roi.AXES])


def _deformed(rows: DataFrame, shape: Vec, elastic: tuple[int, float, tuple[float, float]], seed: int) -> DataFrame:
    """Each block deformed by draws from (seed, i): raw interpolated, label and mask from the nearest voxel. A group is one block."""
    import numpy as np
    import pandas as pd

    from ..operators import blocks as B

    at = list(roi.AXES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, ignore_index=True)
        places = B.displaced(tuple(shape), *elastic, np.random.default_rng([seed, int(pdf["i"].iloc[0])]))
        for c in ("raw", "label", "mask"):
            pdf[c] = B.gather(pdf[c].to_numpy().reshape(shape), places, 1 if c == "raw" else 0).ravel().astype(pdf[c].dtype)
        return pdf

    return rows.groupBy("i").applyInPandas(run, rows.schema)


def build_training_sets(datasets: Mapping[str, tuple[DataFrame, tuple[Vec, Vec]]], shape: Vec, n: int, seed: int, **how) -> DataFrame:
    """``build_training_blocks`` of ``n`` blocks over several volumes, with a column dataset: each block's volume is drawn by the volumes' voxels.

    ``datasets``: name -> (voxels, box), a few; a volume gives as many blocks as it was drawn, numbered by the draw.
    """
    spark = next(iter(datasets.values()))[0].sparkSession
    sizes = spark.createDataFrame([(k, box[1][0] * box[1][1] * box[1][2]) for k, (_, box) in datasets.items()], "dataset string, voxels long")
    drawn = sample.sample_datasets(sizes, n, seed).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for k, (name, count) in enumerate(sorted(tuple(r) for r in drawn.collect())):  # one row a volume
        part = build_training_blocks(*datasets[name], shape, count, seed + 1000 * (k + 1), **how).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def build_training_blocks(
    voxels: DataFrame, box: tuple[Vec, Vec], shape: Vec, n: int, seed: int, min_masked: float = 0.05, p_reject: float = 0.9, reject_below: float = 0.75, p_keep: float = 0.95,
    n_classes: int = 2, scale: tuple[float, float] = (0.9, 1.1), shift: tuple[float, float] = (-0.1, 0.1),
    factor: int | Vec = 1, elastic: tuple[int, float, tuple[float, float]] | None = None,
) -> DataFrame:
    """(i, oz, oy, ox, z, y, x, raw, label, mask, scale) of ``n`` drawn blocks; ValueError if MOST * n candidates don't give them.

    Locations are drawn, in rounds until there are enough, and accepted by their shares of labelled and masked voxels, which come from a tree of
    cubes that is built once (``box_sums``); only accepted blocks are cut out, by a join on grid cells, padded, mirrored and transposed, their intensity is varied,
    and every voxel gets its class's weight. ``voxels``: z, y, x, raw (0..1), label, mask. With ``factor`` every
    factor-th voxel is taken first; with ``elastic`` (spacing, sigma, rotation) blocks are deformed, then mirrored and transposed again.
    """
    spark = voxels.sparkSession
    steps = (factor,) * 3 if isinstance(factor, int) else factor
    if max(steps) > 1:
        voxels = resample.downsample(voxels, steps, box[0])
        box = (0, 0, 0), tuple(-(-s // f) for s, f in zip(box[1], steps, strict=True))
    spans = ", ".join(f"CAST({o} AS BIGINT) AS lo_{a}, CAST({o + s - k + 1} AS BIGINT) AS hi_{a}" for a, o, s, k in zip(roi.AXES, *box, shape, strict=True))
    weights = {c: (F.col(c) != 0).cast("long") for c in ("label", "mask")}
    tree = box_sums.cube_tree(voxels.select(*roi.AXES, *[w.alias(c) for c, w in weights.items()], F.lit(1).cast("long").alias("n")), ["label", "mask", "n"], box_sums.sides_for(shape))
    tried = 4
    while True:  # a candidate depends on its number only, so a larger round begins with the smaller one
        places = sample.random_locations(spark.sql(f"SELECT {spans}"), tried * n, (1, 1, 1), seed)
        kept = materialize(_accepted(places, tree, shape, n, seed, min_masked, p_reject, reject_below, p_keep), "blocks-accepted")
        found = kept.count()
        if found >= n:
            break
        discard(kept)
        if tried >= MOST:
            raise ValueError(f"{found} of {n} blocks after {tried * n} candidates")
        tried *= 8
    discard(tree[min(tree)])
    cut = sample.cut_blocks(voxels, kept.select("i", *[F.col(f"o{a}").alias(a) for a in roi.AXES]), shape)
    rows = kept
    for a, s in zip(roi.AXES, shape, strict=True):
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long"))))
    have = cut.select("i", *roi.AXES, "raw", "label", "mask")
    rows = rows.join(have, ["i", *roi.AXES], "left")
    rows = rows.withColumns({"raw": F.coalesce("raw", F.lit(0.5)), "label": F.coalesce("label", F.lit(0)), "mask": F.coalesce("mask", F.lit(0))})
    rows = resample.simple_augment(rows, ["i"], shape, seed + 21)
    if elastic is not None:
        rows = resample.simple_augment(_deformed(rows, shape, elastic, seed + 41), ["i"], shape, seed + 51)
    rows = project.intensity_augment(rows, "raw", ["i"], scale, shift, seed + 31)
    rows = metrics.balance_scale(rows, ["i"], "label", "mask", n_classes)
    return project.scale_shift(rows, "raw", 2.0, -1.0)


def predict_voxels(df: DataFrame, weights: Sequence[dict], bias: Sequence[float], mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(class maps, segmentation) of a stencil model over voxels (z, y, x, v)."""
    from ..operators.neighbourhood import convolve

    scores = convolve(df, list(weights), list(bias))
    return merge.softmax(scores, out="p"), merge.argmax_segment(scores, mask=mask)


def predict_arrays(
    blocks: DataFrame, model_fn: Callable, in_shape: Vec, out_shape: Vec, box: tuple[Vec, Vec], n_classes: int, path: str, run: str, mask: DataFrame | None = None
) -> DataFrame:
    """The prediction of a run, written as the arrays prob_maps/class_<c> and segmentation of dataset predictions/<run>, and reread."""
    from ..operators.predict import prediction
    from ..sources.chunks import write_arrays

    return write_arrays(prediction(blocks, model_fn, in_shape, out_shape, box, n_classes, mask), path, f"predictions/{run}")


def predict_sweep_arrays(
    blocks: DataFrame, models: Mapping[int, Callable], in_shape: Vec, out_shape: Vec, box: tuple[Vec, Vec], path: str, run: str, mask: DataFrame | None = None
) -> DataFrame:
    """The predictions of several checkpoints of a run, written as the arrays of datasets predictions/<run>/iteration_<%06d>, and reread with column iteration."""
    from ..operators import blocks as B
    from ..operators.predict import prediction_sweep

    rows = prediction_sweep(blocks, models, in_shape, out_shape, box, mask, run=run)
    name = F.format_string(f"predictions/{run}/iteration_%06d", F.col("iteration"))
    out = rows.select(*B.COLUMNS, name.alias("dataset"), "array")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "array").parquet(path)
    wanted = [f"predictions/{run}/iteration_{k:06d}" for k in models]
    got = blocks.sparkSession.read.parquet(path).filter(F.col("dataset").isin(wanted))
    return got.select(F.regexp_extract("dataset", r"_(\d+)$", 1).cast("int").alias("iteration"), "array", *B.COLUMNS)


def block_scores(predicted: DataFrame, target: DataFrame, mask: DataFrame, n_classes: int) -> DataFrame:
    """(iteration, cls, tp, fp, fn, jaccard) of segmentations (iteration, blocks) against label blocks inside a mask, on one grid of chunks.

    Chunks meet once, a task counts in numpy, and Spark adds up one row a class and chunk. A class that is in neither has 1.
    """
    import numpy as np
    import pandas as pd

    from ..operators import blocks as B

    side = lambda df, n: df.select(*B.CHUNK, F.col("dtype").alias(f"{n}_dtype"), F.col("data").alias(n))
    rows = predicted.select("iteration", *B.COLUMNS).join(side(target, "target"), B.CHUNK).join(side(mask, "inside"), B.CHUNK)

    def count(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                p = B.array_of(r).ravel()
                t, m = (np.frombuffer(d, np.dtype(k).newbyteorder("<")) for d, k in ((r.target, r.target_dtype), (r.inside, r.inside_dtype)))
                table = np.bincount(t[m != 0].astype(np.int64) * n_classes + p[m != 0], minlength=n_classes * n_classes).reshape(n_classes, n_classes)
                hit = np.diag(table)
                out += [(r.iteration, c, int(hit[c]), int(table[:, c].sum() - hit[c]), int(table[c].sum() - hit[c])) for c in range(n_classes)]
            yield pd.DataFrame(out, columns=["iteration", "cls", "tp", "fp", "fn"])

    sums = rows.mapInPandas(count, "iteration int, cls int, tp long, fp long, fn long").groupBy("iteration", "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    every = F.col("tp") + F.col("fp") + F.col("fn")
    return sums.withColumn("jaccard", F.when(every == 0, 1.0).otherwise(F.col("tp") / every))


def labels_and_masks(df: DataFrame, classes: Mapping[str, int], masks: Sequence[str]) -> DataFrame:
    """label and mask of aligned binary arrays."""
    return merge.merge_masks(merge.merge_labels(project.binarize(df, list(classes)), classes), masks)
