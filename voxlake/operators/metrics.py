"""Scores of segmentations: all reduce to conditional sums in one aggregate with partial sums.

Inputs are aligned voxels; rows outside the mask are dropped first. Two-class input has the
probability of class 1 in ``prob``; many-class input has the predicted class (see ``merge.argmax_segment``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import ordered_parts

COUNTS = ("tp", "fp", "fn", "tn")


def masked(df: DataFrame, *masks: str) -> DataFrame:
    for m in masks:
        df = df.filter(F.col(m) != 0)
    return df


def counts(target: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn of two boolean columns as sums."""
    pairs = ((target & predicted), (~target & predicted), (target & ~predicted), (~target & ~predicted))
    return [F.coalesce(F.sum(p.cast("long")), F.lit(0).cast("long")).alias(n) for p, n in zip(pairs, COUNTS, strict=True)]


def jaccard_of(tp="tp", fp="fp", fn="fn") -> Column:
    union = F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(union == 0, 1.0).otherwise(F.col(tp) / union)


def dice_of(tp="tp", fp="fp", fn="fn") -> Column:
    both = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(both == 0, float("nan")).otherwise(2 * F.col(tp) / both)


def precision_of(tp="tp", fp="fp") -> Column:
    return F.when(F.col(tp) + F.col(fp) == 0, 0.0).otherwise(F.col(tp) / (F.col(tp) + F.col(fp)))


def recall_of(tp="tp", fn="fn") -> Column:
    return F.when(F.col(tp) + F.col(fn) == 0, 0.0).otherwise(F.col(tp) / (F.col(tp) + F.col(fn)))


def per_class(df: DataFrame, target: str, pred: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, cls, tp, fp, fn, tn): each voxel feeds its two classes, the rest follows from the total."""
    sums = []
    for k in classes:
        t, p = F.col(target) == k, F.col(pred) == k
        sums.append(F.struct(F.lit(k).alias("cls"), F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"), F.sum((t & ~p).cast("long")).alias("fn"), F.sum((~t & ~p).cast("long")).alias("tn")))
    return df.groupBy(*by).agg(F.array(*sums).alias("__a")).select(*by, F.inline("__a"))


def with_argmax(df: DataFrame, prob: str, out: str = "pred") -> DataFrame:
    """A single channel gets the background 1 - p; ties go to the lower class."""
    return df.withColumn(out, (F.col(prob) > 1 - F.col(prob)).cast("int"))


def jaccard(df: DataFrame, target: str, pred: str, classes: Sequence[int]) -> DataFrame:
    return per_class(df, target, pred, classes).select("cls", jaccard_of().alias("jaccard"))


def pair_metric(df: DataFrame, metric: str, target: str, prob: str, t: float, cls: int = 1) -> DataFrame:
    """jaccard or dice of one class against prob >= t."""
    f = {"jaccard": jaccard_of, "dice": dice_of}[metric]
    return df.agg(*counts(F.col(target) == cls, F.col(prob) >= t)).select(f().alias(metric))


def precision_recall(df: DataFrame, target: str, pred: str, classes: Sequence[int]) -> DataFrame:
    return per_class(df, target, pred, classes).select("cls", precision_of().alias("precision"), recall_of().alias("recall"))


def precision_recall_at(df: DataFrame, target: str, prob: str, t: float) -> DataFrame:
    rows = df.withColumns({"__t": (F.col(target) == 1).cast("int"), "__p": (F.col(prob) >= t).cast("int")})
    return precision_recall(rows, "__t", "__p", (0, 1))


def pr_curve(df: DataFrame, target: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, precision, recall) at every distinct score and at a leading threshold 0.

    Counts per score are aggregated first; the running sums go over distinct scores, in ranges of as many of them each, with a row
    for each range carried to those after it. So scores may be anywhere, and crowd. A null score is reached by the threshold 0 alone.
    """
    pos = (F.col(target) != 0).cast("long")
    score = df.groupBy(*by, F.col(prob).alias("s")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    score = ordered_parts(score, [*map(F.col, by), F.desc("s")], "pr-curve")
    ranges = score.groupBy(*by, "__part").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = ranges.select(*by, "__part", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("an"), F.sum("rp").over(whole).alias("pos"), F.sum("rn").over(whole).alias("neg"))
    inside = Window.partitionBy(*by, "__part").orderBy("__at")
    rows = _meet(score.withColumns({"p": F.sum("p").over(inside), "n": F.sum("n").over(inside)}), ranges, by)
    rows = rows.select(*by, F.col("s").alias("threshold"), (F.col("p") + F.col("ap")).alias("tp"), (F.col("n") + F.col("an")).alias("fp"), "pos")
    first = ranges.select(*by, F.lit(0.0).alias("threshold"), F.col("pos").alias("tp"), F.col("neg").alias("fp"), "pos").distinct()
    rows = rows.filter("threshold != 0").unionByName(first)
    recall = F.when(F.col("pos") == 0, 0.0).otherwise(F.col("tp") / F.col("pos"))
    return rows.select(*by, "threshold", "tp", "fp", precision_of().alias("precision"), recall.alias("recall"))


def _meet(rows: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with what ``ranges`` holds for their (by, __part); groups may be null."""
    met = ranges.withColumnsRenamed({c: f"__m_{c}" for c in (*by, "__part")})
    same = F.lit(True)
    for c in (*by, "__part"):
        same = same & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
    return rows.join(met, same).drop(*[f"__m_{c}" for c in (*by, "__part")])


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of (R_n - R_n-1) P_n over falling thresholds, in which the recall never falls.

    Thresholds lie in ranges of as many of them each; the recall before a range's first threshold is the largest of the ranges above.
    """
    rows = ordered_parts(curve.select(*by, "threshold", "precision", "recall"), [*map(F.col, by), F.desc("threshold")], "average-precision")
    above = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*by, "__part").agg(F.max("recall").alias("__m")).withColumn("__m", F.coalesce(F.max("__m").over(above), F.lit(0.0)))
    rows = _meet(rows.withColumn("__l", F.lag("recall").over(Window.partitionBy(*by, "__part").orderBy("__at"))), start, by)
    rows = rows.withColumn("gain", F.col("recall") - F.coalesce("__l", "__m"))
    return rows.groupBy(*by).agg(F.sum(F.col("gain") * F.col("precision")).alias("average_precision"))


def confusion_matrix(df: DataFrame, target: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """(target, pred, share) of all pairs of classes, also those without a voxel; shares add up to 1."""
    cells = df.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(*[F.coalesce(F.sum(F.when((F.col("t") == a) & (F.col("p") == b), F.col("n"))), F.lit(0)).alias(f"c{a}_{b}") for a in classes for b in classes], F.sum("n").alias("total"))
    pairs = F.array(*[F.struct(F.lit(a).alias("target"), F.lit(b).alias("pred"), (F.col(f"c{a}_{b}") / F.col("total")).alias("share")) for a in classes for b in classes])
    return total.select(F.inline(pairs))


def thresholds(start: float, stop: float, step: float) -> list[float]:
    """Inclusive of ``stop``."""
    n = int((stop - start) / step + 1e-9)
    return [round(start + k * step, 10) for k in range(n + 1)]


def sweep(df: DataFrame, target: str, prob: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, jaccard, dice, precision, recall) of all thresholds in one pass over the voxels.

    A voxel only finds out how many thresholds it reaches; counts per that number are aggregated,
    and suffix sums over the few thresholds give the rest.
    """
    at = sorted(at)
    reached = sum((F.col(prob) >= t).cast("int") for t in at) if at else F.lit(0)
    pos = (F.col(target) != 0).cast("long")
    bins = df.groupBy(*by, reached.alias("k")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    sums = []
    for i, t in enumerate(at):
        on = F.col("k") > i
        part = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0).cast("long"))
        sums.append(F.struct(F.lit(float(t)).alias("threshold"), part(on, "p").alias("tp"), part(on, "n").alias("fp"), part(~on, "p").alias("fn"), part(~on, "n").alias("tn")))
    rows = bins.groupBy(*by).agg(F.array(*sums).alias("__a")).select(*by, F.inline("__a"))
    return rows.select("*", jaccard_of().alias("jaccard"), dice_of().alias("dice"), precision_of().alias("precision"), recall_of().alias("recall"))


def best_threshold(swept: DataFrame, score: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """The row of the largest (score, threshold); precision_recall counts by their sum."""
    s = F.col("precision") + F.col("recall") if score == "precision_recall" else F.col(score) if isinstance(score, str) else score
    best = F.max(F.struct(F.when(F.isnan(s), float("-inf")).otherwise(s).alias("score"), "threshold")).alias("b")
    return swept.groupBy(*by).agg(best).select(*by, "b.score", "b.threshold")


def score_report(df: DataFrame, by: Sequence[str], target: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """jaccard, dice, precision and recall of each class and dataset."""
    return per_class(df, target, pred, classes, by).select(*by, "cls", jaccard_of().alias("jaccard"), dice_of().alias("dice"), precision_of().alias("precision"), recall_of().alias("recall"))


def class_balance(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, label, n, share) of each block or iteration."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def balance_scale(df: DataFrame, by: Sequence[str], label: str, mask: str, n_classes: int, clipmin: float = 0.05, clipmax: float = 0.95) -> DataFrame:
    """Add scale: 1 / (n classes * the class's clipped share of the block's masked voxels), 0 outside the mask."""
    inside = df.filter(F.col(mask) != 0)
    n = inside.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n"))
    share = n.select(*by, label, (F.col("__n") / F.sum("__n").over(Window.partitionBy(*by))).alias("__s"))
    weight = 1 / (n_classes * F.least(F.greatest(F.coalesce(F.col("__s"), F.lit(0.0)), F.lit(clipmin)), F.lit(clipmax)))
    return df.join(share, [*by, label], "left").withColumn("scale", F.when(F.col(mask) != 0, weight).otherwise(0.0)).drop("__s")
