"""Losses as aggregates over voxels with class scores in columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_softmax_at(scores: Sequence[Column], target: Column) -> Column:
    """log softmax of the target's score; the largest score is taken out first."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = reduce(lambda a, b: a + b, [F.exp(s - top) for s in scores])
    own = reduce(lambda acc, k: F.when(target == k, scores[k]).otherwise(acc), range(1, len(scores)), scores[0])
    return own - top - F.log(total)


def _weight(weight: Sequence[float] | None, n: int, target: Column) -> Column:
    w = list(weight or [1.0] * n)
    return reduce(lambda acc, k: F.when(target == k, F.lit(float(w[k]))).otherwise(acc), range(1, n), F.lit(float(w[0])))


def _terms(scores: Sequence[str], target: str, weight: Sequence[float] | None) -> tuple[Column, Column]:
    cols, t = [F.col(s).cast("double") for s in scores], F.col(target)
    return -log_softmax_at(cols, t), _weight(weight, len(cols), t)


def cross_entropy(df: DataFrame, scores: Sequence[str], target: str, scale: str, mask: str, weight: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sum of weight * -log softmax * mask * scale over the sum of scale, which isn't masked."""
    nll, w = _terms(scores, target, weight)
    return df.groupBy(*by).agg((F.sum(nll * w * F.col(mask) * F.col(scale)) / F.sum(scale)).alias("loss"))


def cross_entropy_mean(df: DataFrame, scores: Sequence[str], target: str, weight: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean with the weights in the denominator."""
    nll, w = _terms(scores, target, weight)
    return df.agg((F.sum(nll * w) / F.sum(w)).alias("loss"))


def descriptor_loss(
    df: DataFrame, scores: Sequence[str], target: str, scale: str, mask: str, predicted: Sequence[str], wanted: Sequence[str], weight: Sequence[float] | None = None
) -> DataFrame:
    """Cross entropy plus squared error of descriptors (wanted / 255, mean over channels), both scaled; total and parts."""
    nll, w = _terms(scores, target, weight)
    err = reduce(lambda a, b: a + b, [F.pow(F.col(p) - F.col(q) / 255, F.lit(2)) for p, q in zip(predicted, wanted, strict=True)]) / len(predicted)
    part = lambda e: F.sum(e * w * F.col(mask) * F.col(scale)) / F.sum(scale)
    out = df.agg(part(nll).alias("cross_entropy"), part(err).alias("descriptor"))
    return out.select((F.col("cross_entropy") + F.col("descriptor")).alias("total"), "cross_entropy", "descriptor")


def generalized_dice(df: DataFrame, scores: Sequence[str], target: str, epsilon: float = 1e-6, sigmoid: bool = True) -> DataFrame:
    """1 - 2 sum(w inter) / sum(w denom) with w = 1 / (voxels of the class) squared over one-hot targets.

    Weights fall with the square of the voxels, so ``epsilon`` stands in for a denominator of 0 only: copies of all rows don't change the loss."""
    aggs = []
    for k, s in enumerate(scores):
        p = 1 / (1 + F.exp(-F.col(s))) if sigmoid else F.col(s)
        t = (F.col(target) == k).cast("double")
        aggs += [F.sum(p * t).alias(f"i{k}"), F.sum(p + t).alias(f"d{k}"), F.sum(t).alias(f"t{k}")]
    w = [1 / F.greatest(F.col(f"t{k}") * F.col(f"t{k}"), F.lit(epsilon)) for k in range(len(scores))]
    inter = reduce(lambda a, b: a + b, [w[k] * F.col(f"i{k}") for k in range(len(scores))])
    denom = reduce(lambda a, b: a + b, [w[k] * F.col(f"d{k}") for k in range(len(scores))])
    return df.agg(*aggs).select((1 - 2 * inter / F.when(denom > 0, denom).otherwise(epsilon)).alias("loss"))


def ce_plus_dice(df: DataFrame, scores: Sequence[str], target: str, weight: Sequence[float] | None = None) -> DataFrame:
    """Both losses and their sum, each from one aggregate; joined as single rows."""
    ce = cross_entropy_mean(df, scores, target, weight).select(F.col("loss").alias("cross_entropy"), F.lit(1).alias("__one"))
    gd = generalized_dice(df, scores, target).select(F.col("loss").alias("dice"), F.lit(1).alias("__one"))
    return ce.join(gd, "__one").select((F.col("cross_entropy") + F.col("dice")).alias("total"), "cross_entropy", "dice")
