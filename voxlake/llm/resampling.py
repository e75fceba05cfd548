"""Importance resampling towards a target: draw the documents whose hashed n-grams look most like those of target texts.

Features of a text are all runs of 1 to 2 consecutive words (A-Z lower-cased first, a word is a run of digits, a-z and
characters beyond ASCII), repeats counted; a feature's bucket is its crc32 modulo ``buckets``. One pass counts the
buckets of all documents, another those of the targets. A bucket's gain is the floored thousandfold logarithm of how
much likelier it is under the target, both counts smoothed by one; a document's weight is the floored mean of its
features' gains, looked up in one array. A Gumbel draw from a hash of the id is added, so that the highest scores
are a draw without replacement by weight.

The cut-off is found by bracketing: a quantile sketch proposes two scores that should enclose it, exact counts of the
rows outside check that, and the bracket is widened until they agree. Only the rows inside are sorted. As many
rows may share a score, a bracket that one score fills is narrowed again by the id. Neither texts nor a group is gathered:
both passes sum arrays of ``buckets`` numbers in tasks, ranks come from a sort of the drawn rows by ranges.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as the empty text and comes first
among equal scores; rows that repeat an id are documents of their own, and if the cut-off falls between rows equal in
score and id, any of them are drawn, as many as fit; texts of fewer than ``min_words`` words are scored and never
drawn; without target texts all smoothed target counts are equal; an empty table gives no row. Columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialize

BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
#: At most so many rows are sorted to find the cut-off.
BRACKET = 100_000
SKETCH = 10_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KNOWN_WORDS = 200_000


class Features:
    """Buckets of the features of texts; hashes of words are kept in a bounded cache."""

    def __init__(self, buckets: int):
        self.buckets, self.cache = buckets, {}

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        words = _WORD.findall((text or "").encode().lower())
        if not words:
            return 0, np.zeros(0, np.int64)
        if len(self.cache) > _KNOWN_WORDS:
            self.cache.clear()
        crc, cache = zlib.crc32, self.cache
        for w in words:
            if w not in cache:
                cache[w] = (crc(w), b" " + w)
        known = [cache[w] for w in words]
        pairs = [crc(after[1], before[0]) for before, after in zip(known, known[1:])]
        return len(words), np.array([k[0] for k in known] + pairs, np.int64) % self.buckets


def _counts(texts: DataFrame, text: str, buckets: int) -> list[int]:
    """Features by bucket over all rows: every task sums one array, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(features.of(t)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = texts.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # no more rows than buckets
        out[r.bucket] = r.n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket, from the counts of all documents and of the targets."""
    k, total, wanted = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (total + k) / ((s + 1) * (wanted + k)))) for s, t in zip(raw, target, strict=True)]


def weighed(docs: DataFrame, gain: list[int], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, g = Features(len(gain)), table.value
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                n_words, at = features.of(t)
                rows.append((n_words, len(at), int(g[at].sum()) // len(at) if len(at) else 0))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text).alias("__t")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: str, seed: int = 7) -> Column:
    """The floored thousandfold Gumbel draw of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bracket(rows: DataFrame, value: str, k: int, n: int, margin: float) -> tuple[int, int, int]:
    """(low, high, number of rows above high): the k-th largest of ``n`` values lies in [low, high].

    The sketch gives the bounds, one aggregate counts what is outside; where it shows that the k-th isn't inside, the margin grows.
    """
    while True:
        at = [max(0.0, 1 - k / n - margin), min(1.0, 1 - k / n + margin)]
        low, high = rows.agg(F.percentile_approx(value, at, SKETCH)).first()[0]
        above, upto = rows.agg(F.count_if(F.col(value) > high), F.count_if(F.col(value) >= low)).first()
        if above < k <= upto:
            return low, high, above
        if k <= above and at[1] == 1.0 or k > upto and at[0] == 0.0:  # the sketch's ends are exact
            raise AssertionError("rows changed between two passes")
        margin = min(1.0, margin * 4)


def kth_largest(rows: DataFrame, value: str, k: int, n: int, limit: int = BRACKET) -> tuple[int, int]:
    """(the k-th largest value, how many of its rows belong to the k largest); only a bracket of at most ``limit`` rows is sorted."""
    inside, want, size, margin = rows, k, n, 2.0 / SKETCH
    while True:
        low, high, above = _bracket(inside, value, want, size, margin)
        inside = inside.filter(F.col(value).between(low, high))
        want -= above
        if low == high:
            return low, want
        held = inside.count()
        if held <= limit:
            break
        if held == size:  # a few values hold all rows: the least of them is the one sought, or it goes
            more = inside.filter(F.col(value) > low)
            held = more.count()
            if held < want:
                return low, want - held
            inside = more
        size = held
    cut = inside.select(value).orderBy(F.desc(value)).offset(want - 1).first()[0]
    return cut, want - inside.filter(F.col(value) > cut).count()


def _ranked(drawn: DataFrame, order: list[Column]) -> DataFrame:
    """Add rank 1, 2, ... in ``order``: rows sorted by ranges, numbered inside each and shifted by the ranges before."""
    low = F.lit((1 << 33) - 1).cast("bigint")
    rows = drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(low)), "resample-ranks")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row for each range
    return rows.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__at") + F.col("__start") + 1).drop("__part", "__at", "__start")


def resampled(
    docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = 7, bracket: int = BRACKET,
) -> DataFrame:
    """id, n_features, weight, score and rank of every row of ``docs``; rank is null for rows that aren't drawn."""
    gain = gains(_counts(docs, text, buckets), _counts(target, target_text, buckets))
    rows = weighed(docs, gain, text, id_col)
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel(id_col, seed)), "resample-scores")
    kept = [F.col(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    able = F.col("n_words") >= min_words
    n = rows.filter(able).count()
    k = percent * n // 100
    if not k:
        return rows.select(*kept, none)
    cut, ties = kth_largest(rows.filter(able), "score", k, n, bracket)
    tied = rows.filter(able & (F.col("score") == cut))
    n_tied = tied.count()
    place = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    last = None
    if ties < n_tied:  # the smallest ids, so the largest of their opposites; ~x turns the order of all integers round
        last, _ = kth_largest(tied.select(F.bitwise_not(place).alias("place")), "place", ties, n_tied, bracket)
    chosen = able & ((F.col("score") > cut) | ((F.col("score") == cut) & (F.lit(True) if last is None else F.bitwise_not(place) >= F.lit(last).cast("bigint"))))
    ranked = _ranked(rows.filter(chosen).select(*kept), [F.desc("score"), F.asc_nulls_first(id_col)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(rows.filter(~chosen).select(*kept, none))
