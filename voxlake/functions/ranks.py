"""Ranges of an integer column with about as many rows each, and global row numbers without a global sort in one task."""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

ROWS_PER_RANGE = 100_000
MAX_RANGES = 4096
STEP = 64


def cuts(df: DataFrame, value: Column, n: int) -> list[int]:
    """At most ``n - 1`` ascending approximate quantiles; one that holds for many rows comes as often."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    return [int(v) for v in got or ()]


def range_number(value: Column, at: list[int], spread: Column) -> Column:
    """The range of ``value``: 0 below the first cut, one more after each.

    A value that is cut k times has a share of k + 1 ranges; its rows are dealt there by ``spread``, a number in
    [0, 1), in that order. Cuts are searched in two steps of at most STEP, or their number by STEP.
    """
    if not at:
        return F.lit(0).cast("long")
    kind = "array<decimal(20,0)>"
    distinct, counts = zip(*sorted(Counter(at).items()), strict=True)
    before = list(accumulate(counts, initial=0))
    v = value.cast("decimal(20,0)")
    table = F.expr(f"cast(array({','.join(f'{x}BD' for x in distinct)}) AS {kind})")
    coarse = F.expr(f"cast(array({','.join(f'{x}BD' for x in distinct[::STEP])}) AS {kind})")
    base = F.greatest(F.size(F.filter(coarse, lambda c: c < v)) - 1, F.lit(0)) * STEP
    place = base + F.size(F.filter(F.slice(table, base + 1, F.lit(STEP)), lambda c: c < v))
    starts = F.array(*[F.lit(b) for b in before])
    first, after = F.get(starts, place), F.get(starts, place + 1)
    own = F.coalesce(F.get(table, place) == v, F.lit(False))
    return (first + F.when(own, F.floor(spread * (after - first + 1))).otherwise(0)).cast("long")


def with_rank(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """Add ``out``: 1, 2, ... in order of the integer column ``key``, ties in any order.

    Rows are numbered inside ranges cut at quantiles and shifted by the ranges before, of which there are at most MAX_RANGES.
    """
    n = df.count()
    at = cuts(df, F.col(key), max(1, min(MAX_RANGES, n // ROWS_PER_RANGE)))
    share = F.xxhash64(*df.columns) / F.lit(2.0**64) + 0.5
    rows = df.withColumn("__r", range_number(F.col(key), at, F.least(share, F.lit(1 - 2.0**-53))))
    sizes = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(key))
    return rows.withColumn("__k", inside).join(F.broadcast(starts), "__r").withColumn(out, F.col("__k") + F.col("__b")).drop("__r", "__k", "__b")


def ordered_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` as a written table in ranges of ``order``: __part, the range, ascending, and __at, the row's place in it.

    Ranges are cut by Spark's sample of the rows and sorted in tasks, so equal keys aside no range is much larger than another. What has
    to be carried from range to range is a row each (``carry``).
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    low = F.lit((1 << 33) - 1).cast("long")
    return materialize(rows.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(low)}).drop("__id"), name)


def running_sum(parts: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to each row of ``ordered_parts``; a range's rows are summed in its task, ranges by a row each."""
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(F.sum(value).alias("__t")).select("__part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b"))
    return parts.withColumn("__s", F.sum(value).over(own)).join(F.broadcast(totals), "__part").withColumn(out, F.col("__s") + F.col("__b")).drop("__s", "__b")


def nearest_known(parts: DataFrame, value: Column, back: str, ahead: str) -> DataFrame:
    """Add ``back`` and ``ahead``: the last value that isn't null up to each row of ``ordered_parts``, and the first one from it on."""
    rows = parts.withColumn("__v", value)
    # both ways from the frame's start: Spark goes through a frame that ends with the partition anew for each row
    up, down = (Window.partitionBy("__part").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("__at"), F.desc("__at")))
    known = F.col("__v").isNotNull()
    ends = rows.groupBy("__part").agg(F.max_by("__v", F.when(known, F.col("__at"))).alias("__l"), F.min_by("__v", F.when(known, F.col("__at"))).alias("__f"))
    line = Window.orderBy("__part")
    ends = ends.select(
        "__part", F.last("__l", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__lb"), F.first("__f", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__fa")
    )
    found = rows.withColumns({"__b": F.last("__v", True).over(up), "__a": F.last("__v", True).over(down)}).join(F.broadcast(ends), "__part")
    return found.withColumns({back: F.coalesce("__b", "__lb"), ahead: F.coalesce("__a", "__fa")}).drop("__v", "__b", "__a", "__lb", "__fa")
