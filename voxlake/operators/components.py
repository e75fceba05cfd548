"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node u of ``edges`` (u, v) that isn't its component's smallest node, with that node as v.

    Nodes are BIGINT. Each step replaces edges by edges to the smallest neighbour; the minima
    are formed by partial sums and written, so the join that hands them out reads two plain
    tables and can split a node with many edges. Every step is written to the shared folder.
    """
    e = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = _state(e)
    if not before[0]:
        return e
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "cc-minima")
        large = both.filter("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        discard(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"), "cc-minima")
        small = large.join(low, F.col("u") == F.col("x")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = materialize(small.union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "cc-small")
        discard(last, large, low)
        now = _state(e)
        if now == before:
            return e
        before = now
