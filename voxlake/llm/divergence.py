"""Divergence audit of sources: how far the term distributions of the sources of a language lie from one another and from the language.

Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII. Each language keeps the terms found in at least
``min_docs`` of its documents. A group (language, source) gives a kept term the smoothed price
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), where N is its count of kept terms and V the number of them.

Counting: tasks sum (language, source, term) in bounded tables before anything shuffles, so a source of a third of all
rows costs a task one row a term. Term ids: a language's terms are dealt by a hash to blocks of about BLOCK, and
inside a block numbered by falling count, so that rare terms, absent from most groups, lie together.

Two groups are compared by hash-consed segment trees over the term ids of a block. Trees of all groups that meet in a task are
built level by level, and equal pairs of children get one node, so equal count subtrees of any groups and places share
theirs. Then pairs of trees are gone through from the roots down at the same time: the pairs of nodes of a level are kept once for
each pair of groups, with the number of times they stand there, so equal pairs are priced once; at the leaves a
pair of counts is priced |p - q| and multiplied. A task's rows are one block of two tiles of at most TILE groups, so
its size is bounded; the blocks' sums are added by Spark.

All arithmetic is exact: prices are computed with decimals of 38 digits or Python integers (counts below 10^28), sums of prices are 64-bit.

Defined results: null text, language and source count as ''; rows that repeat an id are documents of their own; a group whose texts have no
kept term has N = 0 and takes part in pairs; a language without kept terms has value 0 for every pair and no term; equal values are ranked by
the item's UTF-8 bytes; an empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import discard, materialize

MIN_DOCS = 30
TOP = 50
PRIOR = 5
SCALE = 1_000_000_000
BLOCK = 4096
TILE = 32
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A task passes its sums on when it holds so many terms.
_HELD = 600_000
#: Pairs of nodes of one level are worked off for so many pairs of groups at once.
_PAIRS = 64


def summed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (lang, source, text), a row for each term of a group until _HELD terms are held. Terms are counted a document at once."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    size = 0

    def drain() -> pa.RecordBatch:
        columns: list[list[pa.Array]] = [[pa.array([], k)] for k in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())]
        for (a, b), (n, docs) in held.items():
            counts = [pa.array(np.fromiter(c, np.int64, len(n))) for c in (n.values(), map(docs.__getitem__, n))]
            for column, part in zip(columns, (pa.repeat(a, len(n)), pa.repeat(b, len(n)), pa.array(list(n), pa.binary()).cast(pa.string()), *counts), strict=True):
                column.append(part)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for a, b, t in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            words = _TERM.findall(t.encode().lower())
            if (a, b) not in held:
                held[a, b] = Counter(), Counter()
            n, docs = held[a, b]
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > _HELD:
                yield drain()
                held.clear()
                size = 0
    yield drain()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs) summed over all documents, and (lang, source) of every group."""

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "t"))]
    rows = docs.select(*plain).mapInArrow(summed_terms, "lang string, source string, term string, n bigint, docs bigint")
    sums = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return materialize(sums, "terms"), materialize(docs.select(*plain[:2]).distinct(), "term-groups")


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR terms)), exact."""
    above = (n.cast("decimal(28,0)") + PRIOR) * F.lit(SCALE)
    below = total.cast("decimal(28,0)") + terms.cast("decimal(20,0)") * PRIOR
    return (F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1).cast("bigint")


def cons(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hash-consed trees over the rows of counts (a power of two long): (root of each row, children (left, right) of the nodes of each level from the leaves up, count of each leaf).

    Nodes of a level are numbered; two subtrees with equal counts, in whichever rows or places, have one number.
    """
    leaves, ids = np.unique(rows, return_inverse=True)
    ids = ids.reshape(rows.shape)
    levels = []
    while ids.shape[1] > 1:
        pairs = ids[:, 0::2] * (int(ids.max()) + 1) + ids[:, 1::2]
        width = int(ids.max()) + 1
        nodes, up = np.unique(pairs, return_inverse=True)
        levels.append(np.stack([nodes // width, nodes % width], 1))
        ids = up.reshape(pairs.shape)
    return ids[:, 0], levels, leaves


def compare(roots: np.ndarray, levels: list[np.ndarray], leaves: np.ndarray, prices: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """The sum of |p - q| over the leaves of each pair of trees; ``prices``: for each tree the price of every leaf."""
    out = []
    for first in range(0, len(pairs), _PAIRS):
        some = pairs[first : first + _PAIRS]
        who = np.arange(len(some))
        a, b = roots[[i for i, _ in some]], roots[[j for _, j in some]]
        times = np.ones(len(some), np.int64)
        for level in reversed(levels):
            who, times = np.tile(who, 2), np.tile(times, 2)
            a, b = np.concatenate([level[a, 0], level[a, 1]]), np.concatenate([level[b, 0], level[b, 1]])
            width = max(int(a.max()), int(b.max())) + 1
            _, at, back = np.unique((who * width + a) * width + b, return_index=True, return_inverse=True)
            times = np.bincount(back, weights=times).astype(np.int64)  # exact: no more than a block's terms
            who, a, b = who[at], a[at], b[at]
        table = np.stack(prices)
        left, right = np.array([i for i, _ in some]), np.array([j for _, j in some])
        cost = np.abs(table[left[who], a] - table[right[who], b]) * times
        sums = np.zeros(len(some), np.int64)
        np.add.at(sums, who, cost)
        out += sums.tolist()
    return out


def _block_costs(table: pa.Table) -> pa.Table:
    """(lang, a, b, cost) of the pairs of groups of two tiles in one block of terms: a row of ``table`` is a group with its counts there."""
    groups = sorted(table.to_pylist(), key=lambda g: g["source"])  # rows come in any order: a pair has one form in all blocks
    one, other, width = (groups[0][k] for k in ("one", "other", "width"))
    size = 1 << max(0, width - 1).bit_length()
    rows = np.zeros((len(groups), size), np.int64)
    for k, g in enumerate(groups):
        if g["at"]:
            rows[k, g["at"]] = g["n"]
    roots, levels, leaves = cons(rows)
    prices = []
    for g in groups:
        below = g["total"] + PRIOR * g["terms"]
        prices.append(np.array([1 + SCALE * (c + PRIOR) // below for c in leaves.tolist()], np.int64))
    if one == other:
        pairs = [(i, j) for i in range(len(groups)) for j in range(i)]
    else:
        pairs = [(i, j) for i, g in enumerate(groups) if g["tile"] == one for j, h in enumerate(groups) if h["tile"] == other]
    got = compare(roots, levels, leaves, prices, pairs)
    if size > width:  # what fills the trees up to a power of two is a count of 0 in all of them
        zero = int(np.searchsorted(leaves, 0))
        got = [c - (size - width) * abs(int(prices[i][zero]) - int(prices[j][zero])) for c, (i, j) in zip(got, pairs, strict=True)]
    name = lambda k: pa.array([groups[p[k]]["source"] for p in pairs], pa.string())
    lang = pa.array([groups[0]["lang"]] * len(pairs), pa.string())
    return pa.Table.from_arrays([lang, name(0), name(1), pa.array(got, pa.int64())], ["lang", "a", "b", "cost"])


def kept_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of kept terms (lang, term, lang_n), of their counts (lang, source, term, n), and of groups (lang, source, total, terms, lang_total)."""
    sums, groups = term_counts(docs, text, lang, source)
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).drop("d")
    kept = materialize(kept, "kept-terms")
    counts = materialize(sums.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("bigint")
    full = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    full = materialize(full, "group-totals")
    discard(sums, groups)
    return kept, counts, full


def pair_costs(kept: DataFrame, counts: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    numbered = groups.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)  # a row for each source
    numbered = numbered.withColumn("tile", F.expr(f"CAST(k DIV {tile} AS INT)"))
    terms = kept.join(groups.groupBy("lang").agg(F.max("terms").alias("terms")), "lang")
    terms = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / block)).cast("bigint"))
    place = Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")
    ids = materialize(terms.withColumn("id", F.row_number().over(place) - 1).select("lang", "term", "block", "id"), "term-ids")
    blocks = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    cells = counts.join(ids, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.collect_list(F.struct("id", "n")).alias("cells"))  # no more than a block's terms
    tiles = numbered.select("lang", "tile").distinct()
    partner = tiles.select("lang", F.col("tile").alias("t2"))
    rows = numbered.join(blocks, "lang").join(cells, ["lang", "source", "block"], "left").join(partner, "lang")
    rows = rows.select(
        "lang", "source", "tile", "total", "terms", "block", "width", F.col("cells.id").alias("at"), F.col("cells.n").alias("n"),
        F.greatest("tile", "t2").alias("one"), F.least("tile", "t2").alias("other"),
    )
    costs = rows.groupBy("lang", "block", "one", "other").applyInArrow(_block_costs, "lang string, a string, b string, cost bigint")
    sums = costs.groupBy("lang", "a", "b").agg(F.sum("cost").alias("cost"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "cost")
    priced = both.select("lang", "p.source", "p.item", F.col("cost").alias("value"))
    # languages without a kept term have no block
    bare = groups.filter("terms = 0").select("lang", "source")
    other = bare.select(F.col("lang").alias("l"), F.col("source").alias("item"))
    flat = bare.join(other, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item"))).select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    return priced.unionByName(flat)


def excess_terms(kept: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every kept term that a group has and prices above its language."""
    rows = counts.join(kept, ["lang", "term"]).join(groups, ["lang", "source"])
    p, q = price(F.col("n"), F.col("total"), F.col("terms")), price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the ``top`` terms of each group."""
    kept, counts, groups = kept_counts(docs, text, lang, source, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    pairs = ranked(pair_costs(kept, counts, groups, block, tile)).withColumn("part", F.lit("pair"))
    terms = ranked(excess_terms(kept, counts, groups)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
