"""SimHash near-dedup: fingerprints that differ in at most RADIUS bits are linked.

Fingerprint: A-Z lower-cased, words are runs without blanks and U+0009..U+000D, shingles of
WORDS words joined by blanks, repeats included (a shorter text is one shingle; without words
the fingerprint is zero). A bit is set if it is set in over half the shingles' XXH64 (seed 42).

Links are searched between distinct fingerprints, so copies cost nothing. The 64 bits are cut into
RADIUS + 1 blocks; two fingerprints within RADIUS bits agree on one block at least, so they meet in
one of RADIUS + 1 tables, each dealt to shards that agree on a block. Each shard is one BK-tree
(``bk_forest``): children are keyed by their Hamming distance to the parent, and every fingerprint of
the shard is searched following only edges within the radius. Shards are counted first. Of those with
more than SHARD members the members are dealt anew, by FINE blocks of which all but RADIUS agree (28
tables for 8 blocks), so that a shard has at most 65,536 members by what is left of the 64 bits. A
shard gives one link from each fingerprint to the root of what it reaches there, not all pairs;
``components`` joins the shards' answers.

Trees aren't broadcast: that takes every fingerprint to every tree, and among random 64-bit
fingerprints a search within 2 bits visits a share of the nodes (figures in the README), so its work
grows nearly with the square of the input. Dealing brings to a tree only what can be linked to it.

Defined results: a null text counts as empty, and all texts without words share fingerprint zero;
a null id never is a component's smallest unless the component has no other; rows that repeat an id
have a result each; an empty table gives none; a very long text is read whole, in its row. Columns
other than id and text are ignored by ``near_groups`` and pass through ``keep_one``, whatever their
names (its own start with ``__dm_``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from ..operators.components import components
from . import repeats
from .bk_forest import BkForest

WORDS, SEED, RADIUS, FINE = 3, 42, 2, 8
SHARD = 1 << 14
CHUNK = 1 << 19
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: splits at blanks and U+0009..U+000D only
    if not w:
        return 0
    joined = b" ".join(w)
    k = min(words, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(w) - k + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, th, fp): fp as a signed BIGINT of the same bits, th a hash of the text that tells apart rows of one id. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", words, seed) for t in batch.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(fps, pa.int64())], ["id", "th", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, th bigint, fp bigint")


def shard_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits to agree on, as signed 64-bit integers: all but ``radius`` of the blocks."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for free in combinations(range(blocks), radius):
        mask = (1 << 64) - 1
        for b in free:
            mask &= ~((1 << ends[b + 1]) - (1 << ends[b]))
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(t, key, fp): every fingerprint once for each mask, with the bits that its shard agrees on."""
    choices = F.array(*[F.struct(F.lit(k).cast("int").alias("t"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(masks)])
    return fps.select("fp", F.inline(choices)).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that join what is connected inside each shard of ``rows`` (t, key, fp)."""

    def links(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (table[1:] != table[:-1])
        shard = np.cumsum(new) - 1
        shared = np.bincount(shard)[shard] > 1
        fp, shard = fp[shared], shard[shared]
        root = BkForest(fp.view(np.uint64), shard).components(radius)
        other = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[root[other]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key; whole shards are worked off in chunks."""
        held: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
            table, key, fp = held
            if len(fp) >= CHUNK:
                before = np.flatnonzero((key != key[-1]) | (table != table[-1]))
                cut = int(before[-1]) + 1 if len(before) else 0
                if cut:
                    yield links(table[:cut], key[:cut], fp[:cut])
                    held = [h[cut:] for h in held]
        if len(held[2]):
            yield links(*held)

    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp").select("t", "key", "fp")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def shard_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v), written, that connect what is within ``radius`` bits among the distinct fingerprints ``fps`` (fp)."""
    rows = _tables(fps, shard_masks(radius + 1, radius))
    large = materialize(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).select("t", "key"), "simhash-large")
    if large.isEmpty():
        links = materialize(_tree_links(rows, radius).distinct(), "simhash-links")
    else:
        fine = _tables(rows.join(large, ["t", "key"], "left_semi").select("fp").distinct(), shard_masks(FINE, radius))
        both = _tree_links(rows.join(large, ["t", "key"], "left_anti"), radius).union(_tree_links(fine, radius))
        links = materialize(both.distinct(), "simhash-links")
    discard(large)
    return links


def _grouped(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, th, fp, root, component_id) of every row, and the tables that it reads."""
    rows = materialize(with_fingerprints(docs, text, id_col), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    links = shard_links(classes.select("fp"))
    joined = components(links)
    linked = joined.select(F.col("u").alias("lu"), F.col("v").alias("lv"))
    roots = classes.join(linked, F.col("fp") == F.col("lu"), "left").select("fp", "rep", F.coalesce("lv", "fp").alias("root"))
    roots = materialize(roots, "simhash-roots")
    discard(classes, links, joined)
    smallest = materialize(roots.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r"), "simhash-components")
    named = roots.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    named = materialize(named, "simhash-named")
    discard(roots, smallest)
    return rows.join(named, F.col("fp") == F.col("f")).select("id", "th", "fp", "root", "component_id"), [rows, named]


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row."""
    grouped, _ = _grouped(docs, text, id_col)
    return grouped.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bytes: int = repeats.MAX_BYTES) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (of rows that repeat it, the smallest text hash).

    Which rows go is decided on fingerprints and hashes; texts of the rows that stay don't shuffle.
    """
    grouped, read = _grouped(docs, text, id_col)
    rows = materialize(grouped.select("id", "th", "root"), "simhash-groups")
    discard(*read)
    counted = rows.groupBy("root", "id", "th").agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "c"))
    sums = counted.groupBy("root").agg(best.alias("b"), F.sum("c").alias("n")).filter("n > 1")
    best = materialize(sums.select(F.col("root").alias("r"), F.col("b.id").alias("bi"), F.col("b.th").alias("bt"), F.col("b.c").alias("bc")), "simhash-best")
    stays = F.col("id").eqNullSafe(F.col("bi")) & (F.col("th") == F.col("bt"))
    lost = rows.join(best, F.col("root") == F.col("r")).filter(~stays).select("id", "th").distinct().withColumn("again", F.lit(False))
    again = best.filter("bc > 1").select(F.col("bi").alias("id"), F.col("bt").alias("th"), F.lit(True).alias("again"))
    kept = repeats.drop_marked(docs, lost.union(again), text, id_col, max_bytes)
    discard(rows, best)
    return kept
