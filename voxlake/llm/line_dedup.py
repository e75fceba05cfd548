"""Line dedup across documents with two Bloom filters.

A line's key is the line without blanks and U+0009..U+000D at its ends, A-Z lower-cased.
A key of at least MIN_CHARS code points that is found in at least MIN_DOCS documents loses
all its lines except those of the document with the largest id that holds it.

Each document's distinct keys are hashed to 128 bits once. Pass one sets the cells of a
once-seen filter, and of a twice-seen filter where a cell was set before (``repeats``).
Only keys whose cells are all in the twice-seen filter shuffle: they are counted exactly by
their 128 bits and the holder is chosen. Counts and maxima are formed in every task first,
so a line that a third of all documents share costs one row a task.

Then the texts are read again. As long as the repeated keys take at most ``max_bytes`` (KEY_BYTES
each, counted before), every task gets them and no text shuffles. Beyond, only documents that
lose lines shuffle, to meet their lost keys: they hit a filter of those documents, which
takes at most ``max_bytes`` too; the others pass straight through.

Defined results: a null or empty text is one empty line; every row is a document, also rows
that repeat an id (all rows of the largest id keep the line); a null id is smaller than any
other, and a key held by null ids only stays; all lines of one key in one document count
once and stay or go together; an empty table gives no row; a very long text or line is worked
on whole, in its row. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from . import repeats

MIN_CHARS = 20
MIN_DOCS = 3
KEY_BYTES = 32
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None where the key is too short to count."""
    out = []
    for line in text.split("\n"):
        key = line.strip(BLANKS)
        out.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None)
    return out


def _rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id, th and t of every row; id and th, a hash of the text, tell apart documents whose lines fare differently."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))


def _keys(docs: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """(id, th, key) of every distinct key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(line_keys(t or "", min_chars)) - {None} for t in batch.column("t").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            keys = pa.array([k for x in found for k in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("th").take(row), keys], ["id", "th", "key"])

    return _rows(docs, text, id_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, th bigint, key binary")


class RepeatedKeys:
    """Repeated keys and their holders as sorted arrays."""

    def __init__(self, table: pa.Table):
        halves = np.frombuffer(b"".join(table.column("k").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.high, self.low = np.ascontiguousarray(halves[order, 0]), np.ascontiguousarray(halves[order, 1])
        self.holder = table.column("holder").combine_chunks().take(pa.array(order))

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Where each key stands, -1 if it isn't repeated."""
        halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
        at, end = np.searchsorted(self.high, halves[:, 0], "left"), np.searchsorted(self.high, halves[:, 0], "right")
        out = np.full(len(keys), -1)
        while len(todo := np.flatnonzero(at < end)):
            hit = todo[self.low[at[todo]] == halves[todo, 1]]
            out[hit] = at[hit]
            at[todo] += 1
        return out


def _lost_marks(ids: pa.Array, keys: list[list[bytes | None]], repeated: RepeatedKeys) -> list[set[bytes]]:
    """For each document the keys whose lines it loses: repeated ones that another document holds."""
    distinct = [list(set(x) - {None}) for x in keys]
    flat = [k for x in distinct for k in x]
    doc = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct])
    at = repeated.places(flat)
    hit = np.flatnonzero(at >= 0)
    out: list[set[bytes]] = [set() for _ in distinct]
    if len(hit):
        own = pc.fill_null(pc.equal(ids.take(pa.array(doc[hit])), repeated.holder.take(pa.array(at[hit]))), False)
        for k, mine in zip(hit.tolist(), own.to_pylist(), strict=True):
            if not mine:
                out[doc[k]].add(flat[k])
    return out


def _without(ids: pa.Array, texts: list[str], keys: list[list[bytes | None]], gone: list[set[bytes]], id_col: str) -> pa.RecordBatch:
    kept_texts, lines, dropped = [], [], []
    for t, ks, out in zip(texts, keys, gone, strict=True):
        kept = t
        n_kept = len(ks)
        if out:
            parts = [x for x, k in zip(t.split("\n"), ks, strict=True) if k not in out]
            kept, n_kept = "\n".join(parts), len(parts)
        kept_texts.append(kept)
        lines.append(len(ks))
        dropped.append(len(ks) - n_kept)
    return pa.RecordBatch.from_arrays([ids, pa.array(kept_texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [id_col, "kept_text", "n_lines", "n_dropped"])


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    max_bytes: int = repeats.MAX_BYTES,
) -> DataFrame:
    """id, kept_text, n_lines (before dropping) and n_dropped of every row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, kept_text string, n_lines bigint, n_dropped bigint"
    keys = materialize(_keys(docs, text, id_col, min_chars).withColumn("h", F.xxhash64("key")), "line-keys")
    tested, read = repeats.suspects(keys, "h", "line", max_bytes)
    suspects = tested.filter("suspect").select("id", "th", "key")
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("holder")).filter((F.col("n") >= min_docs) & F.col("holder").isNotNull())
    repeated = materialize(repeated.select(F.col("key").alias("k"), "holder"), "line-repeats")

    if repeated.count() * KEY_BYTES <= max_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(RepeatedKeys(repeated.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column("t").to_pylist()]
                found = [line_keys(t, min_chars) for t in texts]
                yield _without(batch.column("id"), texts, found, _lost_marks(batch.column("id"), found, shared.value), id_col)

        discard(keys, repeated, *read)
        return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)

    lost = suspects.join(repeated, F.col("key") == F.col("k")).filter(~F.col("id").eqNullSafe(F.col("holder")))
    lost = materialize(lost.groupBy("id", "th").agg(F.collect_set("key").alias("lost")), "line-losses")  # no more than one text's lines
    lay = repeats.one_filter(lost.count(), max_bytes)
    pages = materialize(repeats.build(lost.select(F.xxhash64("id", "th").alias("h")), "h", lay, 1), "line-losers")
    discard(keys, repeated, *read)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            gone = [set(x or ()) for x in batch.column("lost").to_pylist()]
            found = [line_keys(t, min_chars) if x else [None] * (t.count("\n") + 1) for t, x in zip(texts, gone, strict=True)]
            yield _without(batch.column("id"), texts, found, gone, id_col)

    rows = repeats.with_hits(_rows(docs, text, id_col).withColumn("d", F.xxhash64("id", "th")), "d", pages, lay, "hit")
    theirs = lost.select(F.col("id").alias("i"), F.col("th").alias("h"), "lost")
    hits = rows.filter("hit").join(theirs, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left").select("id", "t", "lost")
    past = rows.filter("NOT hit").select("id", "t", F.lit(None).cast("array<binary>").alias("lost"))
    return past.union(hits).mapInArrow(run_joined, schema)
