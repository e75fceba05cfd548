"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when they are identical after deleting blanks and the characters
U+0009 to U+000D. Of equal texts the row with the most code points in its original
text stays, then the one with the smallest id.

Texts are read once for their SHA-256. Pass one builds the twice-seen filter of the hashes,
pass two asks it; only rows that it names shuffle, to be confirmed by the SHA-256
(``repeats``). ``drop_duplicates`` then reads the texts again, and those of rows that stay pass
straight through.

Defined results: a null text counts as empty, and all empty texts are one group;
a null id sorts before all others; rows that repeat id and text are one document
(``decisions`` gives them the same decision, ``drop_duplicates`` returns one of
them); an empty table gives an empty table; a very long text is hashed whole, in its row;
columns of the input pass through, whatever their names (the operator's own temporary
columns start with ``__xd_`` or ``__dm_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from . import repeats

BLANKS = "[\\x20\\x09-\\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _keys(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, th, n, key, h) of every row, written: hash of the text as it is, code points, SHA-256 of the normalized text and a hash of that."""
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(normalized(F.col(text)).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.length(t).cast("long").alias("n"), key.alias("key"))
    return materialize(rows.withColumn("h", F.xxhash64("key")), "exact-keys")


def _groups(suspects: DataFrame) -> DataFrame:
    """(gkey, size, keep, keep_n, keep_th, keep_c) of every key that occurs more than once, written: exact confirmation of the suspects.

    Rows are counted per document before they meet per key, so a group that holds a
    third of all rows is summed in every task and no task gets more than its partial sums.
    """
    rows = suspects.groupBy("key", "id", "n", "th").agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "id", "th", "c"))
    sums = rows.groupBy("key").agg(F.sum("c").alias("size"), best.alias("b")).filter("size > 1")
    return materialize(
        sums.select(
            F.col("key").alias("gkey"), "size", F.col("b.id").alias("keep"), (-F.col("b.neg")).alias("keep_n"), F.col("b.th").alias("keep_th"), F.col("b.c").alias("keep_c")
        ),
        "exact-groups",
    )


def decisions(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bytes: int = repeats.MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. Texts are read once and never shuffle."""
    tested, _ = repeats.suspects(_keys(docs, text, id_col), "h", "exact", max_bytes)
    sha = F.lower(F.hex("key")).alias("text_sha256")
    unique = tested.filter("NOT suspect").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    suspects = tested.filter("suspect")
    grouped = suspects.join(_groups(suspects), F.col("key") == F.col("gkey"), "left")
    alone = F.col("size").isNull()
    stays = alone | (F.col("keep").eqNullSafe(F.col("id")) & (F.col("n") == F.col("keep_n")))
    return unique.unionByName(
        grouped.select(
            F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
            stays.alias("kept"), sha,
        )
    )


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bytes: int = repeats.MAX_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts. Which rows go is decided on hashes; texts of the rows that stay don't shuffle."""
    keys = _keys(docs, text, id_col)
    tested, read = repeats.suspects(keys, "h", "exact", max_bytes)
    suspects = tested.filter("suspect")
    groups = _groups(suspects)
    stays = F.col("keep").eqNullSafe(F.col("id")) & (F.col("th") == F.col("keep_th"))
    lost = suspects.join(groups, F.col("key") == F.col("gkey")).filter(~stays).select("id", "th").distinct().withColumn("again", F.lit(False))
    again = groups.filter("keep_c > 1").select(F.col("keep").alias("id"), F.col("keep_th").alias("th"), F.lit(True).alias("again"))
    kept = repeats.drop_marked(docs, lost.union(again), text, id_col, max_bytes)
    discard(keys, groups, *read)
    return kept
