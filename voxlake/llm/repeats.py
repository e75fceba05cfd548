"""Bloom filters built, broadcast and asked with built-in functions only.

A filter is a row of 64-bit words; a key sets two bits of one word. ``times`` is how often a
bit has to be set to count: with 1 it is the once-seen filter, with 2 the twice-seen one, in
which all bits of a key that occurs twice are set (no false negatives), so keys that fail it
are unique. Building it shuffles cell numbers, summed in each task first, so that a key of
a third of all rows costs a task one row. Words are packed into pages, arrays of at most
PAGE_WORDS words; the broadcast table has one row a page, and a key is asked by one look into an array.

Size: CELLS_PER_KEY bits a key, so that about 2 % of unique keys pass, whatever the input. One
filter takes at most ``max_bytes``, whatever the number of keys. More keys than that are worked off in ranges
of their hash, one filter and one pass each (``suspects``): the keys are sorted by range in the tasks that hold
them, so a pass reads its own part of each file, and all passes together read the keys once. One job builds the
filters of all ranges; AT_ONCE passes run side by side, so that many are broadcast at a time.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize, reread, scratch_path

CELLS_PER_KEY = 16
PAGE_BITS = 12
PAGE_WORDS = 1 << PAGE_BITS
MAX_BYTES = 1 << 26
AT_ONCE = 4
#: Bits of a hash: 0-39 word, 40-45 and 46-51 the two bits; the range is drawn from a hash of the hash.
_WORD_BITS = 40


@dataclass(frozen=True)
class Layout:
    """Words of each filter and the number of ranges that have one each."""

    words: int
    ranges: int = 1


def layout(n_keys: int, max_bytes: int = MAX_BYTES) -> Layout:
    words = max(64, -(-CELLS_PER_KEY * n_keys // 64))
    ranges = -(-words * 8 // max_bytes)
    return Layout(-(-words // ranges), ranges)


def one_filter(n_keys: int, max_bytes: int = MAX_BYTES) -> Layout:
    """One filter of at most ``max_bytes``; with more keys than it is meant for more rows pass it."""
    return Layout(min(layout(n_keys, max_bytes=1 << 62).words, max_bytes // 8))


def _range(h: Column, lay: Layout) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(lay.ranges).cast("long"))


def _word(h: Column, lay: Layout) -> Column:
    return h.bitwiseAND(F.lit((1 << _WORD_BITS) - 1).cast("long")) % F.lit(lay.words).cast("long")


def _bits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63).cast("long")) for s in (_WORD_BITS, _WORD_BITS + 6)]


def build(keys: DataFrame, h: str, lay: Layout, times: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(page, words): the filter over BIGINT column ``h``; pages and trailing words without a bit are left out. With ``by`` one filter for each value of those columns."""
    k = F.col(h)
    cells = keys.select(*by, F.explode(F.array_distinct(F.array(*[F.shiftleft(_word(k, lay), 6) + b for b in _bits(k)]))).alias("cell"))
    if times == 1:
        cells = cells.distinct()
    else:
        cells = cells.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)
    words = cells.groupBy(*by, F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS INT))")).alias("bits"))
    place = F.struct((F.col("word") % PAGE_WORDS).cast("int").alias("at"), "bits")
    pages = words.groupBy(*by, F.shiftright("word", PAGE_BITS).alias("page")).agg(F.sort_array(F.collect_list(place)).alias("set"))
    filled = "flatten(transform(set, (x, i) -> concat(array_repeat(0L, x.at - if(i = 0, -1, set[i - 1].at) - 1), array(x.bits))))"
    return pages.select(*by, "page", F.expr(filled).alias("words"))


def with_hits(rows: DataFrame, h: str, pages: DataFrame, lay: Layout, out: str = "suspect") -> DataFrame:
    """Add boolean ``out``: false if no key of the filter (none that was set as often as it asks) is ``h``."""
    k = F.col(h)
    b1, b2 = [F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) for b in _bits(k)]
    mask = b1.bitwiseOR(b2)
    # at most max_bytes in all, by the layout
    flt = F.broadcast(pages.select(F.col("page").alias("__page"), F.col("words").alias("__words")))
    word = _word(k, lay)
    joined = rows.join(flt, F.shiftright(word, PAGE_BITS) == F.col("__page"), "left")
    got = F.get("__words", (word % PAGE_WORDS).cast("int"))
    return joined.withColumn(out, F.coalesce(got.bitwiseAND(mask) == mask, F.lit(False))).drop("__page", "__words")


def suspects(keys: DataFrame, h: str, name: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """``keys`` (a plain table) with boolean ``suspect``, false if ``h`` surely occurs once; and the tables that it reads."""
    lay = layout(keys.count(), max_bytes)
    if lay.ranges == 1:
        pages = materialize(build(keys, h, lay, 2), f"{name}-filter")
        return with_hits(keys, h, pages, lay), [pages]
    dealt = materialize(keys.withColumn("__range", _range(F.col(h), lay)).sortWithinPartitions("__range"), f"{name}-dealt")
    filters = materialize(build(dealt, h, lay, 2, ("__range",)).sortWithinPartitions("__range"), f"{name}-filters")
    path = scratch_path(keys.sparkSession, f"{name}-tested")

    def ask(r: int) -> None:
        own, pages = (t.filter(F.col("__range") == r).drop("__range") for t in (dealt, filters))
        with_hits(own, h, pages, lay).write.parquet(f"{path}/range_of_h={r}")

    with ThreadPoolExecutor(AT_ONCE) as passes:
        list(passes.map(ask, range(lay.ranges)))
    discard(dealt, filters)
    table = reread(keys.sparkSession, path, keys.withColumn("suspect", F.lit(True)).schema)
    return table.drop("range_of_h"), [table]


def drop_marked(docs: DataFrame, marks: DataFrame, text: str, id_col: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without the rows that ``marks`` (id, th, again) names by id and hash of the text; of rows marked ``again`` one stays.

    Rows that miss a filter of the marks pass straight through; only those that hit it shuffle and meet the marks. The
    filter takes at most ``max_bytes``, enough for half as many marks; beyond, more rows shuffle, up to all.
    """
    marks = materialize(marks, "marks")
    n, n_again = marks.agg(F.count(F.lit(1)), F.count_if("again")).first()
    if not n:
        discard(marks)
        return docs
    lay = one_filter(n, max_bytes)
    pages = materialize(build(marks.select(F.xxhash64("id", "th").alias("h")), "h", lay, 1), "marks-filter")
    marked = docs.withColumn("__dm_th", F.xxhash64(F.col(text))).withColumn("__dm_h", F.xxhash64(F.col(id_col), "__dm_th"))
    tested = with_hits(marked, "__dm_h", pages, lay, "__dm_hit")
    names = marks.select(F.col("id").alias("__dm_id"), F.col("th").alias("__dm_mark"), F.col("again").alias("__dm_again"))
    on = (F.col("__dm_th") == F.col("__dm_mark")) & F.col(id_col).eqNullSafe(F.col("__dm_id"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hits = tested.filter("__dm_hit")
    kept = tested.filter("NOT __dm_hit").select(cols).union(hits.join(names, on, "left_anti").select(cols))
    if not n_again:
        return kept
    again = hits.join(names.filter("__dm_again"), on, "left_semi")
    return kept.union(again.dropDuplicates([id_col, "__dm_th"]).select(cols))
