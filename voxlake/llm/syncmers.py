"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's tokens are its runs of letters, digits and marks (at most 32 of them), single
characters of scripts written without blanks, and other visible characters. Of every K
consecutive tokens the inner substrings of S tokens are hashed; the K-mer is a closed
syncmer, and so an anchor, if the smallest of those hashes is the first or the last one.
That depends on the K tokens alone, so the same passage gives the same anchors in any text.
The fingerprint lists the anchors' 32-bit hashes in text order, 8 hex digits each. A text
without an anchor but with tokens has one for all its tokens; without tokens it has none.

Likeness of two fingerprints: their distinct anchors in common, divided by all their
distinct anchors; 1 if neither has any.

``next_pairs`` puts every row beside the following row in order of (id, hash of the text),
the last beside the first. Ids are cut at approximate quantiles into BUCKETS_PER_PARTITION ranges a
shuffle partition, so a far-off id changes nothing, and rows that share an id are dealt by the hash;
each range also gets a copy of the first row of the next range, so one shuffle of the texts suffices.
The table of first rows, which is broadcast, is as long as the number of ranges.

Defined results: a null text counts as empty, a null id is before all others, a single row is
its own next, rows that repeat an id follow one another, an empty table gives no row, a very long
text is worked on whole, in its row. Ids are integers; strings are not ordered as such (they are cast to numbers, an error where they aren't any). Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import cuts, range_number

K, S = 8, 2
TOKENS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]|[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]]{1,32}|[^\s\p{L}\p{N}\p{M}]"
BUCKETS_PER_PARTITION = 16
BEFORE_ALL = -(1 << 63) - 1


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the anchors of column ``text`` in text order, as an array of BIGINTs below 2**32."""
    inner = K - S
    tokens, inners, picks = f"{out}_h", f"{out}_g", f"{out}_i"
    df = df.withColumn(tokens, F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t)))
    n = f"size({tokens})"
    df = df.withColumn(
        inners, F.expr(f"zip_with(slice({tokens}, 1, greatest({n} - 1, 0)), slice({tokens}, 2, greatest({n} - 1, 0)), (a, b) -> xxhash64(a, b))")
    )
    df = df.withColumn(
        picks,
        F.expr(
            f"CASE WHEN {n} < {K} THEN cast(array() AS array<int>) ELSE filter(sequence(0, {n} - {K}), i -> "
            f"least({inners}[i], {inners}[i + {inner}]) <= array_min(slice({inners}, i + 2, {inner - 1}))) END"
        ),
    )
    low = "4294967295L"
    df = df.withColumn(
        out,
        F.expr(
            f"CASE WHEN {n} = 0 THEN cast(array() AS array<bigint>) WHEN size({picks}) = 0 THEN array(xxhash64({tokens}) & {low}) "
            f"ELSE transform({picks}, i -> xxhash64(slice({tokens}, i + 1, {K})) & {low}) END"
        ),
    )
    return df.drop(tokens, inners, picks)


def as_string(anchors: str) -> Column:
    return F.expr(f"lower(array_join(transform({anchors}, a -> lpad(hex(a), 8, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    return F.expr(
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE cast(size(array_intersect({a}, {b})) AS double) / size(array_union({a}, {b})) END"
    )


def ranged(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, t, place, tie, ghost, bucket): all rows by ranges of (id, hash of the text), and a copy of each range's first row for the range before it."""
    place = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(BEFORE_ALL)).cast("decimal(20,0)"))
    at = cuts(docs, place, max(1, BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), place.alias("place"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    share = F.least(F.col("tie") / F.lit(2.0**64) + 0.5, F.lit(1 - 2.0**-53))  # in order of the hash
    rows = rows.withColumn("bucket", range_number(F.col("place"), at, share))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("f"))
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole))
    firsts = firsts.select(F.col("f.place").alias("first_place"), F.col("f.tie").alias("first_tie"), before.alias("before"))
    marked = rows.join(F.broadcast(firsts), (F.col("place") == F.col("first_place")) & (F.col("tie") == F.col("first_tie")), "left")
    spots = F.expr("filter(array(named_struct('bucket', bucket, 'ghost', false), named_struct('bucket', before, 'ghost', true)), x -> x.bucket IS NOT NULL)")
    return marked.select("id", "t", "place", "tie", F.inline(spots))


def next_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, t, next_t, anchors, next_anchors) of every row."""
    rows = with_anchors(ranged(docs, text, id_col), "t", "anchors")
    order = Window.partitionBy("bucket").orderBy("ghost", "place", "tie")
    paired = rows.withColumns({"next_t": F.lead("t").over(order), "next_anchors": F.lead("anchors").over(order)})
    return paired.filter("NOT ghost").select("id", "t", "next_t", "anchors", "next_anchors")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_chars and fingerprint of every row; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return with_anchors(rows, "t", "a").select(F.col("id").alias(id_col), F.length("t").cast("long").alias("n_chars"), as_string("a").alias("fingerprint"))


def compared(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of the text whose second half is replaced by the start of the next, and their likeness."""
    pairs = next_pairs(docs, text, id_col).withColumn("n", F.length("t"))
    edited = F.expr("concat(substring(t, 1, n - n div 2), substring(next_t, 1, cast(n div 2 AS int)))")
    rows = with_anchors(pairs.withColumn("edited", edited), "edited", "edited_anchors")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("anchors").alias("fingerprint"), as_string("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"),
    )
