import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxlake.functions import scratch
from voxlake.llm import exact_dedup, repeats


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i))
    out = []
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[k])[2]
        out.append((i, keep, len(groups[k]), keep == i, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = (
    [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(200)]
    + [(1000 + i, "hot  copy") for i in range(300)]
    + [(2000, None), (2001, ""), (2002, " \t\n\x0b\x0c\r "), (2003, "a b"), (2004, "ab"), (2005, "x" * 100_000), (None, "null id"), (2006, "null id"), (1, "text 1 ")]
)


@pytest.mark.parametrize("max_bytes", [repeats.MAX_BYTES, 512])
def test_decisions_equal_brute_force(spark, max_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("kept", F.lit("clash")).repartition(6)
    got = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.decisions(docs, max_bytes=max_bytes).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_drop_duplicates_keeps_one_row_of_each_group(spark):
    docs = spark.createDataFrame(ROWS + ROWS[:40], "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("Word", F.lit(2)).repartition(6)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in got.collect()), key=str)
    assert kept == sorted({keep for _, keep, *_ in brute(ROWS)}, key=str)


def test_an_id_with_texts_equal_but_for_blanks_stays_once(spark):
    rows = [(7, "a b"), (7, "a  b"), (7, "ab"), (9, "a  b"), (7, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [tuple(r) for r in exact_dedup.drop_duplicates(docs).collect()] == [(7, "a  b")]
    got = [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.decisions(docs).collect() if r.kept]
    assert got == [(7, 7, 5)] * 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.decisions(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(20000).select(F.xxhash64(F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id"))).alias("k"), (F.col("id") < 2000).alias("twice"))
    lay = repeats.layout(20000)
    tested = repeats.with_hits(keys, "k", repeats.build(keys, "k", lay, 2), lay)
    n = {(r.twice, r.suspect): r["count"] for r in tested.groupBy("twice", "suspect").count().collect()}
    assert (True, False) not in n
    assert n.get((False, True), 0) < 0.05 * 18000


def test_64_times_the_keys_of_a_full_filter_go_in_ranges(spark):
    """At most 5 % of the unique keys are suspects, at any number of keys."""
    n, max_bytes = 1 << 18, (1 << 12) * repeats.CELLS_PER_KEY // 8
    keys = spark.range(n).select(F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id")).alias("i"), (F.col("id") < 2000).alias("twice"))
    keys = scratch.materialize(keys.withColumn("h", F.xxhash64("i")), "keys")
    assert repeats.layout(n, max_bytes).ranges == 64
    tested, _ = repeats.suspects(keys, "h", "test", max_bytes)
    got = {(r.twice, r.suspect): r["count"] for r in tested.groupBy("twice", "suspect").count().collect()}
    assert (True, False) not in got and sum(got.values()) == n
    assert got.get((False, True), 0) <= 0.05 * n


@pytest.mark.parametrize("n", [0, 1, 10**6, 10**9, 10**12, 10**14])
def test_no_number_of_keys_makes_a_filter_larger(n):
    lay = repeats.layout(n)
    assert lay.words * 8 <= repeats.MAX_BYTES and lay.words * lay.ranges * 64 >= repeats.CELLS_PER_KEY * n


def test_filters_of_ranges_are_those_of_each_range_alone(spark):
    lay = repeats.Layout(9000, 3)
    keys = spark.range(6000).select((F.col("id") % 3).alias("part"), F.xxhash64(F.col("id") % 5000).alias("h"))
    keys = keys.union(spark.range(4000).select(F.lit(0).cast("bigint"), F.xxhash64(F.lit(7)))).repartition(5)
    whole = sorted(tuple(r) for r in repeats.build(keys, "h", lay, 2, ("part",)).collect())
    alone = [(p, *r) for p in range(3) for r in repeats.build(keys.filter(F.col("part") == p), "h", lay, 2).collect()]
    assert whole == sorted(alone) and len({r[0] for r in whole}) == 3


@pytest.mark.parametrize("max_bytes", [repeats.MAX_BYTES, 64])
def test_marked_rows_go(spark, max_bytes):
    rows = [(i % 50 if i % 7 else None, f"t{i % 90}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, th int").repartition(5)
    named = [(i, t, k % 3 == 0) for k, (i, t) in enumerate(sorted(set(rows), key=str)) if k % 2]
    marks = spark.createDataFrame(named, "id bigint, t string, again boolean").select("id", F.xxhash64("t").alias("th"), "again")
    got = repeats.drop_marked(docs, marks, "text", "doc_id", max_bytes)
    assert got.columns == docs.columns
    kinds = {(i, t): again for i, t, again in named}
    want = [r for r in rows if r not in kinds] + [r for r, again in kinds.items() if again]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
