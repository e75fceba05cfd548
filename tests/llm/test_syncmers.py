import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxlake.llm import syncmers

FOX = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in a dim room near some old river bank "


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bucket string").repartition(parts)


def anchors_by_hand(hashes, pair):
    """Anchors of a list of token hashes; pair: the hash of two neighbours."""
    g = [pair[a, b] for a, b in zip(hashes, hashes[1:])]
    w = syncmers.K - syncmers.S + 1
    return [i for i in range(len(hashes) - syncmers.K + 1) if min(g[i : i + w]) in (g[i], g[i + w - 1])]


def test_anchors_are_closed_syncmers(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randint(0, 60)}" for _ in range(400)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    got = syncmers.with_anchors(df, "t", "a").first().a
    distinct = sorted(set(words))
    h = dict(spark.createDataFrame([(w,) for w in distinct], "w string").select("w", F.xxhash64("w")).collect())
    pairs = {(h[a], h[b]) for a, b in zip(words, words[1:])}
    g = {(r.a, r.b): r.g for r in spark.createDataFrame(list(pairs), "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("g")).collect()}
    hashes = [h[w] for w in words]
    picks = anchors_by_hand(hashes, g)
    mers = spark.createDataFrame([(k, hashes[i : i + syncmers.K]) for k, i in enumerate(picks)], "k int, m array<bigint>")
    want = [r.x for r in mers.orderBy("k").select((F.xxhash64("m").bitwiseAND(F.lit(0xFFFFFFFF))).alias("x")).collect()]
    assert got == want and len(got) > 50


def test_same_passage_gives_same_anchors_in_any_text(spark):
    passage = FOX * 3
    rows = [(0, passage), (1, "some other opening, " + passage), (2, passage + " and an end")]
    a = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(table(spark, rows)).collect()}
    cut = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    assert set(cut(a[0])) <= set(cut(a[1])) and set(cut(a[0])) <= set(cut(a[2]))
    assert cut(a[1])[-len(cut(a[0])) :] == cut(a[0])


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_compared_equals_brute_force(spark, n):
    rnd = random.Random(n)
    pool = (FOX + "Ünïcödé wörds und Straße 日本語 テキスト %%% ... 12 345").split()
    texts = [" ".join(rnd.choices(pool, k=rnd.choice([0, 1, 3, 8, 9, 40, 200]))) for _ in range(n)]
    ids = rnd.sample(range(-50, 5000), n)
    rows = list(zip(ids, texts))
    if n > 7:
        rows[3] = (rows[3][0], None)
        rows[5] = (rows[5][0], rows[4][1])
        rows[6] = (rows[6][0], "x" * 50_000)
    got = {r.doc_id: r for r in syncmers.compared(table(spark, rows)).collect()}
    order = sorted(rows)
    edited = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited[i] = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
    prints = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(table(spark, rows)).collect()}
    edits = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(table(spark, list(edited.items()))).collect()}

    def like(a, b):
        a, b = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(got) == n
    for (i, t), (j, _) in zip(order, order[1:] + order[:1]):
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t or ""), prints[i], edits[i])
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(prints[i], edits[i])) and r.near_next == pytest.approx(like(prints[i], prints[j]))


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, FOX), (None, FOX), (1, FOX), (1, FOX), (1, "b"), (2, ""), (2**62, "c"), (-(2**62), None)]
    got = syncmers.compared(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert syncmers.compared(table(spark, []).filter("false")).count() == 0


def test_a_far_off_id_and_repeated_ids_leave_ranges_even(spark):
    n = 4000
    rows = spark.range(n).select(F.when(F.col("id") == 0, 2**62).when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    dealt = syncmers.ranged(rows, "text", "doc_id")
    assert dealt.filter("NOT ghost").count() == n
    most = dealt.groupBy("bucket").count().agg(F.max("count"), F.count("*")).first()
    assert most[1] >= 64 and most[0] < 5 * n / 128
    got = [r.id for r in syncmers.next_pairs(rows, "text", "doc_id").collect()]
    assert len(got) == n and got.count(77) == len([i for i in range(1, n) if i % 3 == 0]) + 1
