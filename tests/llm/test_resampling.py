import hashlib
import math
import random
import re
import zlib

import pytest

from voxlake.llm import resampling as R


def brute(rows, targets, percent=25, min_words=20, buckets=10_000):
    def features(t):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    raw, aim = [0] * buckets, [0] * buckets
    for counts, texts in ((raw, [t for _, t in rows]), (aim, targets)):
        for t in texts:
            for b in features(t)[1]:
                counts[b] += 1
    s, t = sum(raw), sum(aim)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(raw, aim)]
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(n=400, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"Word{k}" for k in range(300)] + ["é", "日本", "7", "ÀB"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60))) + rng.choice([".", "", "!?"])) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "long " * 5000), (None, "null id " * 15)], [" ".join(rng.choices(vocabulary[:60], k=40)) for _ in range(30)]


def got(spark, rows, targets, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, weight string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in targets], "text string")
    return sorted((tuple(r) for r in R.resampled(df, aim, **how).collect()), key=str)


@pytest.mark.parametrize(("percent", "bracket"), [(25, 100_000), (25, 1), (1, 3), (100, 5), (0, 5)])
def test_rows_equal_brute_force(spark, percent, bracket):
    rows, targets = rows_of()
    assert got(spark, rows, targets, percent=percent, bracket=bracket) == brute(rows, targets, percent)


def test_many_ties_are_settled_by_the_id(spark, monkeypatch):
    """All documents share a score, as their draws do."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(R, "gumbel", lambda id_col, seed=7: F.lit(5).cast("bigint"))
    rows = [(i * 7 % 1000, "same words " * 20) for i in range(1000)]
    out = got(spark, rows, ["words"], bracket=10)
    assert sorted((r[4], r[0]) for r in out if r[4]) == [(k + 1, k) for k in range(250)]


def test_rows_that_repeat_an_id_are_drawn_as_many_as_fit(spark):
    rows = [(1, "same words " * 20)] * 10
    assert sorted((r[4] is not None, r[4] or 0) for r in got(spark, rows, ["other"])) == [(False, 0)] * 8 + [(True, 1), (True, 2)]


def test_empty_tables(spark):
    assert got(spark, [], ["a"]) == []
    rows, _ = rows_of(60)
    assert got(spark, rows, []) == brute(rows, [])


@pytest.mark.parametrize("values", [[5] * 100 + [7] * 100, list(range(1000)), [3], [1, 1, 2, 2, 2, 9]])
def test_kth_largest_for_every_k(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3).cache()
    down = sorted(values, reverse=True)
    for k in {1, 2, len(values) // 2 or 1, max(1, len(values) // 2 + 1), len(values)} & set(range(1, len(values) + 1)):
        cut = down[k - 1]
        assert R.kth_largest(df, "v", k, len(values), 2) == (cut, k - sum(v > cut for v in values))
