import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import suffix_dedup as S


def brute(rows, size, keep="none"):
    """(id, removed spans, kept) by looking every window up; documents in the order of id, then text key."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count, first = Counter(), {}
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    for k in order:
        t = texts[k][1]
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            count[w] += 1
            first.setdefault(w, (k, p))
    out = []
    for k, (i, t) in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            if count[w] > 1 and (keep == "none" or first[w] != (k, p)):
                gone[p : p + size] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, int(gone.sum()), int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), kept))
    return out


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"word{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (20, 30, 60, 90)]
    rows = []
    for i in range(120):
        t = words(rng, rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, len(t) + 1)
            t = t[:cut] + p + t[cut:]
        rows.append((i, t))
    base = words(rng, 150)
    near = [(200 + i, base.replace("word1", f"edit{i}", 3)) for i in range(25)]
    odd = [(300, None), (301, ""), (302, "x" * 3000), (303, "y" * 170), (304, "ab" * 400), (305, "ab" * 300 + "c"), (306, "short"), (307, passages[3]), (308, passages[3]), (309, "é" * 500), (310, "=" * 5000 + base)]
    return rows + near + odd


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, k1 string, n int").repartition(5)
    out = S.drop_repeats(df, **how).collect()
    return sorted((r.doc_id, sum(x.b - x.a for x in r.removed), len(r.removed), bytes(r.kept), r.n_bytes) for r in out)


def want(rows, size, keep="none"):
    texts = {i: len((t or "").encode()) for i, t in rows}
    return sorted((*r, texts[r[0]]) for r in brute(rows, size, keep))


@pytest.mark.parametrize(("size", "keep", "limit", "piece"), [(150, "none", 2000, 16), (150, "first", 2000, 16), (150, "none", 3, 16), (150, "first", 3, 16), (129, "none", 1, 4), (400, "none", 2000, 16)])
def test_rows_equal_brute_force(spark, size, keep, limit, piece):
    rows = corpus(size + limit)
    assert got(spark, rows, min_bytes=size, keep=keep, limit=limit, piece=piece) == want(rows, size, keep)


def test_long_texts_are_cut_into_parts_that_lose_nothing():
    rng = random.Random(5)
    shared = words(rng, 300)
    rows = [(1, words(rng, 200) + shared + words(rng, 100)), (2, shared), (3, words(rng, 50) + shared[200:900])]
    texts = [t.encode() for _, t in rows]
    cut = S.parts([len(t) for t in texts], 150, 500)
    assert Counter((k, w) for group in cut for k, s, e in group for w in range(s, e - 149)) == Counter((k, w) for k, t in enumerate(texts) for w in range(len(t) - 149))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.integers(8, 12))
def test_longest_previous_factors(strings, depth):
    """Against the definition, over a small alphabet with long repeats."""
    data = b"".join(strings) * 2 + bytes(depth)
    a = np.frombuffer(data, np.uint8)
    windows = np.arange(len(data) - depth + 1)
    order, common = S.window_order(a, windows, depth)
    assert [data[i : i + depth] for i in order] == sorted(data[i : i + depth] for i in windows)
    factor = np.empty(len(windows), int)
    factor[order] = S.longest_previous(order, common)

    def shared(i, j):
        n = 0
        while n < depth and data[i + n] == data[j + n]:
            n += 1
        return n

    assert factor.tolist() == [max((shared(i, j) for j in range(i)), default=0) for i in range(len(windows))]


def test_an_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.drop_repeats(empty).collect() == []
    t = words(random.Random(1), 100)
    rows = S.drop_repeats(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[:300])], "doc_id long, text string"))
    assert sorted(((r.doc_id, len(r.kept)) for r in rows.collect()), key=str) == [(1, 0), (1, 0), (2, len(t[:300].encode())), (None, 0)]
    rows = S.drop_repeats(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[:300])], "doc_id long, text string"), keep="first")
    assert sorted(((r.doc_id, len(r.kept)) for r in rows.collect()), key=str) == [(1, 0), (1, 0), (2, len(t[:300].encode())), (None, len(t.encode()))]
