import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxlake.llm import simhash
from voxlake.llm.bk_forest import BkForest
from voxlake.operators.components import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps, radius=2):
    label = list(range(len(fps)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(fps))]


TEXTS = ["", None, " \t\n", "one", "One Two", "a b c", "A  b\tc", "a b c d", "É è b", "x" * 40_000, "a\x1cb c\x85d e", "a b c a b c a b c", "a\xa0b c d e"]


def test_fingerprint_equals_definition():
    rnd = random.Random(1)
    for t in TEXTS + [" ".join(rnd.choices("abcdeFGH", k=rnd.randint(1, 90))) for _ in range(100)]:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)


def near(rnd, n, families=40, size=30):
    fps = set()
    for _ in range(families):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, size)):
            x = base
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(n)}
    fps |= {0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 64) - 2}
    return sorted(fps)


def test_forest_finds_what_brute_force_finds():
    rnd = random.Random(2)
    fps = near(rnd, 200)
    shard = np.sort(np.array([rnd.randrange(3) for _ in fps]))
    label = BkForest(np.array(fps, np.uint64), shard).components(2)
    for s in range(3):
        at = np.flatnonzero(shard == s)
        want = brute_components([fps[k] for k in at])
        assert [int(at[w]) for w in want] == label[at].tolist()


def test_a_full_shard_is_one_component():
    fps = np.arange(1 << 12, dtype=np.uint64)
    assert set(BkForest(fps, np.zeros(len(fps), np.int64)).components(2).tolist()) == {0}


@pytest.mark.parametrize("shard", [simhash.SHARD, 2])
def test_links_of_all_shards_equal_brute_force(spark, shard):
    fps = near(random.Random(3), 300)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.u: r.v for r in components(simhash.shard_links(df, shard=shard)).collect()}
    groups, want = {}, {}
    for f, s, k in zip(fps, signed, brute_components(fps)):
        groups.setdefault(found.get(s, s), set()).add(f)
        want.setdefault(k, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 200)] + [(500, 499), (7, 7), (300, 250)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[500] == 499
    assert all(got[i] == 100 for i in range(101, 300) if i != 250) and got[250] == 100 and got[300] == 100
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    out = []
    for _ in range(60):
        base = rnd.choices(words, k=rnd.randint(60, 200))
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(" ".join(w))
    out += ["same copy of a text"] * 100 + TEXTS
    rnd.shuffle(out)
    return list(enumerate(out, 10))


def test_near_groups_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, fp int").repartition(6)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    for (i, _), f, k in zip(rows, fps, brute_components(fps)):
        assert got[i] == (f"{f:016x}", rows[k][0])


def test_keep_one_row_of_each_component(spark, rows):
    more = rows + rows[:5] + [(None, rows[9][1]), (None, "a text without id that is alone here")] * 2
    docs = spark.createDataFrame([(i, t, 0) for i, t in more], "doc_id bigint, text string, root int").repartition(6)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted({rows[k][0] for k in brute_components(fps)}) + [None]
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x)) == want
    assert simhash.keep_one(docs.filter("false")).count() == 0
    assert simhash.near_groups(docs.filter(F.lit(False))).count() == 0
