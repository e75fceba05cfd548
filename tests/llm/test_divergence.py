import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import divergence as D


def brute(rows, min_docs, top=50):
    """By the definition, over plain dictionaries of Python integers."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        price = {}
        for s in [*sources, None]:
            c = count[s] if s is not None else {t: sum(count[x][t] for x in sources) for t in kept}
            n = sum(c.values())
            price[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}
        for s in sources:
            far = [(sum(abs(price[s][t] - price[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(price[s][t] - price[None][t], t) for t in kept if count[s][t] > 0 and price[s][t] > price[None][t]]
            for part, items, most in (("pair", far, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return sorted(out)


def rows_of(n=500, sources=9, seed=1):
    rng = random.Random(seed)
    terms = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "y", "ß", "É", "z", "Q")] + ["日本", "é", "Ab"]
    rows = []
    for _ in range(n):
        s = min(rng.randrange(sources * 2), sources - 1)
        own = terms[s : s + 20]
        text = " ".join(rng.choice(own if rng.random() < 0.5 else terms) + rng.choice(["", ",", "1", "!"]) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "de", None]), f"s{s}"))
    return rows + [(None, "en", "null text"), ("", "en", ""), (None, None, None), ("1 2 3", "xx", "a"), ("", "xx", "b"), ("rare word", "xx", "c"), *[("Ab ab AB", "one", "only")] * 40]


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    return sorted(tuple(r) for r in D.audit(df, **how).collect())


@pytest.mark.parametrize(("block", "tile"), [(4096, 32), (8, 2), (5, 3)])
def test_rows_equal_brute_force(spark, block, tile):
    rows = rows_of()
    assert got(spark, rows, min_docs=10, top=7, block=block, tile=tile) == brute(rows, 10, 7)


def test_a_pair_is_one_in_all_blocks_whatever_the_order_of_their_rows():
    groups = [{"lang": "en", "source": s, "tile": 0, "total": n, "terms": 4, "block": 0, "width": 2, "at": [0], "n": [n], "one": 0, "other": 0} for s, n in (("b", 1), ("a", 2), ("c", 3))]
    want = D._block_costs(pa.Table.from_pylist(groups)).to_pylist()
    assert D._block_costs(pa.Table.from_pylist(groups[::-1])).to_pylist() == want
    assert {(r["a"], r["b"]) for r in want} == {("b", "a"), ("c", "a"), ("c", "b")}


def test_languages_of_many_terms_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.sample(range(600), 60)), "en", f"s{rng.randrange(40)}") for _ in range(800)]
    assert got(spark, rows, min_docs=30, block=16, tile=32) == brute(rows, 30)


def test_an_empty_table_and_a_table_without_kept_terms(spark):
    assert got(spark, []) == []
    assert got(spark, [("a b", "en", "x"), (None, "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_bounded_tables_of_a_task_change_nothing(spark, monkeypatch):
    rows = rows_of(200)
    monkeypatch.setattr(D, "_HELD", 50)
    assert got(spark, rows, min_docs=5) == brute(rows, 5)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 4), st.integers(1, 6), st.randoms())
def test_trees_price_what_their_leaves_do(depth, n, rng):
    rows = np.array([[rng.choice([0, 0, 0, 1, 5]) for _ in range(1 << depth)] for _ in range(n)])
    roots, levels, leaves = D.cons(rows)
    prices = [np.array([rng.randrange(100) for _ in leaves]) for _ in rows]
    pairs = [(i, j) for i in range(n) for j in range(n)]
    at = np.searchsorted(leaves, rows)
    want = [int(np.abs(prices[i][at[i]] - prices[j][at[j]]).sum()) for i, j in pairs]
    assert D.compare(roots, levels, leaves, prices, pairs) == want
    for level in levels:
        assert len(np.unique(level, axis=0)) == len(level)


def test_equal_subtrees_share_nodes():
    rows = np.zeros((3, 1024), np.int64)
    rows[0, :4], rows[1, 512:516] = [7, 0, 7, 1], [7, 0, 7, 1]
    roots, levels, _ = D.cons(rows)
    assert sum(len(x) for x in levels) < 40 and len(set(roots.tolist())) == 3


def test_prices_are_exact_for_large_counts(spark):
    n = 3 * 10**15 + 7
    df = spark.createDataFrame([(n, 7 * 10**15 + 1, 12345)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    assert df.select(D.price(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 5) // (7 * 10**15 + 1 + 5 * 12345)


def test_a_task_gives_a_term_once_for_each_group():
    terms = [f"{c}{'x' * k}" for c in map(chr, range(0x4E00, 0x4E00 + 20_000)) for k in range(20)]
    texts = [" ".join(terms), " ".join([*terms[:7], terms[0], "Ab aB"]), "", "1 2"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "a", "b", "c"]), pa.array(texts)], ["lang", "source", "t"])
    (out,) = D.summed_terms(iter([batch.slice(0, 1), batch.slice(1)]))
    assert out.num_rows == len(terms) + 1
    got = {r["term"]: (r["n"], r["docs"]) for r in out.to_pylist() if r["source"] == "a"}
    assert got[terms[0]] == (3, 2) and got[terms[6]] == (2, 2) and got[terms[7]] == (1, 1) and got["ab"] == (2, 1)
    (empty,) = D.summed_terms(iter([]))
    assert empty.num_rows == 0 and empty.schema.field("n").type == pa.int64()
