from collections import defaultdict

import pytest

from voxlake.llm import line_dedup, repeats

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(list)

    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))
        return k if len(k) >= min_chars else None

    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            ids = holders.get(key(x), [])
            top = max((j for j in ids if j is not None), default=None)
            if len(ids) < min_docs or i == top:
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


COMMON = "This Very Common Line is everywhere"
ROWS = (
    [(i, f"{COMMON}\nown line number {i} which is long enough\n  {COMMON.upper()}\t\nshort") for i in range(150)]
    + [(300 + i, f"pair of texts number {i // 2} shares this\n{COMMON}") for i in range(20)]
    + [(400 + i, f"three texts number {i // 3} share this é\n\nthree texts number {i // 3} share this é") for i in range(30)]
    + [(500, None), (501, ""), (502, "\n\n"), (None, COMMON), (503, COMMON), (503, COMMON), (504, "x" * 90_000), (505, "é" * 19), (506, "é" * 19), (507, "é" * 19)]
    + [(508 + i, "É" * 20) for i in range(3)] + [(520 + i, "é" * 20) for i in range(2)]
)


@pytest.mark.parametrize("max_bytes", [repeats.MAX_BYTES, 512])
def test_equals_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(i, t, "c") for i, t in ROWS], "doc_id bigint, text string, keys string").repartition(7)
    got = line_dedup.drop_repeated_lines(docs, max_bytes=max_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_keys_of_null_ids_stay(spark):
    rows = [(None, "a line of null ids that repeats")] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
