import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from voxlake.llm import rank_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return rank_bpe.RankBpe(RANKS, P.PATTERN)


def same(bpe, known, texts):
    got = bpe(texts)
    want = known.encode_ordinary_batch(texts, num_threads=2)
    for t, g, w in zip(texts, got, want, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == w, repr(t[:80])
        assert bpe.decode(g) == t.encode()


def test_random_texts(bpe, known):
    rnd = random.Random(9)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "th", "ing", "'s", "é", "ß", "1", "23", "%", "##", " ", "　", "\x1c", "\x85", "日", "本", "語", "и", "ا", "😀", "́"]
    same(bpe, known, ["", " ", "a"] + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(4000)])


def test_long_words(bpe, known):
    rnd = random.Random(3)
    texts = ["a" * n for n in (255, 256, 257, 1000, 5001)]
    texts += ["".join(rnd.choices("abcdeéö", k=n)) for n in (3, 17, 63, 64, 65, 200, 256, 300, 3000)]
    texts += ["%" * 700, "-=" * 400, "ab" * 300, " " * 900, "日本" * 400]
    same(bpe, known, texts)


def one_by_one(ranks, word):
    """The definition: the leftmost pair of the lowest rank is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_rank_file_merges_in_order(tmp_path):
    """Ranks in a drawn order, so that merges make pairs of lower ranks, beside overlapping and repeated ones."""
    rnd = random.Random(5)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {"".join(rnd.choices("ab", k=rnd.randint(2, 5))).encode() for _ in range(25)}
        order = sorted(tokens)
        rnd.shuffle(order)
        ranks = {t: k for k, t in enumerate(order)}
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for t, k in ranks.items()))
        bpe = rank_bpe.RankBpe(str(path), P.PATTERN)
        words = ["".join(rnd.choices("ab", k=rnd.randint(1, 40))) for _ in range(60)] + ["a" * 33, "ab" * 20]
        for w, got in zip(words, bpe(words)):
            want = [ranks[w.encode()]] if w.encode() in ranks else one_by_one(ranks, w.encode())
            assert np.frombuffer(got, "<u4").tolist() == want, w


def test_every_assigned_character(bpe, known):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    same(bpe, known, ["x" + c + "y " + c + " 1" + c for c in chars])


def test_round_trip_table(spark, known):
    rows = [(1, "hello wörld"), (2, None), (3, ""), (None, "x y"), (1, "hello wörld"), (4, "z" * 50_000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = rank_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = rank_bpe.decoded(rank_bpe.encoded(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert rank_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
