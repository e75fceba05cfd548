import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import packing, token_lengths, token_records, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "   ", "a", " a", "a b", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "\n\n a", "tail ", "tail  ", "it's we'll  can't",
    "é è  ü", "a  b", "a   b", "x\x1c y", "a\x85 b", "<|endoftext|> a <|endoftext|>", "日本語 テキスト  です", "a" * 3000, "ab " * 2000, "\t\t x \r\n y",
]


def reference_ids(texts):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts():
    rnd = random.Random(5)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "b", "'s", "é", "1", "%", " ", "　", "\x1c", "日"]
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(3000)]
    got = tokens.TextEncoder(JSON)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == reference_ids(texts)


def test_a_full_cache_is_emptied():
    enc = tokens.TextEncoder(JSON)
    enc.after_blank.limit = 10
    texts = [" ".join(f"w{i}{j}" for j in range(7)) for i in range(30)]
    got = [x for k in range(0, 30, 3) for x in enc(texts[k : k + 3])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == reference_ids(texts)


def test_frames_round_trip_and_detect_damage():
    ids = [np.array(x, "<u4") for x in ([], [1, 2], [70000, 3])]
    data = b"".join(token_records.frame(k, x) for k, x in zip([7, None, -3], ids))
    back = list(token_records.walk(data))
    assert [b[2] for b in back] == [7, None, -3]
    assert [b[3].tolist() for b in back] == [x.tolist() for x in ids]
    for spot in (0, 5, 9, len(data) - 3):
        bad = bytearray(data)
        bad[spot] ^= 1
        with pytest.raises(ValueError):
            list(token_records.walk(bytes(bad)))


def test_records_are_written_in_order_and_read_back(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id"), (900, None)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ordinal string").repartition(5)
    files, index = f"file://{tmp_path}/r", f"file://{tmp_path}/i"
    token_records.write_records(docs, files, JSON, end_id=2)
    token_records.write_index(spark, files, index)
    got = spark.read.parquet(index).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x))
    want = {(i, t): ids + [2] for (i, t), ids in zip(rows, reference_ids([t or "" for _, t in rows]))}
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in want.items() if i is not None
    )
    shuffled = token_records.read_shuffled(spark, files, index, seed=3).collect()
    assert sorted(tuple(r.ids) for r in shuffled) == sorted(tuple(x) for x in want.values())
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in got]


def test_files_are_bounded_and_ties_are_dealt(spark, tmp_path, monkeypatch):
    """A third of the rows share an id; no file takes more than about file_bytes, and what is read back is whole."""
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(token_records, "FILE_ROWS", 8)
    token_records.write_records(docs, f"file://{tmp_path}/r", JSON, end_id=2, file_bytes=1600)
    token_records.write_index(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i")
    sizes = [p.stat().st_size for p in (tmp_path / "r").glob("part-*")]
    assert max(sizes) <= 1600 and len(sizes) >= 20
    got = spark.read.parquet(f"file://{tmp_path}/i").orderBy("start").collect()
    assert len(got) == 900 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(900)]
    assert len(token_records.read_shuffled(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i", 1).collect()) == 900


@pytest.mark.parametrize("job", ["45c26c49-cf1c-4783-a5f9-c41e7a09b2d1", "0c1-c2-c003", "00000000-c000-c9c9-c999-000000000000"])
def test_pieces_are_in_order_whatever_the_id_of_the_write(spark, tmp_path, monkeypatch, job):
    """Files are named part-<task>-<id of the write>-c<piece>, and that id is drawn anew for each write."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(token_records, "FILE_ROWS", 8)
    token_records.write_records(docs, f"file://{tmp_path}/r", JSON, end_id=2, file_bytes=1600)
    (tmp_path / "named").mkdir()
    for p in (tmp_path / "r").glob("part-*"):
        task, piece = p.name.split("-")[1], p.name.split("-")[-1]
        (tmp_path / "named" / f"part-{task}-{job}-{piece}").write_bytes(p.read_bytes())
    token_records.write_index(spark, f"file://{tmp_path}/named", f"file://{tmp_path}/i")
    got = spark.read.parquet(f"file://{tmp_path}/i").orderBy("start").collect()
    assert len({r.file for r in got}) >= 5 and [r.doc_id for r in got] == list(range(200))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(200)]


def test_an_empty_table_gives_no_records(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_records.write_records(docs, f"file://{tmp_path}/r", JSON, end_id=2)
    token_records.write_index(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/i")
    assert spark.read.parquet(f"file://{tmp_path}/i").count() == 0
    assert packing.packed(docs, JSON, 0).count() == 0
    assert token_lengths.profile(token_lengths.histogram(docs, JSON)).count() == 0


def test_length_profile_answers_like_brute_force(spark):
    texts = TEXTS + [None, "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lengths = [len(x) for x in reference_ids([t or "" for t in texts])]
    prof = token_lengths.profile(token_lengths.histogram(docs, JSON)).cache()
    for r in prof.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_ge == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= r.n_tokens)
        assert r.kept_at_limit == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for r in token_lengths.at_limits(prof, [1, 5, 1000, 10**6]).collect():
        assert r.kept_tokens == sum(min(x, r.context_limit) for x in lengths)
        assert r.truncated_docs == sum(x > r.context_limit for x in lengths)
    ordered = sorted(lengths)
    for r in token_lengths.quantiles(prof, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == ordered[max(0, -(-int(r.share * 1000) * len(ordered) // 1000) - 1)]


def test_lengths_of_long_texts_beside_a_clashing_column(spark):
    long = "word " * 50_000
    docs = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, None, 7)], "doc_id bigint, text string, n_tokens int")
    got = {r.n_tokens: r.n_docs for r in token_lengths.histogram(docs, JSON).collect()}
    assert got == {0: 1, len(reference_ids([long])[0]): 2}


@pytest.mark.parametrize("seed", range(8))
def test_packing_covers_every_id_once_with_little_padding(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 3, 50, 700, 1023, 1024, 1025, 5000]) + rnd.randint(0, 40) for _ in range(rnd.randint(1, 400))]
    pieces = packing.pack(lengths, 1024)
    spans = {k: [] for k in range(len(lengths))}
    seqs = {}
    for k, start, n, s, at in pieces:
        assert n > 0
        spans[k].append((start, n))
        seqs.setdefault(s, []).append((at, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(spans[k]):
            assert start == at
            at += m
        assert at == n
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # a power of two: no padding


def test_costs_of_full_sequences_are_balanced():
    rnd = random.Random(2)
    lengths = [rnd.randint(5, 300) for _ in range(4000)]
    by_seq = {}
    for _, _, n, s, _ in packing.pack(lengths, 1024):
        by_seq.setdefault(s, []).append(n)
    costs = [sum(packing.cost(n, 1024) for n in x) for x in by_seq.values() if sum(x) == 1024]
    assert np.std(costs) / np.mean(costs) < 0.1


def test_packed_table(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (4, None, 1), (4, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(3)
    got = packing.packed(docs, JSON, end_id=0, seq=64).collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in reference_ids([t or "" for _, t, _ in rows]))
    place = {(r.sequence_id, r.offset) for r in got}
    assert len(place) == len(got)
