import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from voxlake.llm import queries, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|> y", "no such text", "", "<|endoftext", "  <|endoftext|>\n", "日本<|endoftext|>é"]


def plain(texts):
    tok = Tokenizer.from_file(JSON)
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_equal_the_library_for_texts_with_added_tokens():
    want = plain(TEXTS)
    assert want[0] == [50256]
    got = tokens.TextEncoder(JSON, added=True)(TEXTS)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_queries_encode_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = plain(TEXTS)
    sf = str(tmp_path)
    at, want = 0, []
    for k, x in enumerate(ids):
        want.append((k, at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        at += len(x) + 1
    assert sorted(map(tuple, queries.op2_token_records(spark, sf).collect())) == want
    lengths = [len(x) for x in ids]
    assert {r.n_tokens: r.n_docs for r in queries.op6_length_histogram(spark, sf).collect()} == {n: lengths.count(n) for n in lengths}
    for got in (queries.op8_packing(spark, sf), corpus_pipeline.pack(spark, docs, sf)):
        assert {r.doc_id: r.doc_tokens for r in got.collect()} == {k: len(x) + 1 for k, x in enumerate(ids)}
