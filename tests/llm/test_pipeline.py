import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxlake.llm import toxicity
from voxlake.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def plain(rows, model):
    """(id, text) of the documents that stay, the first of equal ones."""
    rows = [(i, t or "") for i, t in rows]
    rows = [(i, t) for i, t in rows if model.score([toxicity.terms(t)])[0] < 0.3]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is not None, i, t))
    rows = sorted((min(g)[1:] for g in groups.values()), key=lambda r: (not r[0], r[1] or 0))  # null ids are the last choice of a component
    fps = [fingerprint(t) for *_, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return [rows[k][1:] for k in range(len(rows)) if root[k] == k]


def check(got, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for spans, total in [(pieces[i], len(ids[i])) for i in ids] + [(p, None) for p in places.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 1024


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_rows_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    check(corpus_pipeline.run(spark, SF).collect(), plain([(r.doc_id, r.text) for r in docs.collect()], model))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def small(spark, tmp_path):
    """A folder of tables with nulls, empty and long texts, repeats, added tokens and columns named like the operators' own."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(5, 60))) for _ in range(60)]
    rows = list(enumerate(texts, 100))
    rows += [(i + 200, t.replace(" ", "  ", 3)) for i, t in rows[:20]] + [(i + 400, t + " omega") for i, t in rows[:20]]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "word " * 30_000), (1004, "x" * 50_000), (1005, "a <|endoftext|> b"), (None, "a text without an id")]
    rows += [rows[0], rows[0], (1003, "word " * 30_000)]

    def write(folder, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "k") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int, root string")
        docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i is not None and i % 7 == 0)) for i, _ in rows[:100]], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return str(folder)

    return write(tmp_path / "full", rows), rows, write(tmp_path / "empty", [])


def test_odd_rows_and_clashing_columns(spark, small):
    folder, rows, empty = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    check(corpus_pipeline.run(spark, folder).collect(), plain(rows, model))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
    assert corpus_pipeline.run(spark, empty).count() == 0
