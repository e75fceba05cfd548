"""A training-data pipeline over the documents table: each stage works on all rows its predecessor kept.

toxicity      documents that score 0.3 or more are dropped (model fitted on the labels table)
exact_dedup   of texts equal but for blanks one stays
near_dedup    of documents linked by SimHash one stays
packing       the rest as pieces of sequences of at most 1024 tokens

Defined results: a null text counts as empty, so all empty and null texts are copies of one another and one stays;
of rows that repeat id and text one stays; a row without an id is a document too, and of near copies the last choice;
a very long text is worked on whole by every stage; an empty table gives no piece. Other columns pass through all stages
but the last, whatever their names. Each stage reads what its predecessor wrote, so a lost executor costs the
tasks it ran; ``run`` deletes a stage's table when the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxlake.functions.scratch import discard, reread, scratch_path
from voxlake.llm import exact_dedup, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, seq=1024, added=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Tokens and a fitted model are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path, before = scratch_path(spark, f"stage-{name}"), docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = reread(spark, path, spark.read.parquet(path).schema)
        if name != STAGES[0][0]:
            discard(before)
    return docs
