"""The opN queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize, scratch_path
from . import divergence, exact_dedup, license_scan, line_dedup, packing, rank_bpe, resampling, simhash, suffix_dedup, syncmers, token_lengths, token_records, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_docs(spark, sf_dir))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents),
g AS (
  SELECT k, count(*) AS group_size,
         first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM n GROUP BY k)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id = g.keep_id AS kept, sha256(n.k) AS text_sha256
FROM n JOIN g USING (k)
"""



def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, index = scratch_path(spark, "token-records"), scratch_path(spark, "token-index")
    token_records.write_records(_docs(spark, sf_dir), files, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added=True)
    token_records.write_index(spark, files, index)
    return spark.read.parquet(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(_docs(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_lengths.histogram(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_lengths.profile(materialize(hist, "length-histogram"))


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, seq=1024, added=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(_docs(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_docs(spark, sf_dir))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
c AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM c WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT c.*, r.holder IS NOT NULL AND c.doc_id <> r.holder AS gone FROM c LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.drop_repeats(_docs(spark, sf_dir))
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    return rows.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT lang, source, k, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY x.lang, x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // (g.total + 5 * l.v) AS p,
         1 + (1000000000 * CAST(k.n + 5 AS HUGEINT)) // (l.total + 5 * l.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_records": op2_token_records,
    "op3_syncmers": op3_syncmers,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_length_histogram": op6_length_histogram,
    "op7_rank_bpe": op7_rank_bpe,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_divergence": op12_divergence,
    "op13_resampling": op13_resampling,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op9_line_dedup": OP9_SQL, "op12_divergence": OP12_SQL}
