"""Exact length histogram of encoded documents and what its suffix sums answer.

``histogram`` aggregates documents by encoded length. ``profile`` adds, for every
length L that occurs, the totals over lengths of at least L: documents, tokens, and
the tokens that a context limit of L would keep, sum(min(length, L)). ``at_limits``
and ``quantiles`` read the answers for any limits from that table.

Null and empty texts have length 0; every row counts, repeated ones too; an empty
table gives an empty histogram; a very long text is encoded whole, in its row. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import with_token_counts

BLOCK = 64


def histogram(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", added: bool = False) -> DataFrame:
    return with_token_counts(docs, tokenizer, text, id_col, added).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def profile(hist: DataFrame) -> DataFrame:
    """Suffix sums in two steps, over blocks of BLOCK lengths and inside each block, so that no task sees all lengths."""
    h = hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = blocks.select(
        F.col("block").alias("b"), F.coalesce(F.sum("bd").over(above), zero).alias("d_above"), F.coalesce(F.sum("bt").over(above), zero).alias("t_above"),
        F.sum("bd").over(total).alias("total_docs"), F.sum("bt").over(total).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(sums, F.col("block") == F.col("b"))
    docs_ge, tokens_ge = F.col("d") + F.col("d_above"), F.col("t") + F.col("t_above")
    return out.select(
        "n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        (F.col("total_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("kept_at_limit"),
        (1 - (docs_ge - F.col("n_docs")) / F.col("total_docs")).alias("cum_share"), "total_docs", "total_tokens",
    )


def at_limits(prof: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: total tokens, tokens kept after truncation, documents truncated."""
    aggs = []
    for k in limits:
        over = F.col("n_tokens") > k
        aggs.append(
            F.struct(
                F.lit(k).cast("long").alias("context_limit"), F.sum(F.least("n_tokens", F.lit(k)) * F.col("n_docs")).alias("kept_tokens"),
                F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("truncated_docs"),
            )
        )
    return prof.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def quantiles(prof: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least a share of the documents do not exceed."""
    aggs = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("cum_share") >= q - 1e-12, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return prof.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
