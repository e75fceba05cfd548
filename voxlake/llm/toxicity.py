"""Toxicity score from a factorization machine over hashed terms.

score = sigmoid(b + sum w[i] x + 1/2 sum_f ((sum_i v[i, f] z)^2 - sum_i (v[i, f] z)^2)): a
weight for each term, and for each pair of terms the product of their factors, so a pair such
as an insult beside a group's name can weigh more than both words alone.

Terms of a text are its distinct words (letters and characters above U+007F, A-Z lower-cased)
and their first 4 and 5 characters, which catch inflected forms, hashed to BUCKETS buckets.
Terms in use are those that are frequent in the sample or go with the label (``telling_terms``).
x is 1 for the linear part and z = 1 / sqrt(number of terms) for the pairs, so that long texts
don't drown in pairs.

The model is fitted on a bounded sample of labelled rows, at most MAX_PER_CLASS of either
label, drawn by a hash of the id; rows of a class count by how many of it there are for each
one drawn, so scores are probabilities at the labels' own rate. Terms are made, counted against
the labels and scored in tasks; the driver gets the sample's numbers of the terms in use and fits
the model, both of a size that doesn't depend on the input.

Defined results: a null or empty text has no terms and scores by the base rate b; every row has
a score, repeated ones too; labels of an id that disagree count as toxic if one does; without
any label to learn from all scores are 0.5 of a model without terms; an empty table gives none; a very
long text is read whole, in its row; ids drawn for the sample go by hash, ties by id. Only text is an
input of the score; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize

BUCKETS = 1 << 20
FACTORS = 4
MAX_PER_CLASS = 8000
EPOCHS = 8
BATCH = 64
RATE = 0.1
SHRINK = 1e-6
#: Spread of the factors at the start: from a smaller one a pair's factors hardly leave zero, as a pair's gradient is in proportion to them.
START = 0.1
OFTEN = 0.05
MIN_CHI2 = 20.0
CUT = 0.3
ROWS = 512
LONG_WORD = 64
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def _buckets(word: bytes) -> tuple[int, ...]:
    w = word.decode(errors="replace")
    terms = ["w" + w] + ["4" + w[:4]] * (len(w) >= 4) + ["5" + w[:5]] * (len(w) >= 5)
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


#: Long words aren't held: they seldom come again.
_known = lru_cache(maxsize=65_536)(_buckets)


def terms(text: str) -> np.ndarray:
    """The text's distinct term numbers, ascending."""
    words = set(text.encode().lower().translate(_LETTERS).split())
    return np.array(sorted({b for w in words for b in (_known(w) if len(w) <= LONG_WORD else _buckets(w))}), np.int64)


class FactorizationMachine:
    """``kept``: the term numbers in use, ascending; ``w`` and ``v`` have a row for each."""

    def __init__(self, bias: float, kept: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.kept, self.w, self.v = bias, kept, w, v
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[kept] = np.arange(len(kept))

    def places(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        return [at[at >= 0] for at in (self.place[r] for r in rows)]

    def forward(self, rows: list[np.ndarray]):
        """(logits, places, row of each, z of each, factor sums of each row)."""
        n = np.array([len(r) for r in rows], np.int64)
        idx = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        z = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
        logit = self.bias + np.bincount(row, self.w[idx], len(rows))
        sums = np.empty((len(rows), self.v.shape[1]))
        for f in range(self.v.shape[1]):
            a = self.v[idx, f] * z
            sums[:, f] = np.bincount(row, a, len(rows))
            logit += 0.5 * (sums[:, f] ** 2 - np.bincount(row, a * a, len(rows)))
        return logit, idx, row, z, sums

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.places(rows))[0], -30, 30)))


def telling_terms(rows: DataFrame) -> list[int]:
    """Terms of the sample (y, terms) that are frequent, or whose chi-square with the label is at least MIN_CHI2: rare terms only fit noise."""
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("y").cast("double").alias("tox"))
    lack, miss = n - F.col("df"), pos - F.col("tox")
    spread = F.col("df") * lack * (float(pos) * (n - pos))
    chi2 = n * F.pow(F.col("tox") * (lack - miss) - (F.col("df") - F.col("tox")) * miss, F.lit(2)) / F.greatest(spread, F.lit(1e-9))
    kept = counts.filter((F.col("df") >= max(20, OFTEN * n)) | ((spread > 0) & (chi2 >= MIN_CHI2)))
    return sorted(r.term for r in kept.select("term").collect())


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, kept: np.ndarray | None = None, seed: int = 7) -> FactorizationMachine:
    """Weighted logistic loss, AdaGrad over batches in a drawn order; only terms ``kept`` get weights (all if not given)."""
    rng = np.random.default_rng(seed)
    if kept is None:
        kept = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    rate = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    fm = FactorizationMachine(float(np.log(rate / (1 - rate))), kept, np.zeros(len(kept)), rng.normal(0, START, (len(kept), FACTORS)))
    rows = fm.places(rows)
    gw, gv = np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8)
    weights = weights / weights.mean() if len(weights) else weights
    order = np.arange(len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            logit, idx, row, z, sums = fm.forward([rows[i] for i in part])
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weights[part] / len(part)
            fm.bias -= RATE * error.sum()
            u, at = np.unique(idx, return_inverse=True)
            g = np.bincount(at, error[row], len(u)) + SHRINK * fm.w[u]
            gw[u] += g * g
            fm.w[u] -= RATE * g / np.sqrt(gw[u])
            for f in range(FACTORS):
                old = fm.v[u, f]
                g = np.bincount(at, error[row] * z * (sums[row, f] - fm.v[idx, f] * z), len(u)) + SHRINK * old
                gv[u, f] += g * g
                fm.v[u, f] = old - RATE * 0.3 * g / np.sqrt(gv[u, f])
    return fm


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> FactorizationMachine:
    known = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    known = known.filter("y IN (0, 1)").withColumn("h", F.xxhash64("i"))
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picks = [known.filter(F.col("y") == y).orderBy("h", "i").limit(max_per_class) for y in (0, 1)]
    sample = F.broadcast(picks[0].union(picks[1]))  # at most 2 * max_per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t or "").tolist() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["i", "h", "y", "terms"])

    texts = docs.select(F.col(id_col).alias("d"), F.col(text).alias("t")).join(sample, F.col("d") == F.col("i")).select("i", "h", "y", "t")
    schema = f"i {dict(docs.dtypes)[id_col]}, h bigint, y int, terms array<int>"
    rows = materialize(texts.mapInArrow(run, schema), "toxicity-sample")
    kept = np.array(telling_terms(rows), np.int64)

    def only_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [np.intersect1d(np.array(t, np.int64), kept).tolist() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), batch.column("y"), pa.array(part, pa.list_(pa.int32()))], ["i", "h", "y", "terms"])

    got = rows.mapInArrow(only_kept, schema).toArrow()
    cols = [got.column(c).to_pylist() for c in ("h", "i", "y")]
    order = sorted(range(got.num_rows), key=lambda k: (cols[0][k], cols[1][k]))  # a retried task may come back elsewhere
    lists = got.column("terms").to_pylist()
    rows = [np.array(lists[k], np.int64) for k in order]
    y = np.array([cols[2][k] for k in order], float)
    share = {c: n.get(c, 0) / max(1, min(n.get(c, 0), max_per_class)) for c in (0, 1)}
    return fit(rows, y, np.where(y == 1, share[1], share[0]), kept)


def scored(docs: DataFrame, model: FactorizationMachine, cut: float = CUT, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.kept, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorizationMachine(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                p = fm.score([terms(t or "") for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))], [*kept, "score", "predicted"]
                )

    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select([F.col(f"`{c}`") for c in kept])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with the columns of ``docs``."""
    model = train(docs, labels, text, id_col)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumns({"__tx_text": F.col(text)})
    keep = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    if keep:  # columns of the operator's own names are put aside
        own = own.withColumnsRenamed({c: f"__tx_{c}" for c in keep})
    out = scored(own, model, cut, "__tx_text").filter("predicted = 0").drop("score", "predicted")
    return out.withColumnsRenamed({f"__tx_{c}": c for c in keep}).select(cols)
