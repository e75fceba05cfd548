"""Removal of long byte strings that occur more than once, by suffix arrays and longest-previous-factor arrays.

Every byte covered by a string of ``min_bytes`` bytes that starts at another place too, in the same document or another, is
taken out: of all places (``keep="none"``), or of all but the first (``keep="first"``; documents are in the order of their id, then
of the place). Strings are judged on the input, matches never cross documents.

1. Candidates. A string of ``min_bytes`` bytes (a window) is represented by its minimizer, the smallest hash of the
   GRAM-byte strings in it; equal windows have equal minimizers. One pass hashes the texts, of texts equal as a whole one
   stays in play, and minimizers found once only are done with: nothing in their windows repeats. They are counted as 8-byte
   numbers with partial sums; only texts that hold a repeated one shuffle.
2. Buckets. Consecutive windows with one repeated minimizer are a run, and a run's bytes go to the minimizer's bucket. So any two
   equal windows meet in a bucket. Equal runs are merged in the tasks that cut them, with their number and their first place.
3. A bucket of more than ``limit`` different runs (a line or passage that much of the corpus shares) is dealt anew: its runs are cut into
   pieces of PIECE windows, aligned at the minimizer, whose bucket is the hash of the bytes that all windows of the piece have in
   common; pieces whose common bytes occur once are done with. What is still too full is cut into single windows, and equal windows are
   one row by then. That is exact, and no task gets more than it can hold.
4. Suffix arrays. Tasks sort the windows of whole buckets, about SHARD bytes at a time, by prefix doubling up to
   ``min_bytes``. The previous and the next smaller position in that order give each window the length of its longest previous factor;
   the same on reversed positions gives the longest next factor. Windows whose factor has ``min_bytes`` are repeated. Runs or
   pieces that were merged repeat as a whole.
5. The spans of a text are merged and meet the text again; texts without any don't shuffle (``repeats.with_hits``: a filter
   of at most ``max_bytes``, beyond which more texts shuffle).

Defined results: a null text counts as empty; texts shorter than ``min_bytes`` keep all; every row is a document, also rows that
repeat id and text (with ``keep="first"``, the copies of one text with the smallest id all keep it, for they can't be told
apart); a null id comes first; what remains may end inside a character, so it is binary; a very long text is cut into overlapping parts for
hashing and is one row elsewhere; an empty table gives no row. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize
from . import repeats

MIN_BYTES = 400
GRAM = 64
PIECE = 16
#: Bytes of windows that are hashed, and of runs that are sorted, at a time.
PART, SHARD = 1 << 19, 1 << 20
#: Different runs of a bucket, and their bytes; with more of either the bucket is dealt anew.
LIMIT, FULL = 2000, 1 << 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- hashing of windows -------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each place, by doubling a polynomial."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULT
    base, size = _BASE, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * np.uint64(base) + h[size:]
            base, size = base * base & 0xFFFFFFFFFFFFFFFF, size * 2
        return np.minimum(_mixed(h), _NEVER - np.uint64(1))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive numbers."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def parts(lengths: list[int], min_bytes: int, most: int = PART) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, start, end) of about ``most`` bytes; every window of every text lies in exactly one part."""
    group, size = [], 0
    for k, n in enumerate(lengths):
        for start in range(0, n - min_bytes + 1, most):
            end = min(n, start + most + min_bytes - 1)
            group.append((k, start, end))
            size += end - start
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


class _Part:
    """Hashes of the windows of a group of parts of texts, laid end to end."""

    def __init__(self, texts: list[bytes], group: list[tuple[int, int, int]], min_bytes: int):
        data = np.frombuffer(b"".join(texts[k][s:e] for k, s, e in group), np.uint8)
        sizes = np.array([e - s for _, s, e in group])
        self.width = min_bytes - GRAM + 1
        self.text, self.shift = np.array([k for k, _, _ in group]), np.array([s for _, s, _ in group])
        self.begin = np.cumsum(sizes) - sizes
        self.grams = gram_hashes(data)
        self.lows = sliding_min(self.grams, self.width)
        self.part = np.repeat(np.arange(len(group)), sizes)
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, self.begin, 1)
        np.add.at(edge, self.begin + sizes - min_bytes + 1, -1)
        self.inside = np.cumsum(edge)[: len(self.lows)] > 0  # windows that don't cross texts

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every place that is the minimizer of a window."""
        lows = np.where(self.inside, self.lows, np.uint64(0))
        rim = np.zeros(self.width - 1, np.uint64)
        highest = ~sliding_min(~np.concatenate([rim, lows, rim]), self.width)
        at = np.flatnonzero(highest == self.grams)
        return self.text[self.part[at]], self.grams[at].view(np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, number of windows, minimizer) of runs of consecutive windows with one minimizer."""
        lows, inside, part = self.lows, self.inside, self.part[: len(self.lows)]
        fresh = np.ones(len(lows), bool)
        fresh[1:] = (lows[1:] != lows[:-1]) | (part[1:] != part[:-1]) | ~inside[:-1]
        at = np.flatnonzero(fresh & inside)
        stop = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]])) + 1
        own = part[at]
        return self.text[own], at - self.begin[own] + self.shift[own], stop - at, lows[at].view(np.int64)


def _parts_of(texts: list[bytes], min_bytes: int) -> Iterator[_Part]:
    for group in parts([len(t) for t in texts], min_bytes):
        yield _Part(texts, group, min_bytes)


def piece_cuts(data: bytes, min_bytes: int, piece: int) -> list[tuple[int, int, bytes]]:
    """(first window, number of windows, core) of the pieces of a run: consecutive windows whose minimizer is one place, by blocks of ``piece`` of the distance to it.

    The core is what all windows of the block have in common, also those that the run lacks, so equal windows have equal cores.
    """
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    width = min_bytes - GRAM + 1
    lows = sliding_min(grams, width)
    where = np.arange(len(grams))
    nearest = np.empty(len(lows), np.int64)  # leftmost place of the minimum of each window
    for v in np.unique(lows):
        own, at = np.flatnonzero(lows == v), where[grams == v]
        nearest[own] = at[np.searchsorted(at, own)]
    block = (nearest - np.arange(len(lows))) // piece
    new = np.flatnonzero(np.concatenate([[True], (np.diff(nearest) != 0) | (np.diff(block) != 0)]))
    counts, late = np.diff(np.append(new, len(lows))), nearest[new] - block[new] * piece
    return [(a, n, data[e : e - piece + 1 + min_bytes]) for a, n, e in zip(new.tolist(), counts.tolist(), late.tolist(), strict=True)]


# ---- suffix order and factors --------------------------------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of numbers, equal ones alike."""
    order = np.argsort(keys)
    new = np.concatenate([[0], (np.diff(keys[order]) != 0).astype(np.int64)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def prefix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every place by that many bytes from it): 1, 2, 4, ... up to ``depth``. Beyond the end bytes count as 0."""
    words = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)] << np.uint64(8 * (7 - k))
    out = [(8, _dense(words))]
    while out[-1][0] * 2 <= depth:
        size, rank = out[-1]
        later = np.concatenate([rank[size:], np.zeros(min(size, len(rank)), np.int64)])[: len(rank)]
        out.append((size * 2, _dense(rank * (int(rank.max()) + 1) + later)))
    return out


def window_order(data: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows in suffix order, common prefix with the one before; both up to ``depth`` bytes). All windows have ``depth`` bytes."""
    ranks = prefix_ranks(data, depth)
    size, rank = ranks[-1]
    key = rank[windows] * (int(rank.max()) + 1) + rank[windows + depth - size]
    order = windows[np.lexsort((windows, key))]
    common = np.zeros(len(order), np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    got = np.zeros(len(i), np.int64)
    for size, rank in reversed(ranks):
        again = True
        while again:  # the longest length may fit more than once, shorter ones fit once at most
            fits = np.flatnonzero(got + size <= depth)
            fits = fits[rank[i[fits] + got[fits]] == rank[j[fits] + got[fits]]]
            got[fits] += size
            again = bool(len(fits)) and size == ranks[-1][0]
    for _ in range(7):
        fits = np.flatnonzero(got < depth)
        fits = fits[data[i[fits] + got[fits]] == data[j[fits] + got[fits]]]
        got[fits] += 1
    common[1:] = got
    return order, common


def _smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it whose value is smaller, -1 if none: candidates jump along those found so far."""
    at = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(at >= 0)
    todo = todo[values[at[todo]] > values[todo]]
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
        todo = todo[values[at[todo]] > values[todo]]
    return at


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order the longest prefix that also starts at a smaller place.

    That is the longer of the common prefixes with the previous and the next smaller place in the order. A common prefix of two
    entries is the least of those between them, looked up in a table of minima over powers of two.
    """
    n = len(order)
    table = [common]
    while (1 << len(table)) < n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]) if len(table[-1]) > half else table[-1])
    before = _smaller(order)
    after = n - 1 - _smaller(order[::-1])[::-1]  # n where none

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of common[lo + 1 .. hi]."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(table[k][lo[own] + 1], table[k][hi[own] - (1 << int(k)) + 1])
        return out

    got = np.zeros(n, np.int64)
    has = np.flatnonzero(before >= 0)
    got[has] = least(before[has], has)
    has = np.flatnonzero(after < n)
    got[has] = np.maximum(got[has], least(has, after[has]))
    return got


def repeated_windows(strings: list[bytes], min_bytes: int, later_only: bool) -> list[list[tuple[int, int]]]:
    """For each string the spans (first, end) of windows that are found elsewhere in ``strings`` (before, with ``later_only``)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + sizes - min_bytes + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    order, common = window_order(data, windows, min_bytes)
    factor = longest_previous(order, common)
    if not later_only:
        factor = np.maximum(factor, longest_previous(len(data) - order, common))
    hit = np.zeros(len(data) + 1, np.int8)
    hit[order[factor >= min_bytes]] = 1
    jump = np.diff(np.concatenate([[0], hit]))
    jump[begin] = hit[begin]  # spans don't cross strings: their last windows are never hit
    first, end = np.flatnonzero(jump == 1), np.flatnonzero(jump == -1)
    owner = np.searchsorted(begin, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for k, a, b in zip(owner.tolist(), (first - begin[owner]).tolist(), (end - begin[owner]).tolist(), strict=True):
        out[k].append((a, b))
    return out


# ---- the job -------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id, text as bytes t, and the 128 bits k1, k2 that stand for a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), t.cast("binary").alias("t"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def _texts(rows: DataFrame, kind: str, min_bytes: int) -> DataFrame:
    """One row for each different text of at least ``min_bytes``: k1, k2, rep (its smallest id), size, copies and its minimizers (h, how often: 1 or 2 for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for p in _parts_of(texts, min_bytes):
                text, h = p.selected()
                order = np.argsort(text, kind="stable")
                text, h = text[order], h[order]
                at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
                for k, part in zip(text[at].tolist() if len(text) else [], np.split(h, at[1:]) if len(text) else [], strict=True):
                    found[k].append(part)
            values, times, lengths = [], [], []
            for got in found:
                v, c = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                values.append(v)
                times.append(np.minimum(c, 2))
                lengths.append(len(v))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            marks = pa.StructArray.from_arrays([pa.array(np.concatenate(values), pa.int64()), pa.array(np.concatenate(times), pa.int32())], ["h", "c"])
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), size, pa.ListArray.from_arrays(offsets, marks)], ["id", "k1", "k2", "size", "marks"])

    hashed = rows.filter(F.length("t") >= min_bytes).mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint, size bigint, marks array<struct<h:bigint,c:int>>")
    return hashed.groupBy("k1", "k2").agg(F.min(F.struct("id")).alias("rep"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("marks").alias("marks"))


def _runs(rows: DataFrame, kind: str, min_bytes: int) -> DataFrame:
    """(bucket, data, id, k1, k2, start) of the runs whose minimizer is one of the text's repeated ones, hs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            wanted = [np.array(h, np.int64) for h in batch.column("hs").to_pylist()]
            for p in _parts_of(texts, min_bytes):
                text, start, n, h = p.runs()
                keep = np.concatenate([np.isin(h[text == k], wanted[k]) for k in np.unique(text)])  # texts of a part ascend
                text, start, n, h = text[keep], start[keep], n[keep], h[keep]
                data = [texts[k][s : s + m + min_bytes - 1] for k, s, m in zip(text.tolist(), start.tolist(), n.tolist(), strict=True)]
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(data, pa.binary()), batch.column("id").take(own), batch.column("k1").take(own), batch.column("k2").take(own), pa.array(start, pa.int64())],
                    ["bucket", "data", "id", "k1", "k2", "start"],
                )

    return rows.select("id", "k1", "k2", "t", "hs").mapInArrow(run, f"bucket bigint, data binary, id {kind}, k1 bigint, k2 bigint, start bigint")


STRING = ["bucket", "s1", "s2"]


def _named(strings: DataFrame) -> DataFrame:
    """With the 128 bits s1, s2 that stand for ``data``."""
    return strings.withColumns({"s1": F.xxhash64("data"), "s2": F.xxhash64(F.lit(1), "data")})


def _merged(strings: DataFrame, name: str) -> DataFrame:
    """Equal strings of a bucket as one row with their number n and first place."""
    return materialize(strings.groupBy(*STRING).agg(F.first("data").alias("data"), F.sum("n").alias("n"), F.min("first").alias("first")), name)


def _sorted(strings: DataFrame, min_bytes: int, later_only: bool) -> DataFrame:
    """(bucket, s1, s2, first, spans) by suffix arrays of whole buckets, about SHARD bytes at a time; strings with no repeated window are left out."""
    kind = dict(strings.dtypes)["first"]

    def solve(rows: list[dict]) -> pa.RecordBatch | None:
        place = lambda f: (f["id"] is not None, f["id"] if f["id"] is not None else 0, f["k1"], f["k2"], f["start"])
        rows.sort(key=lambda r: place(r["first"]))
        spans = repeated_windows([r["data"] for r in rows], min_bytes, later_only)
        out = []
        for r, found in zip(rows, spans, strict=True):
            if r["n"] > 1 and not later_only:
                found = [(0, len(r["data"]) - min_bytes + 1)]
            if found or r["n"] > 1:
                out.append({**{k: r[k] for k in (*STRING, "first")}, "spans": [{"a": a, "b": b} for a, b in found]})
        return pa.RecordBatch.from_pylist(out, schema) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SHARD and row["bucket"] != held[-1]["bucket"]:
                    if (got := solve(held)) is not None:
                        yield got
                    held, size = [], 0
                held.append(row)
                size += len(row["data"])
        if held and (got := solve(held)) is not None:
            yield got

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = f"bucket bigint, s1 bigint, s2 bigint, first {kind}, spans array<struct<a:int,b:int>>"
    schema = to_arrow_schema(strings.sparkSession.createDataFrame([], out_schema).schema)
    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out_schema)


def _matched(strings: DataFrame, min_bytes: int, later_only: bool, limit: int, piece: int, read: list[DataFrame]) -> DataFrame:
    """(bucket, s1, s2, first, spans) of merged strings; buckets that are too full are dealt anew by pieces."""
    sizes = strings.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("data")).alias("b"))
    full = materialize(sizes.filter((F.col("c") > limit) | (F.col("c") > 1) & (F.col("b") > FULL)).select("bucket"), "full-buckets")
    read.append(full)
    if piece == 0 or full.isEmpty():
        return _sorted(strings, min_bytes, later_only)
    hot = materialize(strings.join(full, "bucket", "left_semi"), "full-strings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, core, at, n = [], [], [], []
            for k, data in enumerate(batch.column("data").to_pylist()):
                for first, windows, common in piece_cuts(data, min_bytes, piece):
                    keys.append(k)
                    core.append(xxhash.xxh3_64_intdigest(common) - (1 << 63))
                    at.append(first)
                    n.append(windows)
            own = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(own) for c in (*STRING, "n")], pa.array(core, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], [*STRING, "n", "core", "at", "windows"]
            )

    cuts = materialize(hot.select(*STRING, "n", "data").mapInArrow(cut, "bucket bigint, s1 bigint, s2 bigint, n bigint, core bigint, at int, windows int"), "cuts")
    again = cuts.groupBy("core").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("core")
    theirs = cuts.join(again, "core").groupBy(*STRING).agg(F.collect_list(F.struct("core", "at", "windows")).alias("cuts"))  # no more than a run's windows
    named = [F.col(c).alias(f"p_{c}") for c in STRING]
    pieces = hot.join(theirs, STRING).select(*named, "data", "n", "first", F.explode("cuts").alias("cut"))
    moved = F.struct(F.col("first.id").alias("id"), F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), (F.col("first.start") + F.col("cut.at")).alias("start"))
    data = F.expr(f"substring(data, cut.at + 1, cut.windows + {min_bytes - 1})")
    pieces = pieces.select(*[f"p_{c}" for c in STRING], F.col("cut.core").alias("bucket"), F.col("cut.at").alias("at"), data.alias("data"), "n", moved.alias("first"))
    pieces = materialize(_named(pieces), "pieces")
    merged = _merged(pieces.select(*STRING, "data", "n", "first"), "piece-strings")
    read += [hot, cuts, pieces, merged]
    found = _matched(merged, min_bytes, later_only, limit, 1 if piece > 1 else 0, read)
    shifted = F.transform("spans", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b")))
    own = _spans(pieces.withColumn("size", F.length("data")).drop("data", "n"), found, min_bytes, later_only)
    own = own.select(*[F.col(f"p_{c}").alias(c) for c in STRING], F.explode(shifted).alias("x")).groupBy(*STRING).agg(F.collect_list("x").alias("spans"))
    mine = hot.select(*STRING, "first", "n", F.length("data").alias("size")).join(own, STRING, "left").filter("n > 1 OR spans IS NOT NULL")
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    if not later_only:
        spans = F.when(F.col("n") > 1, _whole(F.col("size"), min_bytes)).otherwise(spans)
    mine = mine.select(*STRING, "first", spans.alias("spans"))
    return _sorted(strings.join(full, "bucket", "left_anti"), min_bytes, later_only).unionByName(mine)


_SPANS = "array<struct<a:int,b:int>>"


def _whole(size, min_bytes: int):
    """All windows of a string."""
    return F.array(F.struct(F.lit(0).alias("a"), (size - min_bytes + 1).cast("int").alias("b"))).cast(_SPANS)


def _spans(places: DataFrame, found: DataFrame, min_bytes: int, later_only: bool) -> DataFrame:
    """``places`` (strings with first, their own place, and size) with the spans of repeated windows that were found for their string."""
    theirs = found.withColumnRenamed("first", "__first")
    rows = places.join(theirs, STRING)
    if later_only:
        rows = rows.withColumn("spans", F.when(F.col("first") == F.col("__first"), F.col("spans")).otherwise(_whole(F.col("size"), min_bytes)))
    return rows.drop("__first").filter(F.size("spans") > 0)


def repeated_spans(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_bytes: int = MIN_BYTES, keep: str = "none", limit: int = LIMIT, piece: int = PIECE,
) -> DataFrame:
    """(k1, k2, rep, whole, spans): for each different text with something to take out, the smallest id that has it, whether its other copies go as a whole, and byte spans (a, b).

    The table is written to the shared folder. ``min_bytes`` is at least 2 * GRAM.
    """
    if min_bytes < 2 * GRAM or keep not in ("none", "first"):
        raise ValueError(f"min_bytes {min_bytes}, keep {keep}")
    later_only = keep == "first"
    kind = dict(docs.dtypes)[id_col]
    rows = _keyed(docs, text, id_col)
    texts = materialize(_texts(rows, kind, min_bytes), "suffix-texts")
    marks = texts.select("k1", "k2", F.explode("marks").alias("m")).select("k1", "k2", "m.h", "m.c")
    again = marks.groupBy("h").agg(F.sum("c").alias("all")).filter(F.col("all") > 1).select("h")
    with_marks = marks.join(again, "h").groupBy("k1", "k2").agg(F.collect_list("h").alias("hs"))  # no more than a text's minimizers
    suspects = materialize(with_marks.join(texts.select("k1", "k2", F.col("rep.id").alias("id")), ["k1", "k2"]), "suffix-suspects")

    lay = repeats.one_filter(suspects.count())
    pages = materialize(repeats.build(suspects.select(F.xxhash64("k1", "k2", "id").alias("h")), "h", lay, 1), "suffix-filter")
    tested = repeats.with_hits(rows.filter(F.length("t") >= min_bytes).withColumn("h", F.xxhash64("k1", "k2", "id")), "h", pages, lay, "hit").filter("hit")
    played = tested.groupBy("k1", "k2").agg(F.first("t").alias("t")).join(suspects, ["k1", "k2"])
    runs = materialize(_named(_runs(played, kind, min_bytes)).withColumn("first", F.struct("id", "k1", "k2", "start")).drop("id", "start"), "suffix-runs")
    strings = _merged(runs.withColumn("n", F.lit(1).cast("bigint")).select(*STRING, "data", "n", "first"), "suffix-strings")
    read = [pages, suspects, runs, strings]
    found = _matched(strings, min_bytes, later_only, limit, piece, read)
    spans = _spans(runs.select(*STRING, "k1", "k2", "first", F.length("data").alias("size")), found, min_bytes, later_only)
    x = F.struct((F.col("x.a") + F.col("first.start")).alias("a"), (F.col("x.b") + F.col("first.start") + (min_bytes - 1)).alias("b"))
    spans = spans.withColumn("x", F.explode("spans")).select("k1", "k2", x.alias("x")).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("x")).alias("spans"))
    long = "array<struct<a:bigint,b:bigint>>"
    copied = texts.filter("copies > 1").select("k1", "k2", "size", F.lit(True).alias("whole"))
    both = spans.join(copied, ["k1", "k2"], "full").join(texts.select("k1", "k2", "rep"), ["k1", "k2"])
    part = F.coalesce("spans", F.array().cast(long))
    if not later_only:
        part = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("b")))).otherwise(part)
    out = materialize(both.select("k1", "k2", F.col("rep.id").alias("rep"), F.coalesce("whole", F.lit(False)).alias("whole"), part.cast(long).alias("spans")), "suffix-spans")
    discard(texts, *read)
    return out


def joined_spans(spans: list[dict], limit: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans, ascending by their start, as one."""
    out: list[list[int]] = []
    for x in spans:
        a, b = x["a"], min(x["b"], limit)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def drop_repeats(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_bytes: int = MIN_BYTES, keep: str = "none", limit: int = LIMIT, piece: int = PIECE, max_bytes: int = repeats.MAX_BYTES,
) -> DataFrame:
    """id, n_bytes, removed (array of byte spans a, b) and kept (binary) of every row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    found = repeated_spans(docs, text, id_col, min_bytes, keep, limit, piece)
    lay = repeats.one_filter(found.count(), max_bytes)
    pages = materialize(repeats.build(found.select(F.xxhash64("k1", "k2").alias("h")), "h", lay, 1), "suffix-losers")
    rows = repeats.with_hits(_keyed(docs, text, id_col).withColumn("h", F.xxhash64("k1", "k2")), "h", pages, lay, "hit")
    kept = "array<struct<a:bigint,b:bigint>>"
    past = rows.filter("NOT hit").select("id", F.length("t").cast("bigint").alias("n_bytes"), F.array().cast(kept).alias("removed"), F.col("t").alias("kept"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.length("t").cast("bigint").alias("b")))
    goes = F.coalesce("whole", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("rep")) if keep == "first" else F.lit(False)
    hits = rows.filter("hit").join(found, ["k1", "k2"], "left")
    hits = hits.select("id", "t", F.when(goes, whole).otherwise(F.coalesce("spans", F.array().cast(kept))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, left = [], [], []
            for t, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = joined_spans(spans, len(t))
                ends = [0, *[b for _, b in gone]]
                starts = [*[a for a, _ in gone], len(t)]
                sizes.append(len(t))
                removed.append([{"a": a, "b": b} for a, b in gone])
                left.append(b"".join(t[a:b] for a, b in zip(ends, starts, strict=True)))
            spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, spans_type), pa.array(left, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    out = past.unionByName(hits.mapInArrow(run, f"id {kind}, n_bytes bigint, removed {kept}, kept binary"))
    return out.withColumnRenamed("id", id_col)
