"""Byte-level BPE encoding and decoding with a rank file.

Every match of the pattern is a word. A word that is a token is that token; the others
start as their bytes and, as long as two neighbours together form a token, the pair of
the lowest rank is merged, the leftmost of equals first. Words are encoded together: equal
words once, sorted into buckets of similar length, each bucket a padded matrix with one row
a word, cut by rows to at most CELLS cells where a row has fewer. In every round each row merges
its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table;
finished rows leave and the columns close up over what was merged. The row's other pairs of that
rank would be the next to be merged, from left to right, until one makes a pair of a lower rank; so the
same round merges them too, up to that one, which keeps the rounds few where a word is long. Words
of any length go this way.

Null texts count as empty: no ids, the empty digest. Every row has a result, repeated rows
and rows without an id too; an empty table gives none; a very long text is encoded whole, in
its row. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import BYTE_LEVEL, LONG_PIECE, ROWS, cut

CELLS = 1 << 17
CACHE = 200_000
#: A short cut for the commonest pieces of the byte-level pattern: one word of Latin-1 letters, then marks.
_PLAIN = re.compile(r"( ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([,.;:!?]*)").fullmatch
NONE = np.int64(1) << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PieceCache:
    """Bytes of pieces, filled by ``encode`` for those not known yet.

    When ``limit`` pieces are known they become the older half, of which only those met
    again are carried on, so frequent pieces stay and at most twice ``limit`` are held.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE):
        self.encode, self.limit, self.known, self.older, self.long = encode, limit, {}, {}, []

    def fill(self, pieces: set[str]) -> dict[str, bytes]:
        missing = pieces.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known, self.older = {}, self.known
                missing = pieces
            if again := self.older.keys() & missing:
                self.known.update((p, self.older[p]) for p in again)
                missing = missing - again
            order = list(missing)
            self.known.update(zip(order, self.encode(order), strict=True))
            self.long += [p for p in order if len(p) > LONG_PIECE]
        return self.known

    def forget_long(self) -> None:
        for p in self.long:
            self.known.pop(p, None)
        self.long = []


def by_pieces(texts: list[str], first: PieceCache, after_blank: PieceCache) -> list[bytes]:
    """The joined bytes of each text's pieces. ``after_blank`` holds pieces without their leading blank."""
    heads, tails = zip(*map(cut, texts), strict=True) if texts else ((), ())
    h, a = first.fill(set().union(*heads)), after_blank.fill(set().union(*tails))
    out = [b"".join([h[p] for p in whole] + list(map(a.__getitem__, parts))) for whole, parts in zip(heads, tails, strict=True)]
    first.forget_long()
    after_blank.forget_long()
    return out


class PairTable:
    """Rank of the token that two neighbouring tokens form, NONE if they form none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(10, int(4 * len(rank)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        keys, slots = self._key(left, right), self._slot(self._key(left, right))
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            _, firsts = np.unique(slots[free], return_index=True)
            put = free[firsts]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], rank[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 31 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        slots = self._slot(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
            at = self.keys[slots[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (at != -1)]
        return out


class RankBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token_bytes = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable(*pairs.T)
        self.last = self._last(pairs)
        self.find = regex.compile(pattern).findall
        self.plain = _PLAIN if pattern == BYTE_LEVEL else lambda p: None
        self.words = PieceCache(self._words)
        self.first = PieceCache(self._pieces)
        self.after_blank = PieceCache(lambda ps: self._pieces([" " + p for p in ps]))

    def _last(self, pairs: np.ndarray) -> np.ndarray:
        """By rank: whether every pair that the token is part of has a higher rank than it."""
        lowest = np.full(max(self.token_bytes) + 1, NONE)
        np.minimum.at(lowest, pairs[:, 0], pairs[:, 2])
        np.minimum.at(lowest, pairs[:, 1], pairs[:, 2])
        return lowest > np.arange(len(lowest))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return by_pieces(texts, self.first, self.after_blank)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        plain, find = self.plain, self.find
        found = [m.groups() if (m := plain(p)) else find(p) for p in pieces]
        distinct = set().union(*found)
        distinct.discard("")
        known = self.words.fill(distinct)
        known[""] = b""
        out = [b"".join(map(known.__getitem__, words)) for words in found]
        self.words.forget_long()
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        data = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(data)
        buckets: dict[int, list[int]] = {}
        for k, d in enumerate(data):
            if (r := self.ranks.get(d)) is not None:
                out[k] = np.uint32(r).tobytes()
            else:
                buckets.setdefault((len(d) - 1).bit_length(), []).append(k)
        for size, rows in buckets.items():
            most = max(1, CELLS >> size)
            for i in range(0, len(rows), most):
                part = rows[i : i + most]
                for k, ids in zip(part, self._matrix([data[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def _ranks(self, m: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at these places."""
        out = np.full(len(row), NONE)
        inside = column + 1 < m.shape[1]
        right = np.where(inside, m[row, np.where(inside, column + 1, 0)], -1)
        there = np.flatnonzero(right >= 0)
        out[there] = self.pairs(m[row[there], column[there]], right[there])
        return out

    def _stop(self, m: np.ndarray, merged: np.ndarray, low: np.ndarray, wary: np.ndarray) -> None:
        """In ``wary`` rows, keep in ``merged`` no place after the first whose merge makes a pair of a lower rank."""
        rows = np.flatnonzero(wary)
        row, at = np.nonzero(merged[rows])
        row = rows[row]
        new = low[row]
        before = np.where(at > 0, m[row, np.maximum(at - 1, 0)], -1)
        before = np.where((at > 1) & merged[row, np.maximum(at - 2, 0)], new, before)
        after = np.where(at + 2 < m.shape[1], m[row, np.minimum(at + 2, m.shape[1] - 1)], -1)
        lower = np.zeros(len(row), bool)
        for left, right in ((before, new), (new, after)):
            there = np.flatnonzero((left >= 0) & (right >= 0))
            lower[there] |= self.pairs(left[there], right[there]) < new[there]
        if lower.any():
            end = np.full(len(m), m.shape[1])
            np.minimum.at(end, row[lower], at[lower])
            stopped = np.flatnonzero(end < m.shape[1])
            merged[stopped] &= np.arange(m.shape[1]) <= end[stopped, None]

    def _matrix(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        held = np.arange(int(lengths.max())) < lengths[:, None]
        m = np.full(held.shape, -1, np.int64)
        m[held] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        pair = np.full(held.shape, NONE)
        pair[held] = self._ranks(m, *np.nonzero(held))
        out: list[bytes] = [b""] * len(words)
        which = np.arange(len(words))
        while len(which):
            low = pair.min(1)
            ended = low >= NONE
            if ended.any():
                rows = m[ended]
                there = rows >= 0
                ids = rows[there].astype("<u4").tobytes()
                ends = (4 * np.cumsum(there.sum(1))).tolist()
                for k, a, b in zip(which[ended].tolist(), [0, *ends], ends):
                    out[k] = ids[a:b]
                live = ~ended
                m, pair, which, low = m[live], pair[live], which[live], low[live]
                if not len(which):
                    break
            merged = pair == low[:, None]
            if (merged[:, 1:] & merged[:, :-1]).any():  # of pairs that share a token the left one goes first: every second of a run
                at = np.arange(m.shape[1])
                start = merged.copy()
                start[:, 1:] &= ~merged[:, :-1]
                merged &= (at - np.maximum.accumulate(np.where(start, at, 0), axis=1)) % 2 == 0
            count = merged.sum(1)
            if (wary := (count > 1) & ~self.last[low]).any():
                self._stop(m, merged, low, wary)
                count = merged.sum(1)
            m[merged] = np.repeat(low, count)
            stays = m >= 0
            stays[:, 1:] &= ~merged[:, :-1]
            lengths = stays.sum(1)
            held = np.arange(int(lengths.max())) < lengths[:, None]
            closed, ranks, fresh = np.full(held.shape, -1, np.int64), np.full(held.shape, NONE), np.zeros(held.shape, bool)
            closed[held], ranks[held], fresh[held] = m[stays], pair[stays], merged[stays]
            fresh[:, :-1] |= fresh[:, 1:]
            spots = np.nonzero(fresh)
            ranks[spots] = self._ranks(closed, *spots)
            m, pair = closed, ranks
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> RankBpe:
    """One for each file and Python worker."""
    return RankBpe(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and digests of the ids and of the bytes decoded from them. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = bpe([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and ids (array of integers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = bpe([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in ids], pa.list_(pa.int32()))], [id_col, "ids"]
            )

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of every row of ``encoded``; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, text string")
