"""Encoding of text columns with a vocabulary file of the tokenizers library.

``TextEncoder`` gives the same ids as ``Tokenizer.encode(text)``. Byte-level
splitting never joins a non-blank character with a following blank, so a text can
be cut before every blank that follows a non-blank and its pieces be encoded each
on its own. Pieces are split into words by the byte-level pattern and new words are
encoded by the tokenizer's model; pieces and words are kept in bounded caches.
Other tokenizers (a normalizer, a prefix blank, no byte-level splitting) get whole texts.

With ``added`` the file's added tokens, such as <|endoftext|>, are met in texts as the library
does by default, and a text that holds one is encoded whole. Without it they are ordinary text.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Strings held at once, at most twice as many: pieces after a blank, first pieces of texts, words of other pieces.
CACHE, FIRST_CACHE, WORD_CACHE = 300_000, 50_000, 100_000
LONG_PIECE = 64
ROWS = 512
#: Fixed values of byte-level tokenizers: the pattern that splits a text into words, and the bytes that are shown as themselves.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The others are shown as the characters from U+0100 on, in their order.
BYTE_CHARACTERS = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_SHOWN_BLANK = chr(BYTE_CHARACTERS[0x20])
#: A short cut for the commonest pieces: one word of Latin-1 letters, or one and then marks.
_PLAIN, _MARKS = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+").fullmatch, ",.;:!?"
#: Python's \s holds every blank of the tokenizers' pattern and a few more, so \S is never one of theirs.
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
_BLANK_BEFORE_BLANK = re.compile(r"\s ")


class Memo(dict):
    """Bytes of strings, encoded when first asked for.

    When ``limit`` strings are known they become the older half, of which only those asked for
    again are carried on, so frequent strings stay and at most twice ``limit`` are held. Strings of
    over LONG_PIECE characters aren't held.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.pop(key, None)
        if got is None:
            got = self.encode(key)
        if len(key) <= LONG_PIECE:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class Pieces(Memo):
    """Ids of ``lead`` and a piece. Only plain words are held; other pieces are put together from words, as few come again.

    ``after_blank``, where given, has the ids of pieces that begin with a blank, by what follows it.
    """

    def __init__(self, lead: str, words: Memo, find: Callable[[str], list[str]], tokenize: Callable[[str], list], limit: int, after_blank: Memo | None = None):
        super().__init__(words.encode, limit)
        self.lead, self.shown_lead = lead, lead.replace(" ", _SHOWN_BLANK)
        self.words, self.find, self.tokenize, self.after_blank = words, find, tokenize, after_blank

    def __missing__(self, piece: str) -> bytes:
        got = self.older.pop(piece, None)
        if got is None:
            if not _PLAIN(piece):
                return self.joined(piece)
            if piece.isascii():  # these letters are shown as themselves
                got = array("I", [k.id for k in self.tokenize(self.shown_lead + piece)]).tobytes()
            else:
                got = self.encode(self.lead + piece)
            if len(piece) > LONG_PIECE:
                return got
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = got
        return got

    def joined(self, piece: str) -> bytes:
        if self.after_blank is not None and piece[0] == " ":
            return self.after_blank[piece[1:]]
        word = piece.rstrip(_MARKS)
        if len(word) < len(piece) and _PLAIN(word):
            return self[word] + self.words[piece[len(word) :]]
        return b"".join(map(self.words.__getitem__, self.find(self.lead + piece)))


def cut(text: str) -> tuple[list[str], list[str]]:
    """Pieces that can be encoded each on its own, the second list without their leading blank."""
    if _BLANK_BEFORE_BLANK.search(text):
        return _BEFORE_BLANK.split(text), []
    head, *parts = text.split(" ")
    return [head] if head else [], parts


class TextEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        self.apart = [t.content for k, t in sorted(self.tok.get_added_tokens_decoder().items()) if added or not t.special]
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = repr(self.tok.pre_tokenizer)
        plain = self.tok.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre
        if plain:
            import regex

            self.tokenize = self.tok.model.tokenize
            words, find = Memo(self.model_ids, WORD_CACHE), regex.compile(BYTE_LEVEL).findall
            self.after_blank = Pieces(" ", words, find, self.tokenize, CACHE)
            self.first = Pieces("", words, find, self.tokenize, FIRST_CACHE, self.after_blank)
        else:
            self.first = None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def model_ids(self, word: str) -> bytes:
        shown = word.replace(" ", _SHOWN_BLANK) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array("I", [k.id for k in self.tokenize(shown)]).tobytes()

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        first, after_blank = self.first.__getitem__, self.after_blank.__getitem__
        out = []
        for t in texts:
            heads, tails = cut(t)
            out.append(b"".join([*map(first, heads), *map(after_blank, tails)]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.first is None:
            return self.whole(texts)
        collecting = gc.isenabled()
        gc.disable()  # the caches hold no cycles, only many objects to walk over
        try:
            held = [k for k, t in enumerate(texts) if any(c in t for c in self.apart)]
            if not held:
                return self.by_pieces(texts)
            apart = set(held)
            rest = [k for k in range(len(texts)) if k not in apart]
            got = dict(zip(held, self.whole([texts[k] for k in held]), strict=True))
            got.update(zip(rest, self.by_pieces([texts[k] for k in rest]), strict=True))
            return [got[k] for k in range(len(texts))]
        finally:
            if collecting:
                gc.enable()


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False) -> TextEncoder:
    """One encoder for each file, way of added tokens and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(path, added)


def encoded_batches(batches: Iterator[pa.RecordBatch], text: str, path: str, added: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of their texts (null: empty)."""
    enc = encoder(path, added)
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, enc([t or "" for t in part.column(text).to_pylist()])


def with_token_counts(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", added: bool = False) -> DataFrame:
    """id and n_tokens of every row; an empty or null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in encoded_batches(batches, text, path, added):
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "n_tokens"]
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text).mapInArrow(count, f"`{id_col}` {kind}, n_tokens bigint")
