"""License scan with ordered signature rules.

A text's words are its runs of ASCII letters and digits (A-Z lower-cased first) and
characters above U+007F, joined by single blanks. A search for the rules' keywords comes
first; only rules whose keyword occurs are run. Detections are taken in order of priority;
one whose span lies inside a span already taken is suppressed. The base phrases are counted
apart and always keep their labels.

score = 1 - product of (1 - weight) over the labels found, 0 without any; a base label
alone weighs BASE_WEIGHT. Null and empty texts have no words and no labels; every row has a
result, also repeated ones; an empty table gives none; a very long text is scanned whole, in its row.
Of detections of one priority the one that starts first is taken first, then the longer, then by label.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import BASE, Rule, rules

BASE_WEIGHT = 0.5
_BLANK_OUT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def joined_words(text: str) -> tuple[str, int]:
    """The words joined by blanks, with a blank at both ends, and their number."""
    words = text.encode().lower().translate(_BLANK_OUT).split()
    return f" {b' '.join(words).decode()} ", len(words)


class Scanner:
    def __init__(self, ordered: tuple[Rule, ...]):
        import ahocorasick

        self.ordered = ordered
        self.regexes = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in ordered]
        self.gate = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(ordered):
            by_keyword.setdefault(r.keyword, []).append(k)
        for word, which in by_keyword.items():
            self.gate.add_word(word, which)
        self.gate.make_automaton()

    def detections(self, joined: str) -> list[tuple[int, int, Rule]]:
        """(first character, end, rule) of what stays, by priority, then length, then place."""
        allowed = {k for _, which in self.gate.iter(joined) for k in which}
        found: dict[int, list[tuple[int, int, Rule]]] = {}
        for k in sorted(allowed):
            r = self.ordered[k]
            found.setdefault(r.priority, []).extend((m.start(), m.end(), r) for m in self.regexes[k].finditer(joined))
        taken: list[tuple[int, int, Rule]] = []
        starts: list[int] = []
        ends: list[int] = []
        for priority in sorted(found, reverse=True):
            level, reach = [], -1
            for start, end, r in sorted(found[priority], key=lambda d: (d[0], -d[1], d[2].label)):
                at = bisect_right(starts, start)
                if end > reach and not (at and ends[at - 1] >= end):
                    level.append((start, end, r))
                    reach = end
            taken += level
            spans = sorted((s, e) for s, e, _ in taken)
            starts, ends, most = [s for s, _ in spans], [], -1
            for _, e in spans:
                most = max(most, e)
                ends.append(most)
        return taken

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        joined, n_words = joined_words(text)
        base, spots = set(), []
        for phrase, label in BASE:
            at = joined.find(f" {phrase} ")
            while at >= 0:
                base.add(label)
                spots.append(at)
                at = joined.find(f" {phrase} ", at + 1)
        weights = dict.fromkeys(base, BASE_WEIGHT)
        for _, _, r in self.detections(joined):
            weights[r.label] = max(weights.get(r.label, 0.0), r.weight)
        miss = 1.0
        for label in sorted(weights):
            miss *= 1 - weights[label]
        first, last = (joined.count(" ", 0, min(spots)), joined.count(" ", 0, max(spots))) if spots else (None, None)
        return n_words, len(spots), first, last, ",".join(sorted(base)), ",".join(sorted(weights)), 1 - miss


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


OUT = (("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"))


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
        scan = scanner().scan
        for batch in batches:
            rows = [scan(t or "") for t in batch.column(text).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(OUT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array(c, kinds[k]) for c, (_, k) in zip(cols, OUT, strict=True)]], [id_col, *[n for n, _ in OUT]]
            )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} {k}" for n, k in OUT)
    return docs.select(id_col, text).mapInArrow(run, schema)
