import random
import re
from re import _parser

import pytest

from test_license_keywords import matches
from voxlake.llm import license_scan
from voxlake.llm.license_rules import BASE, rules


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spots, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        spots += hits
        labels |= {label} if hits else set()
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "cc by", "CC-BY cc by CC BY-SA 4.0", "GNU General Public License, version 3. All rights reserved.", "ALL RIGHTS RESERVED all rights reserved",
    "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "nothing here", "accby ccby bycc by cc", "générale public license",
    "the GNU Lesser General Public License v2.1", "(c) Creative Commons Attribution-ShareAlike 4.0 license", "Ünïcode cc by ünï", "\x00cc\x00by\x00",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "Copyright (c) 2020", "general public license " * 5000, "İ cc by K",
]


def test_base_columns_equal_brute_force():
    scan = license_scan.scanner().scan
    for t in TEXTS:
        got = scan(t or "")
        assert got[:5] == brute_base(t), t
        assert set(got[4].split(",")) - {""} <= set(got[5].split(","))
        assert 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])


def labels(text):
    return license_scan.scanner().scan(text)[5]


def test_higher_priority_suppresses_what_it_contains():
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache-2.0"
    assert labels("SPDX-License-Identifier: MIT") == "mit"
    assert labels("the GNU Lesser General Public License v2.1 applies") == "gpl,lgpl-2.1"  # gpl is a base label
    assert labels("CC BY-SA 4.0") == "cc-by,cc-by-sa-4.0"
    assert labels("a plain text about apaches and mittens") == ""
    assert labels("Copyright (c) 2020") == "copyright"


def test_rules_are_hundreds_and_distinct():
    assert len({r.pattern for r in rules()}) == len(rules()) >= 200


def naive(text):
    """All rules without a gate, longest first inside a priority, and every span held against every other."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = [(r.priority, m.start(), m.end(), r) for r in rules() for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined)]
    found.sort(key=lambda f: (-f[0], f[1], -f[2], f[3].label))
    taken = []
    for f in found:
        if not any(t[1] <= f[1] and f[2] <= t[2] for t in taken):
            taken.append(f)
    weights = {}
    for label in {label for phrase, label in BASE if f" {phrase} " in joined}:
        weights[label] = license_scan.BASE_WEIGHT
    for *_, r in taken:
        weights[r.label] = max(weights.get(r.label, 0.0), r.weight)
    miss = 1.0
    for label in sorted(weights):
        miss *= 1 - weights[label]
    return ",".join(sorted(weights)), 1 - miss


def test_labels_and_score_equal_a_scan_of_all_rules():
    rnd = random.Random(4)
    parts = [t for r in rules() for t in matches(_parser.parse(r.pattern))[:3]]
    words = sorted({w for p in parts for w in p.split()})
    texts = TEXTS + parts
    for _ in range(1500):
        chosen = [rnd.choice(parts) if rnd.random() < 0.6 else " ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(chosen))
    for t in texts:
        got = license_scan.scanner().scan(t or "")
        assert (got[5], got[6]) == (naive(t)[0], pytest.approx(naive(t)[1])), t


def test_table(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "cc by", 2), (2, "cc by", 3)], "doc_id bigint, text string, score int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
