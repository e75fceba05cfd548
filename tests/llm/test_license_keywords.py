import itertools
import re
from re import _parser

import pytest

from voxlake.llm import license_scan
from voxlake.llm.license_rules import rules


def matches(parsed):
    """Every text a pattern of literals, sets, groups, branches and short repeats can match; look-aheads count as empty."""
    texts = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif name == "BRANCH":
            more = [t for p in arg[1] for t in matches(p)]
        elif name == "SUBPATTERN":
            more = matches(arg[3])
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            more = ["".join(t) for n in {low, high} for t in itertools.product(matches(inner)[:1] if n > 1 else matches(inner), repeat=n)]
        elif name == "ASSERT_NOT":
            more = [""]
        else:
            raise AssertionError(name)
        texts = [a + b for a in texts for b in dict.fromkeys(more)]
    return texts


def test_every_alternative_of_a_rule_holds_its_keyword():
    lost = {(r.label, r.keyword, t) for r in rules() for t in matches(_parser.parse(r.pattern)) if r.keyword not in t}
    assert not lost, sorted(lost)[:3]


def test_alternatives_are_what_the_pattern_matches():
    for r in rules()[::25]:
        assert all(re.fullmatch(r.pattern, t) for t in matches(_parser.parse(r.pattern)))


@pytest.mark.parametrize("text,label", [("PSF License 2", "python-2"), ("all right reserved", "reserved"), ("under the psf licence", "python"), ("some right reserved", "reserved")])
def test_phrases_without_the_old_keyword_are_found(text, label):
    assert label in license_scan.scanner().scan(text)[5].split(",")
