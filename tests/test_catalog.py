"""Golden constants that follow from the rule catalogues."""

import collections

from chainscope.catalog.behavior_rules import BEHAVIOR_RULES
from chainscope.catalog.scan_rules import CWE_NAMES, SCAN_RULES
from chainscope.functions.regex import re2_compatible, to_java


def test_rule_counts():
    assert len(SCAN_RULES) == 99
    assert len({r[0] for r in SCAN_RULES}) == 99
    assert len({r[2] for r in SCAN_RULES}) == 60
    assert len(CWE_NAMES) == 60
    cats = collections.Counter(r[1] for r in SCAN_RULES)
    assert cats == {"A01:2021": 10, "A02:2021": 10, "A03:2021": 12, "A04:2021": 5, "A05:2021": 8, "A06:2021": 5,
                    "A07:2021": 8, "A08:2021": 6, "A09:2021": 5, "A10:2021": 6, "EXTRA": 24}
    sev = collections.Counter(r[3] for r in SCAN_RULES)
    assert sev == {"critical": 33, "high": 28, "medium": 32, "low": 6}


def test_behavior_rules():
    assert len(BEHAVIOR_RULES) == 35
    cats = collections.Counter(r[3] for r in BEHAVIOR_RULES)
    assert cats == {"network": 8, "code-execution": 6, "filesystem": 6, "obfuscation": 5, "process": 3,
                    "environment": 3, "prototype-pollution": 2, "install-script": 2}


def test_re2_subset():
    bad = [r[0] for r in SCAN_RULES if not re2_compatible(r[6])]
    assert bad == ["A08-cdn-no-sri", "A09-missing-auth-logging", "A09-error-info-leak", "TS-any-abuse"]
    assert all(re2_compatible(r[1]) for r in BEHAVIOR_RULES)


def test_word_boundary_is_ascii():
    j = to_java(r"\beval\(", "g")
    assert "\\b" not in j and "(?<![A-Za-z0-9_])" in j
    assert to_java(r"[\b]x", "") == r"[\b]x"  # inside a class it stays
    assert to_java("abc", "gi").startswith("(?i)")


def test_scores():
    import math
    # one critical behaviour finding -> 3.1; one critical source finding -> 39
    assert math.floor(10 * (1 - math.exp(-3 / 8)) * 10 + 0.5) / 10 == 3.1
    assert math.floor(100 * (1 - math.exp(-10 / 20)) + 0.5) == 39
