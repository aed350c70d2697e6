from collections import Counter

from scanforge.operators.rule_hints import HINTS
from scanforge.operators.rules import builtin_rules, leak_rules, rules_by_language, rules_by_owasp
from scanforge.operators.rules_data import LEAK_RULES, SAST_RULES


def test_rule_counts():
    assert len(SAST_RULES) == 102
    assert len(LEAK_RULES) == 35
    langs = Counter(r[1] for r in SAST_RULES)
    assert langs == {"Python": 24, "Java": 20, "JavaScript": 16, "Go": 8, "PHP": 7, "C#": 5, "Terraform": 5,
                     "Kotlin": 4, "Shell": 4, "Kubernetes": 3, "HTML": 3, "Generic": 3}
    assert Counter(r[2] for r in SAST_RULES) == {"CRITICAL": 14, "HIGH": 53, "MEDIUM": 28, "LOW": 7}
    assert Counter(r[2] for r in LEAK_RULES) == {"CRITICAL": 21, "HIGH": 12, "MEDIUM": 2}
    assert Counter(r[3] for r in SAST_RULES) == {"A04": 31, "A05": 25, "A02": 13, "A01": 11, "A07": 7, "A08": 7,
                                                 "A10": 4, "A09": 3, "A06": 1}
    assert sorted(r[0] for r in SAST_RULES if r[8]) == ["HTML-003", "JS-014"]


def test_every_rule_has_hints():
    ids = {r[0] for r in SAST_RULES} | {r[0] for r in LEAK_RULES}
    assert ids == set(HINTS)
    assert all(h == h.lower() for hs in HINTS.values() for h in hs)


def test_listings(spark):
    rows = {r.language: r.n_rules for r in rules_by_language(builtin_rules(spark)).collect()}
    assert rows["TOTAL"] == 102 and rows["Python"] == 24
    ow = {r.owasp[:3]: r.n_rules for r in rules_by_owasp(builtin_rules(spark)).collect()}
    assert ow["A04"] == 31 and "A03" not in ow
    assert leak_rules(spark).count() == 35
