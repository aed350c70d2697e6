import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanforge.functions.regex import _BOUNDARY, literal_first, to_java, whole_word
from scanforge.operators import gram_index as g
from scanforge.operators import literals as L
from scanforge.operators.sast import match_rules
from tests.test_gram_index import _all, _lines, _rules


def _text(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))


@pytest.mark.parametrize("block,pairs", [(1 << 20, 1 << 20), (7, 3), (1, 1)])
def test_found_as_by_contains(monkeypatch, block, pairs):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "PAIRS", pairs)
    rnd = random.Random(block)
    for letters in ("ab", "ab ü€\U0001f600"):
        texts = [_text(rnd, letters, 60) for _ in range(60)]
        parts = (x[i:i + rnd.choice((3, 4, 5, 8, 9, 16, 17, 30))] for x in texts for i in (0, rnd.randrange(60)))
        words = sorted({w for w in [*parts, *(_text(rnd, letters, 12) for _ in range(40))] if len(w) >= 3})
        entries = [(w, rnd.choice(sorted(g.grams_of(w))), i // 2, False) for i, w in enumerate(words)]  # owners of two literals
        lines = [None, "", *texts, "", None, words[0], "a" * 300 + words[1]]
        held = L.Literals(entries, len(words) // 2 + 1)
        want = [sorted({o for w, _, o, _ in entries if x and w in x}) for x in lines]
        assert sum(map(len, want)) > 50
        for kind in (pa.string(), pa.large_string()):
            assert held.lists(pa.array(lines, kind)).to_pylist() == want
        assert held.lists(pa.array(lines).slice(5, 40)).to_pylist() == want[5:45]
        assert held.counts(pa.array(lines)).tolist() == [sum(o in x for x in want) for o in range(held.owners)]
    assert L.Literals([], 0).lists(pa.array(["abc", None])).to_pylist() == [[], []]
    assert held.lists(pa.array([], pa.string())).to_pylist() == [] and held.lists(pa.array([None], pa.string())).to_pylist() == [[]]


def test_a_word_apart_is_not_looked_at_inside_other_words():
    held = L.Literals([("needle", "nee", 0, True)], 1)
    lines = ["needle", "xneedle", "needles", "needlex", "_needle", "a-needle.", "xneedle needle", "needle9", "üneedle€", "x", "needle"]
    assert held.lists(pa.array(lines)).to_pylist() == [[0], [], [0], [], [], [0], [0], [], [0], [], [0]]  # an s may come from U+017F


def test_words_next_to_letters_that_fold_to_ascii(spark):
    rules = _rules(spark)
    odd = [f"{a}needle{b}" for a in ("", "K", "İ", "ſ", "k", "é", "-", "9") for b in ("", "K", "İ", "ſ", "s", "é", ".", "_")]
    lines = spark.createDataFrame([("Go", i, x) for i, x in enumerate([*odd, *("x" + x + " " + x for x in odd)])], "language string, line_no int, line string")
    cols = ("line_no", "rule_id", "column")
    want = _all(match_rules(lines, rules), *cols)
    assert len(want) > 200
    assert _all(g.match_rules_indexed(lines, rules), *cols) == want


def test_a_boundary_behind_its_word_matches_the_same(spark):
    patterns = [r"\bneedle\b", r"\bneedles+x", r"\bneedle{2}", r"\bneed|straw", r"\bneedl?e", r"\b\w+need", r"(?i)\bneedle", r"\bne\b", r"\bneedle[0-9]*\b", r"\bneedle\b-", r"\bneedles\b|\bstraw\b"]
    moved = [p for p in patterns if _BOUNDARY not in literal_first(to_java(p))[:len(_BOUNDARY) + 8]]
    assert moved == [patterns[i] for i in (0, 1, 2, 3, 4, 8, 9, 10)]
    rnd = random.Random(5)
    parts = ["need", "needle", "e", "s", "x", " ", "straw", "ne", "7", "-", "ü", "l"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(7))) for _ in range(400)]
    lines = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        java = to_java(p)
        was, now = (F.array(F.regexp_instr("t", F.lit(x)), F.length(F.regexp_extract("t", x, 0))) for x in (java, literal_first(java)))
        assert lines.where(was != now).count() == 0
    assert [whole_word(p) for p in (r"\bNeedle\b", r"(?i)\bneedle\b", r"\bneedle", r"\ba|b\b", r"\bab+\b")] == ["needle", None, None, None, None]


def test_lines_are_read_once_and_a_pattern_is_evaluated_once(spark):
    """grams were joined as rows, each pattern stood in the plan several times, and rules without literals read the lines again."""
    lines, rules = _lines(spark), _rules(spark)  # one rule has no literal
    plan = g.match_rules_indexed(lines, rules, counts={})._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    assert len(re.findall(r"regexp_instr\(_sline#\d+, _rx#", plan)) == 1
    assert "regexp_extract_all" not in plan
