from tests.conftest import files_df
from pyspark.sql import functions as F

from scanforge.functions.regex import literal_hints
from scanforge.operators import gram_index as g
from scanforge.operators.matching import Rule, explode_lines
from scanforge.operators.rules import builtin_rules
from scanforge.operators.sast import match_rules
from scanforge.operators.secrets import match_secrets

RULES = [  # id, language, pattern, anti-pattern
    ("a", "Generic", r"\bneedle\b", None), ("b", "Python", r"(?i)NEEDLE|straw", "safe"), ("c", "Go", "needle", None), ("d", "Generic", r"^\s*[0-9]+$", None),
    ("e", "Generic", r"(?i)Kelvin|Strasse", None), ("f", "Generic", "ab", None), ("g", "Generic", "abcabc|cabcab", None), ("a", "Generic", r"\bneedle\b", None),
]
LINES = ["needle", "a needle and STRAW needle", "straw safe", "needles straw", "12", "  77", "Kelvin", "ſtrasse", "xxab", "abcabcabc", "ÄÖ needle\r", "", "ab\U0001f600needle needle",
         "n" * 5000 + "needle"]


def _rules(spark):
    rows = [(i, lang, rx, anti, "LOW", None, k) for k, (i, lang, rx, anti) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, language string, pattern string, anti_pattern string, severity string, hints array<string>, rule_ord int")


def _lines(spark):
    rows = [(lang, i, x) for lang in ("Python", "Go", "Generic", None) for i, x in enumerate([*LINES, None])]
    return spark.createDataFrame(rows, "language string, line_no int, line string")


def _all(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_same_hits_as_the_expression_plan(spark):
    lines, rules, cols = _lines(spark), _rules(spark), ("language", "line_no", "line", "rule_id", "column")
    want = _all(match_rules(lines, rules), *cols)
    assert len(want) > 30
    assert _all(g.match_rules_indexed(lines, rules), *cols) == want
    assert _all(g.match_rules_indexed(lines, rules, limit=100), *cols) == want  # an index of many parts
    assert _all(g.match_rules_indexed(lines, rules, counts={}), *cols) == want  # any choice of grams gives the same


def test_built_in_rules_on_samples(spark):
    from scanforge.sources.files import detect_language
    from scanforge.sources.rule_samples import samples
    files = detect_language(files_df(spark, [(path, text) for _, path, text in samples()]))
    lines = explode_lines(files)
    assert match_rules(lines).select("rule_id").distinct().count() > 80
    cols = ("path", "line_no", "rule_id", "column")
    assert _all(g.match_rules_indexed(lines), *cols) == _all(match_rules(lines), *cols)
    cols = ("path", "line_no", "rule_id", "match", "entropy_gated", "severity")
    assert _all(g.match_secrets_indexed(lines), *cols) == _all(match_secrets(lines), *cols)


def test_most_rules_are_in_the_index(spark):
    from scanforge.operators.catalog import Catalog
    cat = Catalog(spark)
    held, rest = g.split_rules(cat.sast_specs + cat.leak_specs)
    assert len(held) >= 120 and len(held) + len(rest) == 137


def test_rarest_gram_and_one_meeting_a_rule(spark):
    rule = Rule(0, "r", None, "abcd|bcde", None, ("abcd", "bcde"))
    rows = g.index_rows([(rule, ["abcd", "bcde"])], {"abc": 9, "bcd": 1, "cde": 5})
    assert [r[0] for r in rows] == ["bcd", "bcd"]
    pre = spark.createDataFrame([("abcde abcd bcde",), ("bcde",), ("bcd",)], "_lc string")
    assert sorted(r["_lc"] for r in g.candidates(pre, rows).collect()) == ["abcde abcd bcde", "bcde"]


def test_counts_are_of_lines(spark):
    lines = spark.createDataFrame([("aaaa",), ("AAA b",), ("xyz",), (None,)], "line string")
    assert g.gram_counts(lines, {"aaa", "xyz", "zzz"}) == {"aaa": 2, "xyz": 1}
    assert g.gram_counts(lines, {"aaa", "xyz"}, limit=1) == {"aaa": 2, "xyz": 1}


def test_plan_has_no_shuffle_of_lines(spark):
    plan = g.match_rules_indexed(_lines(spark), builtin_rules(spark), counts={})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_literals_of_case_sensitive_patterns_keep_k_and_s():
    assert literal_hints("task[0-9]") == ["task"]
    assert literal_hints("(?i)task[0-9]") is None


def test_no_rules(spark):
    none = _rules(spark).where(F.lit(False))
    assert g.match_rules_indexed(_lines(spark), none).collect() == []
