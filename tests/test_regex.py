import re

import pytest
from pyspark.sql import functions as F

from scanforge.functions.regex import to_java
from scanforge.operators.rules_data import LEAK_RULES, SAST_RULES

ALL = [(r[0], r[7]) for r in SAST_RULES] + [(r[0], r[4]) for r in LEAK_RULES]


def test_all_patterns_compile_in_java(spark):
    df = spark.createDataFrame([("x",)], "s string")
    exprs = [F.col("s").rlike(to_java(p)).alias(f"c{i}") for i, (_, p) in enumerate(ALL)]
    row = df.select(*exprs).collect()[0]
    assert len(row) == 137


@pytest.mark.parametrize("pattern,text,expected", [
    (r"(?i)token", "toKen", True),             # KELVIN SIGN folds to k as in RE2
    (r"\beval\s*\(", "éeval(x)", True),        # RE2 \b is ASCII: é is not a word character
    (r"\beval\s*\(", "xeval(x)", False),
    (r"except:\s*$", "except:\r", True),       # \s matches CR, $ at end only
    (r"a.b", "a\rb", True),                    # . matches CR in RE2
    (r"a\sb", "a\x0bb", False),                # \s has no vertical tab in RE2
    (r"(?i)(?:^|[^.\w])(pass)\s*=", "Kpass =", False),   # (?i)\w folds K in RE2
])
def test_dialect_cases(spark, pattern, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(F.col("s").rlike(to_java(pattern))).collect()[0][0] is expected


def test_translation_keeps_flags():
    assert to_java(r"(?i)abc").startswith("(?diu)")
    assert to_java(r"(?m)^X").startswith("(?dm)")
    assert to_java("plain") == "(?d)plain"
    re.compile(to_java(r"(?i)\bx\b").replace("(?diu)", "(?i)").replace("(?-iu:", "(?:"))
