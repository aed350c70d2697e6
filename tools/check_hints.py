"""Soundness of the literal prefilters: on every line of the corpus (documents
with seed lines), the pages and the conversations, no line may match a
rule's RE2 pattern (DuckDB) while containing none of the rule's hints.

usage: python tools/check_hints.py [sf_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from scanforge.operators.rule_hints import HINTS  # noqa: E402
from scanforge.operators.rules_data import LEAK_RULES, SAST_RULES  # noqa: E402
from scanforge.plans.oracle import q, with_views  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ["documents", "pages", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute("CREATE TABLE lines AS " + with_views("corpus") + """, texts AS (
        SELECT content AS t FROM corpus UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM conversations)
        SELECT DISTINCT unnest(string_split(t, chr(10))) AS line FROM texts""")
    con.execute("CREATE TABLE lc AS SELECT line, replace(lower(line), chr(383), 's') AS l FROM lines")
    rules = [(r[0], r[7]) for r in SAST_RULES] + [(r[0], r[4]) for r in LEAK_RULES]
    bad = 0
    for rid, pat in rules:
        hints = HINTS[rid]
        cond = " OR ".join(f"contains(l, {q(h)})" for h in hints)
        n_match, n_miss = con.execute(
            f"SELECT count(*), count(*) FILTER (WHERE NOT ({cond})) FROM lc WHERE regexp_matches(line, {q(pat)})").fetchone()
        if n_miss:
            bad += 1
            print(f"UNSOUND {rid}: {n_miss} of {n_match} matching lines lack a hint")
    print(f"{len(rules)} rules checked on {con.execute('SELECT count(*) FROM lines').fetchone()[0]} distinct lines; unsound: {bad}")


if __name__ == "__main__":
    main()
