"""DuckDB SQL for the oracle side of the correctness check.

Written independently of the Spark code: rule patterns are used in their
original RE2 form (DuckDB's regex engine is RE2), lines come from
``string_split`` and byte positions from ``strlen``.
"""

from __future__ import annotations

from scanforge.operators.rules import builtin_rule_rows, leak_rule_rows
from scanforge.sources.views import (ADVISORIES_SQL, BLOBS_SQL, CORPUS_SQL, DEPS_SQL,
                                     MANIFESTS_SQL, PUSHES_SQL, SEED_SQL)
from scanforge.constants import DEFAULT_IGNORE_PATHS, EXTENSION_LANGUAGE, LEAK_ONLY_EXTENSIONS, MEDIA_EXTENSIONS


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def with_views(*names: str) -> str:
    """WITH clause defining the named derived views (and their dependencies)."""
    defs = {"seed": SEED_SQL, "corpus": CORPUS_SQL, "blobs": BLOBS_SQL, "deps": DEPS_SQL,
            "advisories": ADVISORIES_SQL, "manifests": MANIFESTS_SQL, "pushes": PUSHES_SQL}
    need = set(names)
    if need & {"corpus", "blobs"}:
        need.add("seed")
    if "manifests" in need:
        need.add("deps")
    order = ["seed", "corpus", "blobs", "deps", "advisories", "manifests", "pushes"]
    return "WITH " + ",\n".join(defs[n] for n in order if n in need)


LANG_CASE = ("CASE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$')) "
             + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EXTENSION_LANGUAGE.items()) + " END")

EXT_SQL = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$'))"

IGNORED_SQL = ("len(list_intersect(string_split(path, '/'), ["
               + ", ".join(q(x) for x in DEFAULT_IGNORE_PATHS) + "])) > 0")

GO_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||" + \
    "||".join(f"chr({c})" for c in range(0x2000, 0x200B)) + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"

SEVERITY_WEIGHT_SQL = ("CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 "
                       "WHEN 'LOW' THEN 1 ELSE 0 END")


def sast_rules_values() -> str:
    rows = []
    for (rid, lang, title, desc, pat, anti, sev, owasp, cwe, cvss, refs, rem, hints, src, ordn) in builtin_rule_rows():
        rows.append(f"({q(rid)}, {q(lang)}, {q(pat)}, {q(anti)}, {q(sev)}, {q(title)}, {q(owasp)}, {q(cwe)}, CAST({cvss} AS DOUBLE))")
    return ("sast_rules AS (SELECT * FROM (VALUES " + ",\n".join(rows)
            + ") AS r(rule_id, rule_language, pattern, anti_pattern, severity, title, owasp, cwe, cvss))")


def leak_rules_values() -> str:
    rows = []
    for (rid, name, pat, sev, desc, conf, hints, ordn) in leak_rule_rows():
        rows.append(f"({q(rid)}, {q(name)}, {q(pat)}, {q(sev)}, {q(desc)})")
    return ("leak_rules AS (SELECT * FROM (VALUES " + ",\n".join(rows)
            + ") AS r(rule_id, leak_type, pattern, severity, description))")


def sast_line_hits(lines_view: str) -> str:
    """One SELECT per rule with a constant RE2 pattern, UNION ALL.

    ``lines_view`` has (repo, path, language, line_no, sline, lines)."""
    parts = []
    for (rid, lang, title, desc, pat, anti, sev, owasp, cwe, cvss, refs, rem, hints, src, ordn) in builtin_rule_rows():
        cond = f"regexp_matches(sline, {q(pat)})"
        if anti:
            cond += f" AND NOT regexp_matches(sline, {q(anti)})"
        lang_cond = "language IS NOT NULL" if lang == "Generic" else f"language = {q(lang)}"
        col = f"strlen(regexp_extract(sline, {q('^((?s:.)*?)(?:' + pat + ')')}, 1)) + 1"
        parts.append(f"SELECT repo, path, language, line_no, lines, {q(rid)} AS rule_id, {col} AS col "
                     f"FROM {lines_view} WHERE {lang_cond} AND {cond}")
    return "\nUNION ALL\n".join(parts)


def leak_line_hits(lines_view: str) -> str:
    parts = []
    for (rid, name, pat, sev, desc, conf, hints, ordn) in leak_rule_rows():
        parts.append(f"SELECT repo, path, line_no, {q(rid)} AS rule_id, regexp_extract(line, {q(pat)}) AS m "
                     f"FROM {lines_view} WHERE regexp_matches(line, {q(pat)})")
    return "\nUNION ALL\n".join(parts)


def entropy_sql(s: str) -> str:
    """Shannon entropy with the byte length as denominator."""
    return (f"(SELECT coalesce(-sum((cnt / strlen({s})::DOUBLE) * log2(cnt / strlen({s})::DOUBLE)), 0) "
            f"FROM (SELECT count(*) AS cnt FROM unnest(string_split({s}, '')) AS t(ch) GROUP BY ch))")


def redact_sql(s: str) -> str:
    pre = (f"CASE WHEN strlen(left({s}, 3)) <= 3 THEN left({s}, 3) "
           f"WHEN strlen(left({s}, 2)) <= 3 THEN left({s}, 2) || repeat(chr(65533), 3 - strlen(left({s}, 2))) "
           f"WHEN strlen(left({s}, 1)) <= 3 THEN left({s}, 1) || repeat(chr(65533), 3 - strlen(left({s}, 1))) "
           f"ELSE repeat(chr(65533), 3) END")
    return f"(CASE WHEN strlen({s}) < 20 THEN '***REDACTED***' ELSE {pre} || repeat('*', strlen({s})::INT - 3) END)"


# ------------------------------------------------------------------ shared CTEs

FILES_SQL = ("files AS (SELECT repo, path, content, " + LANG_CASE + " AS language, " + EXT_SQL
             + " AS ext FROM corpus WHERE NOT (" + IGNORED_SQL + "))")

# SAST lines: files with a language; trailing CR removed; lines array kept for snippets
SAST_LINES_SQL = """sast_split AS (SELECT repo, path, language, string_split(content, chr(10)) AS lines FROM files
                    WHERE language IS NOT NULL),
sast_lines AS MATERIALIZED (SELECT repo, path, language, lines, line_no, line,
                   CASE WHEN suffix(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS sline
            FROM (SELECT repo, path, language, lines, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line
                  FROM sast_split) WHERE line_no < len(lines) OR line <> '')"""


def leak_admit_sql(content: str) -> str:
    """Text admitted to secret scanning: not binary."""
    return (f"(NOT (strlen({content}) > 0 AND (contains({content}, chr(0)) OR "
            f"((strlen({content}) - strlen(regexp_replace({content}, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')))"
            f" * 100 // strlen({content})) > 30)))")


def leak_line_keep_sql(line: str) -> str:
    t = f"trim({line}, {GO_SPACE})"
    return f"({t} <> '' AND NOT starts_with({t}, '#'))"
