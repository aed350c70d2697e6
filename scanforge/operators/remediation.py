"""Remediation pipeline, data side only: work list, cache keys and lookup,
integrity tags, prompt text, response cleaning, attaching answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.constants import CACHE_TTL_HOURS
from scanforge.functions.text import cache_key, hmac_sha256_hex, severity_weight

# FIXED VALUES: tokens removed from model answers, in order.
GARBAGE_TOKENS = [
    "｜begin▁of▁sentence｜",
    "｜end▁of▁sentence｜",
    "<|begin_of_sentence|>",
    "<|end_of_sentence|>",
    "<|im_start|>",
    "<|im_end|>",
    "<s>", "</s>",
]

# FIXED VALUES: first-line filler prefixes that drop the first line.
FILLER_PREFIXES = [
    "Sure,", "Sure!", "Of course,", "Of course!",
    "Certainly,", "Certainly!", "Here are", "Here is",
    "I'd be happy to", "I'll provide", "Let me",
    "Below are", "The following",
]

# FIXED VALUES: notice behind a cut answer.
TRUNCATION_NOTICE = "\n\n[... output truncated]"


def remediation_worklist(findings: DataFrame, max_leaks: int | None = None, salts: int = 64) -> DataFrame:
    """HIGH/CRITICAL SAST findings and the secret findings. ``max_leaks``
    keeps the first per scan (by severity, file, line, rule), ranked inside
    (repo, salt) first, so one large repository is ranked by many tasks."""
    work = ((F.col("engine") == "SAST") & F.col("severity").isin("CRITICAL", "HIGH")) | (F.col("engine") == "Leaks")
    if max_leaks is None:
        return findings.where(work)
    order = [severity_weight("severity").desc(), "file", "line", "rule_id"]
    leak = F.col("engine") == "Leaks"
    out = findings.where(work).withColumn("_salt", F.when(leak, F.pmod(F.xxhash64("file", "line", "rule_id"), F.lit(salts))).otherwise(F.xxhash64("file", "line", "rule_id")))
    for keys in (["repo", "engine", "_salt"], ["repo", "engine", F.when(leak, 0).otherwise(F.col("_salt"))]):
        w = Window.partitionBy(*keys).orderBy(*order)
        out = out.withColumn("_r", F.row_number().over(w)).where(~leak | (F.col("_r") <= max_leaks))
    return out.drop("_r", "_salt")


def finding_cache_key(provider: str, model: str):
    """SAST: (provider, model, rule, severity, code); secrets: (provider,
    model, type, file, '')."""
    sast = cache_key(F.lit(provider), F.lit(model), F.col("rule_id"), F.col("severity"),
                     F.coalesce(F.col("code"), F.lit("")))
    leak = cache_key(F.lit(provider), F.lit(model), F.col("title"), F.col("file"), F.lit(""))
    return F.when(F.col("engine") == "SAST", sast).otherwise(leak)


def cache_lookup(items: DataFrame, cache: DataFrame, now, integrity_key: bytes | str | None = None):
    """Work items with ``hit`` and ``cached_response`` from a cache table
    (key, created, ttl_hours, response, integrity). An entry counts while it is
    fresh (created + ttl >= now) and, when it carries an integrity tag, if the
    tag is the HMAC of the response under ``integrity_key``. Of several valid
    entries of a key the newest answers, so items are never multiplied."""
    c = cache
    fresh = (F.col("created") + F.make_interval(hours=F.col("ttl_hours").cast("int"))) >= F.lit(now).cast("timestamp")
    if integrity_key is not None:
        ok = F.coalesce(F.col("integrity"), F.lit("")).isin("") | \
            (F.col("integrity") == hmac_sha256_hex(integrity_key, F.col("response")))
    else:
        ok = F.lit(True)
    valid = c.where(fresh & ok).groupBy(F.col("key").alias("cache_key")).agg(
        F.max_by("response", F.struct("created", "response")).alias("cached_response"), F.lit(True).alias("hit"))
    return items.join(valid, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# FIXED VALUES: the wording of a secret's prompt, with its type and file.
SECRET_PROMPT = """A %s was detected in the file: %s

Please provide:
1. The immediate steps to take (rotate/revoke the secret)
2. How to properly manage this type of secret going forward
3. How to prevent this from happening again in CI/CD

Be concise and actionable."""


def secret_prompt() -> "F.Column":
    return F.format_string(SECRET_PROMPT, F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("file"), F.lit("")))


# FIXED VALUES: the prompt's wording.
def render_prompt(df: DataFrame) -> DataFrame:
    """Prompt text per finding: a secret's (engine Leaks) names its type and
    file and never the match; any other has the finding's fields and code
    (the model call itself is not part of this engine)."""
    names = ("language", "owasp", "cwe", "cvss", "code")
    lacking = {c: F.lit(None).cast("double" if c == "cvss" else "string") for c in names if c not in df.columns}
    return df.withColumns(lacking).withColumn("prompt", _finding_prompt()).withColumn(
        "prompt", F.when(F.col("engine") == "Leaks", secret_prompt()).otherwise(F.col("prompt")) if "engine" in df.columns else F.col("prompt")).drop(*lacking)


def _finding_prompt() -> "F.Column":
    code = F.coalesce(F.col("code"), F.lit(""))
    code_block = F.when(code != "", F.concat(F.lit("**Vulnerable Code:**\n```\n"), code, F.lit("\n```\n\n"))).otherwise("")
    p = F.concat(
        F.lit("## Security Vulnerability Found\n\n"),
        F.format_string("**Vulnerability:** %s\n", F.col("title")),
        F.format_string("**Severity:** %s\n", F.col("severity")),
        F.format_string("**Language:** %s\n", F.coalesce(F.col("language"), F.lit(""))),
        F.format_string("**OWASP Category:** %s\n", F.coalesce(F.col("owasp"), F.lit(""))),
        F.format_string("**CWE:** %s\n", F.coalesce(F.col("cwe"), F.lit(""))),
        F.format_string("**CVSS Score:** %.1f\n\n", F.coalesce(F.col("cvss"), F.lit(0.0))),
        code_block,
        F.format_string("**File:** %s (line %d)\n\n", F.col("file"), F.col("line")),
        F.lit("Please provide:\n"),
        F.lit("1. Why this vulnerability is dangerous in this specific context\n"),
        F.lit("2. A corrected code example\n"),
        F.lit("3. Any additional security controls to add\n"),
    )
    return p


def clean_response(c, max_bytes: int | None = None) -> "F.Column":
    """Clean a model answer: drop marker tokens; drop the first line when it
    starts (after trimming) with a filler phrase; collapse 3+ newlines to 2;
    right-trim blanks per line; trim. With ``max_bytes`` a longer answer is cut
    there (back to the last newline when that loses at most a sixth) with a
    notice."""
    from scanforge.functions.text import trim_space, utf8_byte_prefix
    t = F.col(c) if isinstance(c, str) else c
    for g in GARBAGE_TOKENS:
        t = F.replace(t, F.lit(g), F.lit(""))
    first = trim_space(F.split(t, "\n", 2).getItem(0))
    filler = None
    for p in FILLER_PREFIXES:
        cond = first.startswith(p)
        filler = cond if filler is None else (filler | cond)
    t = F.when(filler, F.regexp_replace(t, r"^[^\n]*(\n|$)", "")).otherwise(t)
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+(\n|$)", "$1")
    if max_bytes is None:
        return trim_space(t)
    head = utf8_byte_prefix(t, max_bytes)
    last_nl = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    cut = F.when((F.instr(head, "\n") > 0) & (F.octet_length(F.substring(head, 1, last_nl - 1)) > max_bytes * 5 // 6),
                 F.substring(head, 1, last_nl - 1)).otherwise(head)
    t = F.when(F.octet_length(t) > max_bytes, F.concat(cut, F.lit(TRUNCATION_NOTICE))).otherwise(t)
    return trim_space(t)


def attach_remediation(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Put answers (cache_key, response) back on findings by key; findings are never multiplied."""
    a = answers.groupBy(F.col("cache_key").alias("_k")).agg(F.max("response").alias("_resp"))
    j = findings.join(a, findings.cache_key == a._k, "left")
    return j.withColumn("ai_remediation", F.coalesce(F.col("_resp"), F.col("ai_remediation"), F.lit(""))).drop("_k", "_resp")


def render_prompts(items: DataFrame) -> DataFrame:
    return render_prompt(items)


def clean_responses(texts: DataFrame, text_col: str = "text", out_col: str = "cleaned", max_bytes: int | None = None) -> DataFrame:
    return texts.withColumn(out_col, clean_response(F.col(text_col), max_bytes))


__all__ = ["render_prompts", "clean_responses", "remediation_worklist", "finding_cache_key", "cache_lookup", "render_prompt", "clean_response",
           "attach_remediation", "CACHE_TTL_HOURS"]
