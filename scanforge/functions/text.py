"""Column functions shared by the engines. All are native Spark expressions.

Lengths follow the byte semantics of the scanner being replaced wherever the
result can differ from character counts (redaction, entropy denominator,
columns, size limits): ``octet_length`` instead of ``length``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: characters removed by a Unicode "trim space" (Go's
# unicode.IsSpace): TAB LF VT FF CR SPACE, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# FIXED VALUES: severity weights.
SEVERITY_WEIGHTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

REPLACEMENT_CHAR = "\ufffd"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Trim Unicode white space on both sides (not only ASCII blanks)."""
    return F.btrim(_c(c), F.lit(UNICODE_SPACES))


def shannon_entropy(c) -> Column:
    """-sum p*log2(p) with p = (count of each character) / (byte length).

    Built from higher-order functions on the character array; used only on
    matched secrets, which are short.
    """
    s = _c(c)
    ch = F.split(s, "")
    n = F.octet_length(s).cast("double")
    counts = F.transform(F.array_distinct(ch), lambda u: F.size(F.filter(ch, lambda x: x == u)))
    ent = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    return F.when(F.coalesce(F.octet_length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(ent)


def byte_prefix(c, nbytes: int) -> Column:
    """First ``nbytes`` bytes of a UTF-8 string, a cut character shown as one
    U+FFFD per cut byte (how a byte slice of the text renders in JSON)."""
    s = _c(c)
    expr = F.lit(REPLACEMENT_CHAR * nbytes)
    # longest whole-character prefix with <= nbytes bytes, then pad
    for k in range(1, nbytes + 1):
        pre = F.substring(s, 1, k)
        fits = F.octet_length(pre) <= nbytes
        padded = F.concat(pre, F.repeat(F.lit(REPLACEMENT_CHAR), F.greatest(F.lit(nbytes) - F.octet_length(pre), F.lit(0))))
        expr = F.when(fits, padded).otherwise(expr)
    return F.when(F.octet_length(s) <= nbytes, s).otherwise(expr)


def redact(c) -> Column:
    """< 20 bytes -> fully masked; else first 3 bytes + '*' per remaining byte."""
    s = _c(c)
    nb = F.octet_length(s)
    return F.when(nb < 20, F.lit("***REDACTED***")).otherwise(
        F.concat(byte_prefix(s, 3), F.repeat(F.lit("*"), nb - 3))
    )


def severity_weight(c) -> Column:
    s = _c(c)
    out = F.lit(0)
    for name, w in SEVERITY_WEIGHTS.items():
        out = F.when(s == name, F.lit(w)).otherwise(out)
    return out


def sarif_level(c) -> Column:
    s = _c(c)
    return (F.when(s.isin("CRITICAL", "HIGH"), F.lit("error"))
            .when(s == "MEDIUM", F.lit("warning"))
            .otherwise(F.lit("note")))


def cvss_severity(c) -> Column:
    x = _c(c)
    return (F.when(x >= 9.0, F.lit("CRITICAL"))
            .when(x >= 7.0, F.lit("HIGH"))
            .when(x >= 4.0, F.lit("MEDIUM"))
            .when(x > 0, F.lit("LOW"))
            .otherwise(F.lit("HIGH")))


def cvss_score_from_text(c) -> Column:
    """Score string -> number: a leading number in (0, 10] as is; otherwise an
    estimate from the vector (network+low complexity+no privileges 9.0,
    network 7.5, else 5.0)."""
    s = _c(c)
    num = F.regexp_extract(s, r"^[\t\n\f\r ]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    val = F.expr("try_cast(NULL AS DOUBLE)")
    val = F.when(num != "", num.try_cast("double")).otherwise(val)
    up = F.upper(s)
    est = (F.when(up.contains("AV:N") & up.contains("AC:L") & up.contains("PR:N"), F.lit(9.0))
           .when(up.contains("AV:N"), F.lit(7.5))
           .otherwise(F.lit(5.0)))
    return F.when((val > 0) & (val <= 10.0), val).otherwise(est)


def cvss_score(severity_array) -> Column:
    """First CVSS_V3/CVSS_V2 entry of an array<struct<type,score>>; 0 if none."""
    arr = _c(severity_array)
    first = F.try_element_at(F.filter(arr, lambda e: e["type"].isin("CVSS_V3", "CVSS_V2")), F.lit(1))
    return F.when(first.isNull(), F.lit(0.0)).otherwise(cvss_score_from_text(first["score"]))


def strip_version_prefix(c) -> Column:
    """Trim; remove at most one leading comparison operator; trim again."""
    v = trim_space(_c(c))
    stripped = F.regexp_replace(v, r"^(>=|<=|==|!=|~>|\^|~|>|<|=)", "")
    return trim_space(stripped)


def safe_url(c) -> Column:
    """Keep http/https URLs (scheme case-insensitive, written lower-case as a
    URL parser prints it), else '#'. Unparsable text (control characters,
    bad percent escapes) also gives '#'."""
    u = F.coalesce(trim_space(_c(c)), F.lit(""))
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    # a URL parser checks escapes everywhere but in the query
    bad = u.rlike(r"[\x00-\x1f\x7f]") | F.regexp_replace(u, r"\?[^#]*", "?").rlike(r"%(?![0-9A-Fa-f]{2})")
    ok = F.lower(scheme).isin("http", "https") & ~bad
    return F.when(ok, F.concat(F.lower(scheme), F.substring(u, F.length(scheme) + 1, 1 << 30))).otherwise(F.lit("#"))


def relative_path(c, root: str) -> Column:
    """Path relative to the scan root, forward slashes."""
    p = F.regexp_replace(_c(c), r"\\", "/")
    root = root.replace("\\", "/").rstrip("/")
    if not root:
        return p
    return F.when(p.startswith(root + "/"), F.substring(p, len(root) + 2, 1 << 30)).otherwise(p)


def base_name(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def extension(c) -> Column:
    """Lower-cased extension from the last dot of the base name ('' if none)."""
    return F.lower(F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1))


def hmac_sha256_hex(key: bytes | str, msg) -> Column:
    """HMAC-SHA-256 (hex) of a string column under a job-constant key.

    The key is known on the driver, so both pads are literals and the whole
    computation is two native ``sha2`` calls per row.
    """
    if isinstance(key, str):
        key = key.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key)
    opad = bytes(b ^ 0x5C for b in key)
    m_bin = F.encode(_c(msg), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), m_bin), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def cache_key(*parts) -> Column:
    """SHA-256 (64 hex characters) over the parts joined by LF."""
    cols = [_c(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts]
    joined = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in cols])
    return F.sha2(joined, 256)


def cache_key_short(key) -> Column:
    """First 16 hex characters of a cache key, for display only."""
    return F.substring(_c(key), 1, 16)


_PARTIAL_UTF8_TAIL = "(?:[À-ß]|[à-ï][\u0080-¿]?|[ð-÷][\u0080-¿]{0,2})$"


def utf8_byte_prefix(c, nbytes: int) -> Column:
    """At most ``nbytes`` bytes of a string, never splitting a character (a
    cut trailing character is dropped). Bytes are handled as ISO-8859-1
    characters, so no decoding step can fail."""
    raw = F.substring(F.encode(_c(c), "UTF-8"), 1, nbytes)
    latin = F.regexp_replace(F.decode(raw, "ISO-8859-1"), _PARTIAL_UTF8_TAIL, "")
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")
