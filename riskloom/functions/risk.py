"""What a finding is worth: risk, confidence, redaction, fingerprint, weakness groups, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in order.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
#: Path parts and endings of test code.
TEST_PARTS = ["_test.", ".test.", ".spec.", "/test/", "/tests/", "/__tests__/", "/spec/", "/testdata/", "/test_", "test_"]
TEST_ENDS = ["tests.cs", "test.cs"]
#: OWASP Top 10 (2021) group of each weakness.
OWASP = {
    "A01:2021 Broken Access Control": ["CWE-22", "CWE-352", "CWE-601", "CWE-732", "CWE-434", "CWE-639", "CWE-346"],
    "A02:2021 Cryptographic Failures": ["CWE-321", "CWE-326", "CWE-327", "CWE-328", "CWE-338", "CWE-295", "CWE-614", "CWE-922"],
    "A03:2021 Injection": ["CWE-78", "CWE-79", "CWE-89", "CWE-90", "CWE-643", "CWE-917", "CWE-1336", "CWE-943", "CWE-95", "CWE-1333", "CWE-644"],
    "A05:2021 Security Misconfiguration": ["CWE-611", "CWE-16", "CWE-942"],
    "A07:2021 Identification & Authentication Failures": ["CWE-347", "CWE-287", "CWE-384"],
    "A08:2021 Software & Data Integrity Failures": ["CWE-502", "CWE-1321", "CWE-915"],
    "A10:2021 Server-Side Request Forgery": ["CWE-918"],
}
#: Least score of each grade.
GRADES = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (60, "D")]


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (level + 1).cast("int"))


def severity_level(name: Column) -> Column:
    """The number of a severity name; an unknown name counts as INFO."""
    level = F.lit(INFO)
    for k, s in enumerate(SEVERITIES):
        level = F.when(F.upper(name) == s, F.lit(k)).otherwise(level)
    return level


def real_risk(kind: Column, severity: Column, placeholder: Column, validated: Column, live: Column, reachable: Column) -> Column:
    """Placeholders and dead secrets are INFO, live ones CRITICAL, unreachable vulnerabilities LOW; the rest keep their severity."""
    secret = F.when(placeholder, F.lit(INFO)).when(~validated, severity).when(live, F.lit(CRITICAL)).otherwise(F.lit(INFO))
    return F.when(kind == "secret", secret).when((kind == "vulnerability") & (reachable.eqNullSafe(F.lit(False))), F.lit(LOW)).otherwise(severity)


def is_test_path(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | F.contains(low, F.lit(part))
    for end in TEST_ENDS:
        out = out | F.endswith(low, F.lit(end))
    return out


def confidence(kind: Column, rule: Column, path: Column, placeholder: Column, validated: Column, live: Column, user_input: Column, reachable: Column) -> Column:
    """0 tentative, 1 firm, 2 confirmed."""
    secret = F.when(placeholder, 0).when(validated & live, 2).when(rule == "generic-high-entropy", 0).otherwise(1)
    code = F.when(is_test_path(path), 0).when(user_input, 2).otherwise(1)
    return F.when(kind == "secret", secret).when(kind == "code", code).when((kind == "vulnerability") & reachable.eqNullSafe(F.lit(True)), 2).otherwise(1)


def redact(secret: Column) -> Column:
    """The first four and last two characters of a trimmed secret; stars for all of a short one."""
    s = F.trim(secret)
    return F.when(F.octet_length(s) <= 8, F.repeat(F.lit("*"), F.octet_length(s))).otherwise(F.concat(F.left(s, F.lit(4)), F.lit("******"), F.right(s, F.lit(2))))


def fingerprint(rule: Column, path: Column, line: Column, match: Column) -> Column:
    nul = F.expr("chr(0)")
    return F.left(F.sha2(F.concat_ws("", rule, nul, path, nul, line.cast("string"), nul, match), 256), F.lit(16))


def owasp(cwe: Column) -> Column:
    out = F.lit("")
    for label, ids in OWASP.items():
        out = F.when(cwe.isin(ids), label).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def audit_score(critical: Column, high: Column, medium: Column, low: Column, exploitable: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - critical * 25 - high * 12 - medium * 5 - low - exploitable * 8)


def exposed_days(now: Column, since: Column) -> Column:
    """Whole days since an author time, none before it."""
    return F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400), F.lit(0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))
