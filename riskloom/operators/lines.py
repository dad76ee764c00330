"""Findings on lines of source: code, secrets, configuration. Tables in, tables out; no row leaves Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.code_patterns import CODE_RULES, ENDINGS, GLOBAL_ANTIFORGERY, LONGEST_LINE, LOOKUP, LOOKUP_WINDOW, OWNERSHIP, PATCHES
from ..functions.config_patterns import CONFIG_RULES, KIND_NAMES, SAFE_ASSIGNMENT
from ..functions.dialect import to_java
from ..functions.literals import gate
from ..functions.secret_patterns import ASSIGNMENT, HINTS, LEAST_ENTROPY, PLACEHOLDER, SECRET_RULES

#: The rule of likely secrets.
GENERIC = "generic-high-entropy"
ENDING = r"\.[A-Za-z0-9]+$"


def language(path: Column) -> Column:
    end = F.regexp_extract(path, ENDING, 0)
    out = F.lit(None).cast("string")
    for name, ends in ENDINGS.items():
        out = F.when(end.isin(ends), name).otherwise(out)
    return out


def is_comment(line: Column, lang: Column) -> Column:
    s = F.regexp_replace(line, "^[ \\t]+", "")
    starts = lambda *marks: _any([F.startswith(s, F.lit(m)) for m in marks])
    return F.when(lang.isin("py", "ruby"), starts("#")).when(lang == "php", starts("//", "#", "/*", "*")).otherwise(starts("//", "/*", "*"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def snippet(line: Column, both_ends: bool = False) -> Column:
    """A line without the blanks and tabs before it, cut to 100 bytes; with both_ends without white space on either side."""
    s = F.regexp_replace(line, "^[ \\t]+", "")
    s = F.regexp_replace(line, r"^\s+|\s+$", "") if both_ends else s
    return F.when(F.octet_length(s) > 100, F.concat(F.left(s, F.lit(99)), F.lit("…"))).otherwise(s)


def sql_text(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded(text: Column) -> Column:
    """Text in lower case, with the one letter that folds to ASCII and has no such lower case."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def _matches(rules: list[tuple[int, str, str]]) -> Column:
    """The numbers of the rules (number, condition, pattern) that hold for a row with columns line and low, its case folded.

    A pattern is tried only where a literal stands that each of its matches holds.
    """
    tests = ", ".join(f"CASE WHEN {when} AND ({gate(p, 'line', 'low', sql_text)}) AND line RLIKE {sql_text(to_java(p))} THEN {k} END" for k, when, p in rules)
    return F.expr(f"filter(array({tests}), k -> k IS NOT NULL)")


def _rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def code_findings(lines: DataFrame, extra: list[tuple] = ()) -> DataFrame:
    """(path, line_no, rule, severity, cwe, snippet) of lines(path, line_no, line): one row a line and rule of its language.

    Lines over 1000 bytes and comments are left out; a lookup by a request's id counts where no ownership check stands
    within eight lines; the antiforgery rule holds only where the code base validates globally. `extra` rules have the
    form of CODE_RULES.
    """
    rules = [*CODE_RULES, *extra]
    lang = language(F.col("path"))
    rows = lines.select("path", "line_no", "line", lang.alias("lang")).where("lang is not null")
    guarded = rows.where((F.col("lang") == "cs") & F.contains("line", F.lit(GLOBAL_ANTIFORGERY))).agg((F.count("*") > 0).alias("checked_globally"))
    rows = rows.where((F.octet_length("line") <= LONGEST_LINE) & ~is_comment(F.col("line"), F.col("lang")))
    spoken = lambda langs: "lang IN (" + ", ".join(map(sql_text, langs.split())) + ")"
    hits = rows.withColumn("low", folded(F.col("line"))).select("path", "line_no", "line", F.explode(_matches([(k, spoken(r[3]), r[4]) for k, r in enumerate(rules)])).alias("k"))
    table = _rule_table(lines.sparkSession, [(k, r[0], risk.SEVERITIES.index(r[1]), r[2]) for k, r in enumerate(rules)], "k int, rule string, severity int, cwe string")
    hits = hits.join(table, "k").select("path", "line_no", "rule", "severity", "cwe", snippet(F.col("line")).alias("snippet")).crossJoin(F.broadcast(guarded))
    hits = hits.where((F.col("rule") != "cs-csrf-disabled") | F.col("checked_globally")).drop("checked_globally")
    return hits.unionByName(unowned_lookups(lines))


def unowned_lookups(lines: DataFrame) -> DataFrame:
    """Lookups by an id of the request without an ownership check in the lines around."""
    near = Window.partitionBy("path").orderBy("line_no").rangeBetween(-LOOKUP_WINDOW, LOOKUP_WINDOW)
    lang = language(F.col("path"))
    rows = lines.where(lang.isNotNull()).withColumn("lang", lang)
    rows = rows.withColumn("owned", F.max(F.rlike("line", F.lit(to_java(OWNERSHIP)))).over(near))
    rows = rows.where(~F.col("owned") & F.rlike("line", F.lit(to_java(LOOKUP))) & (F.octet_length("line") <= LONGEST_LINE) & ~is_comment(F.col("line"), F.col("lang")))
    return rows.select("path", "line_no", F.lit("idor").alias("rule"), F.lit(risk.HIGH).alias("severity"), F.lit("CWE-639").alias("cwe"), snippet(F.col("line")).alias("snippet"))


def patches(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, line_no, rule, patched): the first mechanical fix of a finding's rule that changes its line."""
    rows = findings.select("path", "line_no", "rule").join(lines, ["path", "line_no"])
    fixed = [F.when((F.col("rule") == rule) & F.rlike("line", F.lit(to_java(p))), F.regexp_replace("line", to_java(p), to)) for rule, p, to in PATCHES]
    return rows.select("path", "line_no", "rule", F.coalesce(*fixed).alias("patched"), "line").where("patched is not null and patched <> line").drop("line")


def is_placeholder(text: Column) -> Column:
    return F.rlike(text, F.lit(to_java(PLACEHOLDER))) | ((F.octet_length(text) >= 6) & (F.length(F.replace(text, F.left(text, F.lit(1)), F.lit(""))) == 0))


def whole_texts(lines: DataFrame) -> DataFrame:
    """(path, text, numbers): the files of lines(path, line_no, line), and the line numbers of their lines."""
    rows = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"))
    return rows.select("path", F.array_join(F.col("own.line"), "\n").alias("text"), F.col("own.line_no").alias("numbers"))


def line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def secrets(texts: DataFrame, entropy: bool = True) -> DataFrame:
    """(key, rule, severity, secret, placeholder, feeds) of texts(key, text): all matches of the typed rules in whole texts, over ends of lines
    too, and likely secrets. feeds are the line feeds before the secret.

    The secret column is raw; sinks take risk.redact of it. A pattern is tried only on texts with a literal that each of its matches
    holds. Places are added up from the pieces between matches, for texts with a match alone.
    """
    rows = texts.select("key", "text", folded(F.col("text")).alias("low"))

    def found(rule: str, level: str, pattern: str, group: int) -> str:
        p = sql_text(to_java(pattern))
        each = f"zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (x, y) -> named_struct('whole', x, 'piece', y))"
        secret = f"regexp_extract(x.whole, {p}, {group})" if group else "x.whole"
        return f"CASE WHEN ({gate(pattern, 'text', 'low', sql_text)}) AND text RLIKE {p} THEN transform({each}, (x, k) -> named_struct('rule', {sql_text(rule)}, 'level', {sql_text(level)}, 'at', k, 'secret', {secret}, 'whole', x.whole, 'piece', x.piece)) END"

    rules = [(r, sev, p, 0) for r, _, sev, p, _ in SECRET_RULES] + ([(GENERIC, "MEDIUM", ASSIGNMENT, 2)] if entropy else [])
    hits = rows.select("key", F.expr("inline(flatten(array_compact(array(" + ", ".join(found(*r) for r in rules) + "))))")).where("whole IS NOT NULL")
    before = Window.partitionBy("key", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.when(F.col("rule") == GENERIC, line_feeds(F.col("whole"))).otherwise(line_feeds(F.regexp_extract("whole", r"^\s*", 0)))
    hits = hits.withColumn("feeds", F.sum(line_feeds(F.col("piece")) + line_feeds(F.col("whole"))).over(before) - line_feeds(F.col("whole")) + lead)
    secret, low = F.col("secret"), F.lower("secret")
    likely = (F.octet_length(secret) >= 12) & ~_any([F.contains(low, F.lit(h)) for h in HINTS]) & (risk.entropy(secret) >= LEAST_ENTROPY)
    likely = likely & F.expr("NOT (" + " OR ".join(f"secret RLIKE {sql_text(to_java(r[3]))}" for r in SECRET_RULES) + ")")
    hits = hits.where((F.col("rule") != GENERIC) | F.when(F.col("rule") == GENERIC, likely))
    return hits.select("key", "rule", risk.severity_level(F.col("level")).alias("severity"), "secret", is_placeholder(secret).alias("placeholder"), "feeds")


def config_kind(path: Column, kubernetes: Column) -> Column:
    base, folder = F.regexp_extract(path, "[^/]*$", 0), F.regexp_extract(path, "^(.*)/", 1)
    yaml = F.endswith(base, F.lit(".yml")) | F.endswith(base, F.lit(".yaml"))
    docker = (base == "Dockerfile") | F.startswith(base, F.lit("Dockerfile.")) | F.endswith(base, F.lit(".Dockerfile"))
    compose = base.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
    return F.when(docker, "dockerfile").when(compose, "compose").when(F.contains(folder, F.lit(".github/workflows")) & yaml, "gha").when(F.endswith(base, F.lit(".tf")), "terraform").when(yaml & kubernetes, "k8s")


def kind_label(kind: Column) -> Column:
    out = kind
    for name, label in KIND_NAMES.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def config_findings(lines: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity, kind, snippet) of configuration lines; a file with `apiVersion:` and `kind:` lines is Kubernetes."""
    starts = lambda mark: F.max(F.startswith(F.trim("line"), F.lit(mark)))
    files = lines.groupBy("path").agg((starts("apiVersion:") & starts("kind:")).alias("kubernetes"))
    files = files.select("path", config_kind(F.col("path"), F.col("kubernetes")).alias("kind")).where("kind is not null")
    rows = lines.join(files, "path")
    hits = rows.withColumn("low", folded(F.col("line"))).select("path", "line_no", "line", "kind", F.explode(_matches([(k, f"kind = {sql_text(r[2])}", r[3]) for k, r in enumerate(CONFIG_RULES)])).alias("k"))
    table = _rule_table(lines.sparkSession, [(k, r[0], risk.SEVERITIES.index(r[1])) for k, r in enumerate(CONFIG_RULES)], "k int, rule string, severity int")
    hits = hits.join(table, "k").select("path", "line_no", "rule", "severity", "kind", "line")
    name = F.lower(F.regexp_extract("line", to_java(SAFE_ASSIGNMENT), 1))
    safe = F.rlike("line", F.lit(to_java(SAFE_ASSIGNMENT))) & (name != "run")
    return hits.where(~((F.col("rule") == "gha-script-injection") & safe)).withColumn("snippet", snippet(F.col("line"), both_ends=True)).drop("line")
