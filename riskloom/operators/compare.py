"""Two states of a code base held against each other: baselines, changed files and lines, new and resolved findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from . import contain, ordinals


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline doesn't hold; an empty baseline suppresses nothing."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def enabled(findings: DataFrame, disabled: list[str]) -> DataFrame:
    """Findings of rules that the policy doesn't switch off."""
    return findings.where(~F.col("rule").isin(disabled)) if disabled else findings


def in_changed_files(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select("path").distinct(), "path", "left_semi")


def introduced(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings of files in changed(path, line) with a flag: on a changed line, or in a file that is new (line 0)."""
    files = changed.groupBy("path").agg((F.min("line") == 0).alias("new_file"))
    lines = changed.select("path", F.col("line").alias("line_no"), F.lit(True).alias("hit")).distinct()
    rows = findings.join(files, "path").join(lines, ["path", "line_no"], "left")
    return rows.withColumn("introduced", F.col("new_file") | F.coalesce("hit", F.lit(False))).drop("new_file", "hit")


def changed_lines(diff: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """(path, line) of the added lines of a unified diff without context, given as diff(ord, text); new files of untracked(path) have line 0.

    The file is the last `+++ b/` header, the line the start of the last hunk plus the added lines since. Both are carried forward
    over runs of the order, so a diff of any length is no single task.
    """
    order = [F.col("ord")]
    text = F.col("text")
    added = F.startswith(text, F.lit("+")) & ~F.startswith(text, F.lit("+++"))
    hunk = F.regexp_extract(text, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    rows = ordinals.running(ordinals.runs(diff.select("ord", "text"), *order), order, added.cast("int"), "n")
    header = F.when(text.rlike(r"^\+\+\+ b/"), F.regexp_extract(text, r"^\+\+\+ b/(.*)$", 1))
    start = F.when(hunk != "", F.struct(hunk.cast("bigint").alias("line"), F.col("n").alias("n")))
    rows = ordinals.carried(rows, order, {"path": header, "hunk": start}).where(added & (F.coalesce("path", F.lit("")) != ""))
    out = rows.select("path", (F.coalesce("hunk.line", F.lit(0)) + F.col("n") - F.coalesce("hunk.n", F.lit(0)) - 1).cast("int").alias("line")).distinct()
    return out if untracked is None else out.unionByName(untracked.select("path", F.lit(0).alias("line")).distinct())


def changed_files(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path) of the files that a list of changed names and a list of new files hold."""
    return diff.select("path").union(untracked.select("path")).where("path is not null and trim(path) <> ''").distinct()


def new_secrets(base: DataFrame, head: DataFrame) -> DataFrame:
    """Head's secrets, placeholders aside, whose rule and match base doesn't have."""
    return head.where("not placeholder").join(base.select("rule", "match").distinct(), ["rule", "match"], "left_anti")


def resolved(base: DataFrame, head: DataFrame) -> DataFrame:
    """Base's findings of at least MEDIUM risk that head no longer has: by rule, file name and trimmed match."""
    key = ["rule", F.regexp_extract("path", "[^/]*$", 0).alias("base_name"), F.trim("match").alias("trimmed")]
    gone = base.where(F.col("real_risk") >= risk.MEDIUM).select("*", *key[1:])
    return gone.join(head.select(*key).distinct(), ["rule", "base_name", "trimmed"], "left_anti").drop("base_name", "trimmed")


def history_only(history: DataFrame, tree: DataFrame) -> DataFrame:
    """Secrets of history(secret, rule, ord) that stand in no text of tree(text) any more, anywhere in it; the first blob of each value."""
    first = history.groupBy("secret").agg(F.min_by(F.struct(*[c for c in history.columns if c != "secret"]), "ord").alias("r")).select("secret", "r.*")
    return contain.standing_nowhere(first.withColumnRenamed("secret", "needle"), tree).withColumnRenamed("needle", "secret")


def exposure(findings: DataFrame, blame: DataFrame, now: Column) -> DataFrame:
    """Findings with the days since their line was written and the note about it; no blame, no note."""
    rows = findings.join(blame.select("path", F.col("line").alias("line_no"), "author_time"), ["path", "line_no"], "left")
    days = risk.exposed_days(now, F.col("author_time"))
    note = F.concat(F.lit("exposed ~"), days.cast("string"), F.lit(" days (since "), F.date_format("author_time", "yyyy-MM-dd"), F.lit(")"))
    return rows.withColumns({"days": days, "exposure": F.coalesce(note, F.lit(""))}).drop("author_time")
