"""What all findings of a code base add up to: counts, score, ranks, groups, chains, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk


def risk_counts(findings: DataFrame) -> DataFrame:
    """(level, name, findings): all five levels, none left out."""
    spark = findings.sparkSession
    levels = spark.createDataFrame(list(enumerate(risk.SEVERITIES)), "real_risk int, name string")
    counts = findings.groupBy("real_risk").count()
    return F.broadcast(levels).join(counts, "real_risk", "left").select("real_risk", "name", F.coalesce("count", F.lit(0)).alias("findings"))


def audit(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: counts of firm findings by risk, endpoints, open ones, exploitable ones, score, grade, highest risk."""
    level = lambda k: F.count_if((F.col("real_risk") == k) & (F.col("confidence") >= 1)).alias(risk.SEVERITIES[k].lower())
    counts = findings.agg(*[level(k) for k in reversed(range(5))], F.coalesce(F.max("real_risk"), F.lit(0)).alias("highest"), F.count("*").alias("findings"), F.count_if(F.col("real_risk") >= risk.MEDIUM).alias("real"))
    routes = judged.agg(F.count("*").alias("endpoints"), F.count_if(~F.col("auth")).alias("open"), F.count_if(~F.col("auth") & (F.col("sinks") > 0)).alias("exploitable"))
    row = counts.crossJoin(F.broadcast(routes))
    score = risk.audit_score(*[F.col(c) for c in ("critical", "high", "medium", "low", "exploitable")])
    return row.withColumn("score", score.cast("bigint")).withColumn("grade", risk.grade(F.col("score")))


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row: whether the highest risk reaches the level; an unknown level counts as INFO."""
    return findings.agg((F.coalesce(F.max("real_risk"), F.lit(0)) >= risk.severity_level(F.lit(fail_on))).alias("failed"))


def review(findings: DataFrame) -> DataFrame:
    """By file: highest risk, findings, firm and tentative ones, the first of them; ranked by risk, number and path."""
    first = F.min_by(F.struct("rule", "line_no"), F.struct(-F.col("real_risk"), "line_no", "rule"))
    rows = findings.groupBy("path").agg(F.max("real_risk").alias("highest"), F.count("*").alias("findings"), F.count_if(F.col("confidence") >= 1).alias("firm"), F.count_if(F.col("confidence") == 0).alias("tentative"), first.alias("f"), F.max(F.when(F.col("confidence") >= 1, F.col("real_risk"))).alias("blocking"))
    rows = rows.select("path", "highest", "findings", "firm", "tentative", F.coalesce("blocking", F.lit(0)).alias("blocking"), F.col("f.rule").alias("top_rule"), F.col("f.line_no").alias("top_line"))
    return rows.orderBy(F.desc("highest"), F.desc("findings"), "path")


def review_verdict(findings: DataFrame) -> DataFrame:
    """One row: number of findings, highest risk, a reviewer's decision, and where to start: the first of the riskiest file."""
    rows = findings.agg(F.count("*").alias("findings"), F.coalesce(F.max("real_risk"), F.lit(0)).alias("highest"), F.countDistinct("path").alias("files"), *[F.count_if(F.col("real_risk") == k).alias(f"n{k}") for k in (4, 3, 2, 1)])
    of_file = Window.partitionBy("path")
    best = findings.withColumns({"worst": F.max("real_risk").over(of_file), "many": F.count("*").over(of_file)})
    start = best.agg(F.min_by(F.concat(F.col("rule"), F.lit(" in "), F.regexp_extract("path", "[^/]*$", 0), F.lit(":"), F.col("line_no")), F.struct(-F.col("worst"), -F.col("many"), "path", -F.col("real_risk"), "line_no", "rule")).alias("start"))
    text = F.when(F.col("findings") == 0, "APPROVE — no security issues found. LGTM.").when(F.col("highest") >= risk.HIGH, "REQUEST CHANGES — high-risk issue(s) must be addressed before merge.").when(F.col("highest") == risk.MEDIUM, "COMMENT — some issues to consider; not blocking.").otherwise("APPROVE — only minor notes.")
    parts = F.concat_ws(", ", *[F.when(F.col(f"n{k}") > 0, F.concat(F.col(f"n{k}").cast("string"), F.lit(f" {risk.SEVERITIES[k].lower()}"))) for k in (4, 3, 2, 1)])
    said = F.when(F.col("findings") == 0, "This change introduces no new security risk.").otherwise(F.concat(F.lit("This change introduces "), parts, F.lit(" across "), F.col("files").cast("string"), F.lit(" file(s). Start with "), F.col("start"), F.lit(".")))
    return rows.crossJoin(F.broadcast(start)).select("findings", "highest", text.alias("verdict"), said.alias("summary"))


def ranked(findings: DataFrame) -> DataFrame:
    """Real risk first, privileged first among equals, then in order of place and rule."""
    return findings.orderBy(F.desc("real_risk"), F.desc("privileged"), "path", "line_no", "rule")


def prioritise(findings: DataFrame, judged: DataFrame, limit: int = 6, top: int = 8) -> DataFrame:
    """What to do first: open routes with sinks, then the top findings of at least LOW risk, so many in all."""
    open_routes = judged.where("not auth and sinks > 0").select(F.lit(0).alias("part"), F.lit(risk.HIGH).alias("level"), F.concat_ws(" ", "method", "route").alias("what"), "path", "line_no")
    best = findings.where(F.col("real_risk") >= risk.LOW).orderBy(F.desc("real_risk"), "path", "line_no", "rule").limit(top)
    best = best.where(F.col("real_risk") >= risk.MEDIUM).select(F.lit(1).alias("part"), F.col("real_risk").alias("level"), F.col("rule").alias("what"), "path", "line_no")
    return open_routes.unionByName(best).orderBy("part", F.desc("level"), "path", "line_no", "what").limit(limit)


def chains(joined: DataFrame) -> DataFrame:
    """One row for each way in that the targets offer, with the first route of it."""
    place = F.struct("path", "line_no", "method", "route")
    cwe, open_ = F.col("cwe"), ~F.col("auth")
    ways = {"code execution": cwe.isin("CWE-78", "CWE-95") & open_, "upload": cwe == "CWE-434", "file inclusion": cwe == "CWE-22", "internal requests": cwe == "CWE-918", "database": (cwe == "CWE-89") & open_}
    row = joined.agg(*[F.min(F.when(test, place)).alias(name) for name, test in ways.items()])
    listed = F.array(*[F.struct(F.lit(name).alias("way"), F.col(f"`{name}`").alias("at")) for name in ways])
    return row.select(F.inline(listed)).where("at is not null").select("way", "at.*")


def attack_path(secrets: DataFrame, services: dict[str, str]) -> DataFrame:
    """One row: services with live credentials, privileged ones, and whether two or more are open at once."""
    name = F.coalesce(*[F.when(F.col("rule") == r, F.lit(s)) for r, s in services.items()], F.lit("other"))
    live = secrets.where("live").withColumn("service", name)
    rows = live.agg(F.array_sort(F.collect_set("service")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("privileged"), F.col("service")))).alias("b"))
    return rows.select(F.array_join("a", ",").alias("live"), F.array_join("b", ",").alias("privileged"), (F.size("a") >= 2).alias("several"))


def sarif_level(level: Column) -> Column:
    return F.when(level >= risk.HIGH, "error").when(level == risk.MEDIUM, "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON object of SARIF 2.1.0 for each finding."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), sarif_level(F.col("real_risk")).alias("level"), F.struct(F.col("rule").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "line_no", "rule", F.to_json(result).alias("result"))


def openapi_paths(found: DataFrame) -> DataFrame:
    """(route, operations): a JSON object of methods by path, `{name}` for `:name`; ANY and other methods become get."""
    known = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
    method = F.lower(F.when(F.upper("method").isin(known), F.col("method")).otherwise("GET"))
    rows = found.select(F.regexp_replace("route", r":([A-Za-z_]\w*)", r"{$1}").alias("route"), method.alias("method")).distinct()
    return rows.groupBy("route").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_set("method")), lambda m: F.concat(F.lit('"'), m, F.lit('":{}'))), ","), F.lit("}")).alias("operations"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
