"""Reports as the lines of one document: a head, an item a row, a tail. Sorted by (part, ord, line) they are the file.

Items are rows of their own to the end, so that a report of any size is written by many tasks; no row holds a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk, titles
from .audit import sarif_level

TOOL, VERSION = "riskloom", "1.0.0"


def document(rows: DataFrame, order: list[Column], item: Column, head: str, tail: str, between: str = ",") -> DataFrame:
    """(part, ord, line): head, items in the order of these texts with a separator before all but the first, tail."""
    ordered = rows.select(F.concat_ws("\t", *order).alias("ord"), item.alias("item"))
    first = ordered.agg(F.min("ord").alias("first"))
    made = ordered.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "ord", F.when(F.col("ord") == F.col("first"), F.col("item")).otherwise(F.concat(F.lit(between), F.col("item"))).alias("line"))
    ends = rows.sparkSession.createDataFrame([(0, "", head), (2, "", tail)], "part int, ord string, line string")
    return ends.unionByName(made)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _ranked() -> list[Column]:
    """Real risk first, then place, rule and fingerprint."""
    return [(risk.CRITICAL - F.col("real_risk")).cast("string"), F.col("path"), F.lpad(F.col("line_no").cast("string"), 9, "0"), F.col("rule"), F.col("fingerprint")]


def _title() -> Column:
    return titles.title(F.col("kind"), F.col("rule"), F.col("snippet"))


def findings_json(findings: DataFrame) -> DataFrame:
    context = F.struct(titles.weakness(F.col("kind"), F.col("rule")).alias("cwe"), titles.note(F.col("kind"), F.col("rule")).alias("note"))
    item = _json(kind=F.col("kind"), rule_id=F.col("rule"), title=_title(), severity=risk.severity_name(F.col("severity")), file=F.col("path"), line=F.col("line_no"), match=F.col("snippet"), fix=F.col("fix"), context=context, real_risk=risk.severity_name(F.col("real_risk")))
    return document(findings.distinct(), _ranked(), item, "[", "]")


def baseline(findings: DataFrame) -> DataFrame:
    """Entries by fingerprint; the moment of writing is the caller's to add."""
    rows = findings.select("fingerprint", "rule", "path", "snippet").distinct()
    item = _json(fingerprint=F.col("fingerprint"), rule=F.col("rule"), file=F.col("path"), note=F.col("snippet"))
    return document(rows, [F.col("fingerprint"), F.col("rule"), F.col("path"), F.col("snippet")], item, '{"entries":[', "]}")


def sarif(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0: level by real risk, title, note and fix as message, a region where there is a line."""
    said = titles.note(F.col("kind"), F.col("rule"))
    text = F.concat(_title(), F.when(said.isNotNull(), F.concat(F.lit(" — "), said)).otherwise(""), F.when(F.col("fix") != "", F.concat(F.lit(" Fix: "), "fix")).otherwise(""))
    region = F.when(F.col("line_no") > 0, F.struct(F.col("line_no").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    item = _json(ruleId=F.col("rule"), level=sarif_level(F.col("real_risk")), message=F.struct(text.alias("text")), locations=F.array(place))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":[]}}}},"results":['
    return document(findings.distinct(), _ranked(), item, head, "]}]}")


def cyclonedx(components: DataFrame) -> DataFrame:
    """CycloneDX 1.5 of components(name, version, ecosystem, purl), by name and version."""
    item = _json(type=F.lit("library"), name=F.col("name"), version=F.col("version"), purl=F.col("purl"))
    head = f'{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{{"tools":[{{"vendor":"{TOOL}","name":"{TOOL}"}}]}},"components":['
    return document(components, [F.col("name"), F.col("version"), F.col("ecosystem")], item, head, "]}")


def markdown(findings: DataFrame, story: DataFrame | None = None) -> DataFrame:
    """The whole report: counts, the lines of story(part, line) as attack path, a table of the findings of at least MEDIUM risk with pipes escaped, and
    how many others there are. Without findings it says so."""
    safe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    place = F.when(F.col("line_no") > 0, F.concat_ws(":", "path", "line_no")).otherwise(F.col("path"))
    item = F.concat(F.lit("| "), risk.severity_name(F.col("real_risk")), F.lit(" | "), safe(_title()), F.lit(" | `"), place, F.lit("` | "), safe(F.col("fix")), F.lit(" |"))
    rows = findings.distinct()
    many = rows.agg(F.count_if(F.col("real_risk") >= risk.MEDIUM).alias("real"), F.count("*").alias("total"))
    noise, text = F.col("total") - F.col("real"), lambda c: c.cast("string")
    table = "| Risk | Finding | Location | Fix |\n|------|---------|----------|-----|"
    counts = F.concat(F.lit("**"), text(F.col("real")), F.lit(" real risk(s)** · "), text(noise), F.lit(" filtered as noise · "), text(F.col("total")), F.lit(" total\n"))
    empty = F.col("total") == 0
    ends = [(0, "", F.concat(F.lit(f"## {TOOL} security report\n\n"), F.when(empty, "No findings — clean scan.").otherwise(counts))), (0, "~", F.when(~empty, table)), (2, "", F.when(noise > 0, F.concat(F.lit("\n<sub>"), text(noise), F.lit(" finding(s) verified harmless and filtered out.</sub>"))))]
    out = many.select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(o).alias("ord"), line.alias("line")) for p, o, line in ends]))).where("line is not null")
    out = out.unionByName(rows.where(F.col("real_risk") >= risk.MEDIUM).select(F.lit(1).alias("part"), F.concat_ws("\t", *_ranked()).alias("ord"), item.alias("line")))
    if story is not None:
        head = story.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).alias("part"), F.lit("1").alias("ord"), F.lit("### Attack path").alias("line"))
        out = out.unionByName(head).unionByName(story.select(F.lit(0).alias("part"), F.concat(F.lit("2"), F.col("part").cast("string"), F.lit("\t"), F.col("line")).alias("ord"), F.concat(F.lit("- "), "line").alias("line")))
    return out


def audit_json(audited: DataFrame) -> DataFrame:
    """One JSON object of an audit row: grade, score, counts of firm findings by risk, endpoints."""
    counts = F.struct(*[F.col(s.lower()).alias(s) for s in reversed(risk.SEVERITIES)])
    return audited.select(_json(grade=F.col("grade"), score=F.col("score"), risk_counts=counts, endpoints=F.col("endpoints"), no_auth_endpoints=F.col("open"), exploitable_endpoints=F.col("exploitable")).alias("audit"))
