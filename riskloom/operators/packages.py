"""Installed packages: licences, inventories of system images, advisories, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import risk

#: Licence names that are permissive wherever they occur, and the package-url type of each ecosystem.
PERMISSIVE = ["MIT", "BSD", "APACHE", "ISC", "UNLICENSE", "0BSD", "ZLIB", "WTFPL", "CC0", "PYTHON", "PSF"]
WEAK = ["LGPL", "MPL", "EPL", "CDDL"]
PURL_TYPES = {"npm": "npm", "PyPI": "pypi", "Go": "golang", "RubyGems": "gem", "crates.io": "cargo", "Packagist": "composer", "Alpine": "apk", "Debian": "deb", "Ubuntu": "deb"}


def licence_risk(raw: Column) -> Column:
    """strong, weak, permissive or unknown; the first of these that fits, in this order."""
    s = F.upper(F.trim(raw))
    has = lambda *parts: F.expr("false") if not parts else _or([F.contains(s, F.lit(p)) for p in parts])
    unknown = raw.isNull() | s.isin("", "UNLICENSED", "SEE LICENSE IN LICENSE")
    return F.when(unknown, "unknown").when(has("AGPL"), "strong").when(has("GPL") & ~has("LGPL"), "strong").when(has(*WEAK), "weak").when(has(*PERMISSIVE), "permissive").otherwise("unknown")


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def licence_severity(kind: Column, proprietary: Column) -> Column:
    strong = F.when(proprietary, risk.HIGH).otherwise(risk.LOW)
    weak = F.when(proprietary, risk.MEDIUM).otherwise(risk.LOW)
    return F.when(kind == "strong", strong).when(kind == "weak", weak).when(kind == "unknown", risk.MEDIUM).otherwise(risk.INFO)


def licence_findings(installed: DataFrame, proprietary: bool) -> DataFrame:
    """(name, spdx, path, risk, severity): one row for each name and licence, the least path first; permissive ones left out."""
    rows = installed.groupBy("name", "spdx").agg(F.min("path").alias("path")).withColumn("risk", licence_risk(F.col("spdx")))
    return rows.where("risk <> 'permissive'").withColumn("severity", licence_severity(F.col("risk"), F.lit(proprietary)))


def licence_words(kind: Column) -> Column:
    """A struct of the rule id and the words for a licence risk."""
    rule = F.when(kind == "strong", "license-strong-copyleft").when(kind == "weak", "license-weak-copyleft").when(kind == "unknown", "license-unknown").otherwise("license-permissive")
    words = F.when(kind == "strong", "strong copyleft").when(kind == "weak", "weak copyleft").when(kind == "unknown", "unknown/missing license").otherwise("permissive")
    return F.struct(rule.alias("rule"), words.alias("words"))


def is_proprietary(manifest: Column) -> Column:
    """Whether the text of the root's package.json makes a product proprietary; so does a missing or broken one."""
    licence = npm_licence(manifest)
    private = F.coalesce(F.get_json_object(manifest, "$.private") == "true", F.lit(False))
    broken = manifest.isNull() | F.get_json_object(manifest, "$").isNull()
    return broken | private | (F.upper(licence) == "UNLICENSED") | (licence == "") | (licence_risk(licence) == "unknown")


def python_licence(metadata: Column) -> Column:
    """A struct (name, spdx) of METADATA or PKG-INFO text: the last License-Expression counts; License and licence
    classifiers only while nothing was said before."""
    lines = F.filter(F.split(metadata, "\n"), lambda x: x.rlike("^(License-Expression|License|Classifier: License ::)"))
    said = lambda x: F.when(F.startswith(x, F.lit("Classifier: ")), F.regexp_extract(x, "^.*::(.*)$", 1)).otherwise(F.regexp_extract(x, "^[A-Za-z-]+: (.*)$", 1))
    spdx = F.aggregate(lines, F.lit(""), lambda a, x: F.when(F.startswith(x, F.lit("License-Expression: ")) | ((a == "") & (F.startswith(x, F.lit("License: ")) | F.startswith(x, F.lit("Classifier: License :: ")))), F.trim(said(x))).otherwise(a))
    return F.struct(F.trim(F.regexp_extract(metadata, "(?m)^Name: ([^\n]*)", 1)).alias("name"), spdx.alias("spdx"))


def installed_packages(files: DataFrame) -> DataFrame:
    """(name, spdx, path) of files(path, content): package.json under node_modules, METADATA of *.dist-info, PKG-INFO of *.egg-info."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    npm = (base == "package.json") & F.contains("path", F.lit("node_modules/"))
    python = ((base == "METADATA") & F.contains("path", F.lit(".dist-info"))) | ((base == "PKG-INFO") & F.contains("path", F.lit(".egg-info")))
    own = python_licence(F.col("content"))
    rows = files.select("path", F.when(npm, F.struct(F.get_json_object("content", "$.name").alias("name"), npm_licence(F.col("content")).alias("spdx"))).when(python, own).alias("p"))
    return rows.where("p.name <> ''").select("p.name", "p.spdx", "path")


def advisory_severity(name: Column) -> Column:
    """The level of an advisory's word; null for an unknown one."""
    word = F.upper(name)
    return F.when(word == "CRITICAL", risk.CRITICAL).when(word == "HIGH", risk.HIGH).when(word.isin("MODERATE", "MEDIUM"), risk.MEDIUM).when(word == "LOW", risk.LOW)


def npm_licence(metadata: Column) -> Column:
    """The licence of package.json text: a string, an object's type, or the first of a list."""
    text, kind, first = (F.get_json_object(metadata, p) for p in ("$.license", "$.license.type", "$.licenses[0].type"))
    return F.coalesce(kind, F.when(~F.startswith(F.ltrim(text), F.lit("{")), text), first, F.lit(""))


def dpkg_packages(files: DataFrame, *keep: str) -> DataFrame:
    """(*keep, name, version) of files(*keep, content): paragraphs with both, whose status says installed and not not-installed."""
    field = lambda name: F.regexp_extract("p", rf"(?m)^{name}: *([^\n]*)", 1)
    rows = files.select(*keep, F.explode(F.split("content", "\n\n+")).alias("p")).select(*keep, field("Package").alias("name"), field("Version").alias("version"), field("Status").alias("status"))
    return rows.where("name <> '' and version <> ''").where((F.col("status") == "") | (F.contains("status", F.lit("installed")) & ~F.contains("status", F.lit("not-installed")))).select(*keep, "name", "version")


def apk_packages(files: DataFrame, *keep: str) -> DataFrame:
    field = lambda name: F.regexp_extract("p", rf"(?m)^{name}:([^\n]*)", 1)
    return files.select(*keep, F.explode(F.split("content", "\n\n+")).alias("p")).select(*keep, field("P").alias("name"), field("V").alias("version")).where("name <> '' and version <> ''")


def ecosystem(os_release: Column) -> Column:
    """`Ubuntu:22.04`, `Alpine:v3.19`, else `Debian:<version>`, from the text of os-release."""
    part = lambda name: F.regexp_extract(os_release, rf'(?m)^{name}="?([^"\n]*)', 1)
    version = part("VERSION_ID")
    minor = F.regexp_extract(version, r"^(\d+\.\d+)", 1)
    name = F.when(part("ID") == "ubuntu", "Ubuntu").when(part("ID") == "alpine", "Alpine").otherwise("Debian")
    tail = F.when(name == "Alpine", F.concat(F.lit("v"), F.when(minor != "", minor).otherwise(version))).otherwise(version)
    return F.when(version == "", name).otherwise(F.concat_ws(":", name, tail))


def purl(eco: Column, name: Column, version: Column) -> Column:
    kind = F.lit("generic")
    for e, t in PURL_TYPES.items():
        kind = F.when(F.split(eco, ":")[0] == e, t).otherwise(kind)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


def components(packages: DataFrame) -> DataFrame:
    """(name, version, ecosystem, purl): each once, none without a name."""
    rows = packages.where("name is not null and name <> ''").select("name", "version", "ecosystem").distinct()
    return rows.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))


def vulnerabilities(packages: DataFrame, advisories: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """Packages with their advisories, joined on name, version and ecosystem; an advisory without a severity is MEDIUM.

    With reachable(name), packages outside it are unreachable and their risk LOW; without, reachability is unknown.
    """
    rows = packages.distinct().join(advisories, ["name", "version", "ecosystem"])
    rows = rows.withColumn("severity", F.coalesce("severity", F.lit(risk.MEDIUM)))
    known = F.lit(None).cast("boolean")
    if reachable is not None:
        rows = rows.join(reachable.select("name", F.lit(True).alias("_seen")).distinct(), "name", "left")
        known = F.coalesce("_seen", F.lit(False))
    real = risk.real_risk(F.lit("vulnerability"), F.col("severity"), F.lit(False), F.lit(False), F.lit(False), known)
    return rows.withColumns({"reachable": known, "real_risk": real}).select("name", "version", "ecosystem", "id", "severity", "reachable", "real_risk")


def reachable_packages(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name): imported packages and all that they depend on, from imports(name) and dependencies(parent, child).

    Each round finds packages that none before did, so the rounds end when there are no more, whatever the depth.
    """
    found = imports.select("name").distinct()
    edge = found
    while True:
        step = edge.join(dependencies, edge["name"] == dependencies["parent"]).select(F.col("child").alias("name")).distinct()
        edge = checkpointed(step.join(found, "name", "left_anti"))
        if edge.isEmpty():
            return found
        found = checkpointed(found.unionByName(edge))
