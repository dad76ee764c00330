"""Registered queries over manifests and lockfiles that Spark writes, as texts, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifests as M
from .queries import query, table

# Twenty parts are a project; the part at place i needs those at 2 i + 1 and 2 i + 2, the first is asked for by the project. The kind of a project's
# lockfile follows its number. Source files bring in the part at place 3, in projects of even number that at place 1 too.
_KINDS = ["package-lock.json", "yarn.lock", "requirements.txt", "go.mod", "Gemfile.lock", "Cargo.lock", "composer.lock", "v1/package-lock.json"]
_ECOSYSTEMS = ["npm", "npm", "PyPI", "Go", "RubyGems", "crates.io", "Packagist", "npm"]


def _name(kind: Column, k: Column) -> Column:
    return F.when(kind == 3, F.concat(F.lit("example.com/lib/"), k)).when(kind == 6, F.concat(F.lit("v/lib-"), k)).when(kind == 2, F.concat(F.lit("Lib-"), k)).otherwise(F.concat(F.lit("lib-"), k))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 20").alias("project"), (F.col("p_partkey") % 20).cast("int").alias("place"), F.col("p_partkey").alias("k"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"))
    rows = rows.withColumn("kind", (F.col("project") % len(_KINDS)).cast("int"))
    return rows.withColumn("name", _name(F.col("kind"), F.col("k").cast("string")))


def _text(kind: Column, own: Column) -> Column:
    """The lockfile of a project's parts, an array of (place, k, name, version, needs)."""
    each = lambda f, between="\n": F.array_join(F.transform(own, f), between)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    needs = lambda p, before, behind, between: F.array_join(F.transform(p["needs"], lambda n: said(before, n, behind)), between)
    top = F.filter(own, lambda p: p["place"] == 0)
    asked = lambda before, behind: F.array_join(F.transform(top, lambda p: said(before, p["name"], behind)), ",")
    npm = said('{"lockfileVersion":3,"packages":{"":{"dependencies":{', asked('"', '":"*"'), '}},', each(lambda p: said('"node_modules/', p["name"], '":{"version":"', p["version"], '","dependencies":{', needs(p, '"', '":"*"', ","), "}}"), ","), "}}")
    old = said('{"lockfileVersion":1,"dependencies":{', each(lambda p: said('"', p["name"], '":{"version":"', p["version"], '","requires":{', needs(p, '"', '":"*"', ","), "}}"), ","), "}}")
    yarn = said("# yarn lockfile v1\n\n", each(lambda p: said('"', p["name"], '@^1", ', p["name"], '@*:\n  version "', p["version"], '"\n  dependencies:\n', needs(p, "    ", ' "*"', "\n"), "\n")))
    pip = said("# pinned\n-r other.txt\n", each(lambda p: said(p["name"], "==", p["version"], " ; python_version > '3'")), "\nloose>=2\n")
    go = said("module example.com/app\n\ngo 1.22\n\nrequire (\n", each(lambda p: said("\t", p["name"], " v", p["version"], " // indirect")), "\n)\n")
    gem = said("GEM\n  remote: https://rubygems.org/\n  specs:\n", each(lambda p: F.concat_ws("\n", said("    ", p["name"], " (", p["version"], ")"), F.when(F.size(p["needs"]) > 0, needs(p, "      ", " (>= 0)", "\n")))), "\n\nDEPENDENCIES\n", asked("  ", "!"), "\n")
    cargo = said('[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = [\n', asked(' "', '"'), "\n]\n\n", each(lambda p: said('[[package]]\nname = "', p["name"], '"\nversion = "', p["version"], '"\nsource = "registry"\ndependencies = [\n', needs(p, ' "', '",', "\n"), "\n]\n")))
    php = said('{"packages":[', each(lambda p: said('{"name":"', p["name"], '","version":"v', p["version"], '","require":{"php":">=8"', F.when(F.size(p["needs"]) > 0, ",").otherwise(""), needs(p, '"', '":"*"', ","), '},"autoload":{"psr-4":{"V\\\\Lib', p["k"].cast("string"), '\\\\":"src"}}}'), ","), "]}")
    out = F.lit("")
    for n, text in enumerate([npm, yarn, pip, go, gem, cargo, php, old]):
        out = F.when(kind == n, text).otherwise(out)
    return out


def _line(kind: Column, k: Column) -> Column:
    """(ending, line) of a source line that brings a part in."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = [("ts", said("import { a } from 'lib-", k, "/sub';")), ("js", said("const a = require(\"lib-", k, "\");")), ("py", said("import os, lib_", k, ".part as x")), ("go", said('\tx "example.com/lib/', k, '/pkg"')), ("rb", said("require 'lib/", k, "'")), ("rs", said("use lib_", k, "::thing;")), ("php", said("use V\\Lib", k, "\\Thing;")), ("jsx", said("import 'lib-", k, "';"))]
    out = F.struct(F.lit("").alias("ending"), F.lit("").alias("line"))
    for n, (ending, line) in enumerate(kinds):
        out = F.when(kind == n, F.struct(F.lit(ending).alias("ending"), line.alias("line"))).otherwise(out)
    return out


_SQL = f"""with recursive p as (select p_partkey // 20 as project, p_partkey % 20 as place, p_partkey as k, '1.' || p_size as version, p_partkey // 20 % {len(_KINDS)} as kind from part),
n as (select *, ({_ECOSYSTEMS})[kind + 1] as ecosystem, case kind when 3 then 'example.com/lib/' || k when 6 then 'v/lib-' || k when 2 then 'Lib-' || k else 'lib-' || k end as name from p),
tops as (select project, min(place) as top from n where place = 0 group by project),
e as (select a.project, a.k as parent, b.k as child from n a join n b on a.project = b.project and b.place in (2 * a.place + 1, 2 * a.place + 2) where a.kind not in (2, 3)),
r as (select project, k, 0 as steps, name || '@' || version as way from n where place = 3 or (place = 1 and project % 2 = 0) union all select r.project, e.child, steps + 1, way || ' > ' || n.name || '@' || n.version from r join e on e.parent = r.k join n on n.k = e.child),
best as (select k, steps, way from r qualify row_number() over (partition by k order by steps, way) = 1)"""


def _files(rows: DataFrame) -> DataFrame:
    """(path, content): the lockfiles, and beside those of npm a package.json that doesn't count."""
    child = rows.select("project", F.col("place").alias("child"), F.col("name").alias("need"))
    needs = rows.join(child, "project").where("child = 2 * place + 1 or child = 2 * place + 2").groupBy("k").agg(F.sort_array(F.collect_list("need")).alias("needs"))
    rows = rows.join(needs, "k", "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    rows = rows.groupBy("project", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "k", "name", "version", "needs"))).alias("own"))
    base = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("kind") + 1)
    files = rows.select(F.concat(F.lit("p"), F.col("project").cast("string"), F.lit("/"), base).alias("path"), _text(F.col("kind"), F.col("own")).alias("content"))
    beside = files.where(F.endswith("path", F.lit("package-lock.json"))).select(F.replace("path", F.lit("package-lock.json"), F.lit("package.json")).alias("path"), F.lit('{"dependencies": {"other": "^9.9.9"}}').alias("content"))
    inside = files.where(F.endswith("path", F.lit("yarn.lock"))).select(F.replace("path", F.lit("yarn.lock"), F.lit("node_modules/x/Cargo.lock")).alias("path"), F.lit('[[package]]\nname = "inner"\nversion = "1"\nsource = "r"\n').alias("content"))
    return files.unionByName(beside).unionByName(inside)


@query(f"""{_SQL} select 'p' || project || case when kind = 7 then '/v1' else '' end as project, ecosystem, name, version, kind in (2, 3) or place = 0 as direct, best.k is not null as reachable, steps, way from n left join best using (k)
  where kind <> 7 or project in (select project from tops)""")
def locked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of all lockfiles, whether the source files reach them, and by which way."""
    rows = _parts(spark, sf_dir)
    brought = rows.where("place = 3 or (place = 1 and project % 2 = 0)").withColumn("l", _line(F.col("kind"), F.col("k").cast("string")))
    lines = brought.select(F.concat(F.lit("p"), F.col("project").cast("string"), F.lit("/main."), F.col("l.ending")).alias("path"), F.lit(1).alias("line_no"), "l.line")
    return M.reach(M.locked(_files(rows)), M.imported(lines)).drop("dev")
