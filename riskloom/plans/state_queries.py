"""Registered queries that compare, add up and report findings, and those over packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import risk, titles
from ..functions import dotnet_patterns as DP
from ..functions.fix_texts import FIXES, OTHER_FIX
from ..functions.secret_patterns import SERVICES
from ..operators import audit as A
from ..operators import compare as C
from ..operators import credentials as K
from ..operators import documents as D
from ..operators import dotnet as N
from ..operators import lines as L
from ..operators import packages as P
from ..operators import routes as R
from ..operators import taint as T
from ..sources import trees
from ..sources.derived import code_lines, quoted
from .taint_sql import REACHED
from .queries import SQL, _BASE, _CODE, _CONFIG, _REDACTED, _ROUTES, _SECRET_ALL, _SECRETS, _TEST, _CODE_TEXTS, _secret_rows, placed_secrets, query, table


def findings(spark: SparkSession, sf_dir: str, code: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Findings of all scanners with risk, confidence, fingerprint and fix, written once: code, configuration, secrets, advisories."""
    rows = checkpointed(code_lines(spark, sf_dir)) if rows is None else rows
    code = L.code_findings(rows) if code is None else code
    columns = ["path", "line_no", "rule", "severity", "snippet", "kind", "real_risk", "confidence"]
    no, unknown = F.lit(False), F.lit(None).cast("boolean")
    plain = code.withColumn("kind", F.lit("code")).select(*columns[:6]).unionByName(L.config_findings(rows).withColumn("kind", F.lit("config")).select(*columns[:6]))
    plain = plain.withColumns({"real_risk": F.col("severity"), "confidence": risk.confidence(F.col("kind"), F.col("rule"), F.col("path"), no, no, no, no, unknown)})
    secret = _secret_rows(L.whole_texts(rows)).withColumnsRenamed({"key": "path", "match": "snippet"}).withColumn("kind", F.lit("secret"))
    known = _vulnerabilities(spark, sf_dir)
    sure = risk.confidence(F.lit("vulnerability"), F.col("id"), F.lit(""), no, no, no, no, F.col("reachable"))
    known = known.select(P.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("path"), F.lit(0).alias("line_no"), F.col("id").alias("rule"), "severity", F.concat_ws("@", "name", "version").alias("snippet"), F.lit("vulnerability").alias("kind"), "real_risk", sure.alias("confidence"))
    out = plain.unionByName(secret.select(*columns)).unionByName(known).withColumn("privileged", no)
    fix = F.when(F.col("kind") == "secret", K.fix(F.col("rule"))).otherwise("")
    return checkpointed(out.withColumns({"fingerprint": risk.fingerprint(F.col("rule"), F.col("path"), F.col("line_no"), F.col("snippet")), "fix": fix}))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts of routes) over one written table of code findings."""
    rows = checkpointed(code_lines(spark, sf_dir))
    code = checkpointed(L.code_findings(rows))
    return findings(spark, sf_dir, code, rows), R.verdicts(R.targets(R.routes(rows), code))


#: Licence strings dealt to parts, and ecosystems dealt to them.
LICENCES = ["MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1", "", "UNLICENSED", "AGPL-3.0", "MPL-2.0", "Proprietary", "BSD-3-Clause", "GNU General Public License"]
ECOSYSTEMS = ["npm", "PyPI", "Go", "RubyGems", "crates.io", "Alpine:v3.19", "Debian:12"]
_PACKAGES = f"packages as (select 'pkg' || p_partkey % 61 as name, '1.' || p_size % 7 as version, ([{', '.join(map(quoted, ECOSYSTEMS))}])[p_partkey % {len(ECOSYSTEMS)} + 1] as ecosystem from part)"
_KNOWN = f"""{_PACKAGES}, adv as (select 'pkg' || s_suppkey % 61 as name, '1.' || s_suppkey % 7 as version, ([{', '.join(map(quoted, ECOSYSTEMS))}])[s_suppkey % {len(ECOSYSTEMS)} + 1] as ecosystem, 'ADV-' || s_suppkey as id, case when s_suppkey % 4 = 3 then null else (s_suppkey % 5)::int end as severity from supplier),
imported as (select distinct 'pkg' || n_nationkey as name from nation),
known_bad as (select p.name, version, ecosystem, id, coalesce(severity, 2) as severity, i.name is not null as reachable, case when i.name is null then 1 else coalesce(severity, 2) end as real_risk from (select distinct * from packages) p join adv using (name, version, ecosystem) left join imported i on i.name = p.name)"""
_PURL = "case string_split(ecosystem, ':')[1] " + " ".join(f"when {quoted(e)} then {quoted(t)}" for e, t in P.PURL_TYPES.items()) + " else 'generic' end"
_FIX = "case rule " + " ".join(f"when {quoted(r)} then {quoted(t)}" for r, t in FIXES.items()) + f" else {quoted(OTHER_FIX)} end"
_CONFIG_TAIL = _CONFIG[_CONFIG.index("files as (select path") :]
_ALL = f"""{_ROUTES}, {_CONFIG_TAIL}, {_CODE_TEXTS}, {_SECRETS}, secret_rows as ({_SECRET_ALL}), {_KNOWN},
findings as materialized (select * exclude (low_path), left(sha256(rule || chr(0) || path || chr(0) || line_no || chr(0) || snippet), 16) as fingerprint, case when kind = 'secret' then {_FIX} else '' end as fix from (
  select path, line_no, rule, severity, snippet, kind, severity as real_risk, case when kind = 'code' and {_TEST} then 0 else 1 end as confidence, low_path from (
    select path, line_no, rule, severity, snippet, 'code' as kind, '/' || lower(path) as low_path from code_findings
    union all select path, line_no, rule, severity, snippet, 'config', '' from config_findings)
  union all select key, line_no, rule, severity, match, 'secret', real_risk, confidence, '' from secret_rows
  union all select 'pkg:' || {_PURL} || '/' || name || '@' || version, 0, id, severity, name || '@' || version, 'vulnerability', real_risk, case when reachable then 2 else 1 end, '' from known_bad))
"""


@query(f"{_ALL} select path, line_no, rule, severity, snippet, kind, real_risk, confidence, fingerprint, fix from findings")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).drop("privileged")


@query(f"{_ALL}, base as (select distinct fingerprint from findings where line_no % 5 = 0) select path, line_no, rule, fingerprint from findings where fingerprint not in (select fingerprint from base)")
def beyond_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return C.beyond_baseline(rows, rows.where("line_no % 5 = 0")).select("path", "line_no", "rule", "fingerprint")


@query(f"""{_ALL}, changed as (select path, line_no as line from code_lines where line_no % 4 = 0 and length(path) % 3 <> 0 union select path, 0 from code_lines where ends_with(path, '.go')),
files as (select path, min(line) = 0 as new_file from changed group by path)
select f.path, line_no, rule, new_file or exists (select 1 from changed c where c.path = f.path and c.line = f.line_no) as introduced from findings f join files using (path)""".replace("files as (select path, min", "touched as (select path, min").replace("join files using", "join touched using"))
def introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    changed = rows.where("line_no % 4 = 0 and length(path) % 3 <> 0").select("path", F.col("line_no").alias("line"))
    changed = changed.union(rows.where(F.endswith("path", F.lit(".go"))).select("path", F.lit(0).alias("line")))
    return C.introduced(findings(spark, sf_dir), changed).select("path", "line_no", "rule", "introduced")


@query(f"{_ALL}, levels(real_risk, name) as (values (0, 'INFO'), (1, 'LOW'), (2, 'MEDIUM'), (3, 'HIGH'), (4, 'CRITICAL')) select real_risk, name, count(path) as findings from levels left join findings using (real_risk) group by all")
def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.risk_counts(findings(spark, sf_dir))


_GRADE = "case " + " ".join(f"when score >= {least} then {quoted(g)}" for least, g in risk.GRADES) + " else 'F' end"


@query(f"""{_ALL}, c as (select count_if(real_risk = 4 and confidence >= 1) as critical, count_if(real_risk = 3 and confidence >= 1) as high, count_if(real_risk = 2 and confidence >= 1) as medium,
  count_if(real_risk = 1 and confidence >= 1) as low, count_if(real_risk = 0 and confidence >= 1) as info, coalesce(max(real_risk), 0) as highest, count(*) as findings, count_if(real_risk >= 2) as "real" from findings),
r as (select count(*) as endpoints, count_if(not auth) as "open", count_if(not auth and sinks > 0) as exploitable from verdicts),
s as (select *, greatest(0, 100 - critical * 25 - high * 12 - medium * 5 - low - exploitable * 8)::bigint as score from c, r) select *, {_GRADE} as grade from s""")
def audit_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(*_judged(spark, sf_dir))


@query(f"""{_ALL}, o as (select *, row_number() over (partition by path order by real_risk desc, line_no, rule) as n from findings)
select path, max(real_risk) as highest, count(*) as findings, count_if(confidence >= 1) as firm, count_if(confidence = 0) as tentative, coalesce(max(case when confidence >= 1 then real_risk end), 0) as blocking,
  max(case when n = 1 then rule end) as top_rule, max(case when n = 1 then line_no end) as top_line from o group by path""")
def review_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review(findings(spark, sf_dir))


@query(f"""{_ALL}, b as (select 0 as part, 3 as level, method || ' ' || route as what, path, line_no from verdicts where not auth and sinks > 0
  union all select 1, real_risk, rule, path, line_no from (select * from findings where real_risk >= 1 order by real_risk desc, path, line_no, rule limit 8) where real_risk >= 2)
select * from b order by part, level desc, path, line_no, what limit 6""")
def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prioritise(*_judged(spark, sf_dir))


_WAYS = {"code execution": "cwe in ('CWE-78', 'CWE-95') and not auth", "upload": "cwe = 'CWE-434'", "file inclusion": "cwe = 'CWE-22'", "internal requests": "cwe = 'CWE-918'", "database": "cwe = 'CWE-89' and not auth"}
_CHAINS = " union all ".join(f"select {quoted(w)} as way, path, line_no, method, route, row_number() over (order by path, line_no, method, route) as n from targets where {c}" for w, c in _WAYS.items())


@query(f"{_ROUTES}, c as ({_CHAINS}) select way, path, line_no, method, route from c where n = 1")
def attack_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return A.chains(R.targets(R.routes(rows), L.code_findings(rows)))


@query(f"""{_ALL} select path, line_no, rule, '{{"ruleId":"' || rule || '","level":"' || case when real_risk >= 3 then 'error' when real_risk = 2 then 'warning' else 'note' end || '","message":{{"text":"' || rule ||
'"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line_no || '}}}}}}]}}' as result from findings""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sarif_results(findings(spark, sf_dir))


@query(f"""{_ROUTES}, m as (select distinct regexp_replace(route, ':([A-Za-z_]\\w*)', '{{\\1}}', 'g') as route, lower(case when upper(method) in ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') then method else 'GET' end) as method from routes)
select route, '{{' || string_agg('"' || method || '":{{}}', ',' order by method) || '}}' as operations from m group by route""")
def openapi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.openapi_paths(R.routes(code_lines(spark, sf_dir)))


@query(f"""{_ROUTES}, o as (select upper(method) as method, route, auth, path || lpad(line_no::varchar, 4, '0') || framework as ord, line_no from routes),
base as (select method, route, max_by(auth, ord) as was from o where line_no % 3 <> 0 group by 1, 2), head as (select method, route, min_by(auth, ord) as auth from o where line_no % 3 <> 1 group by 1, 2),
d as (select method, route, case when was is null and not auth then 'new-open' when was is null then 'new' when was and not auth then 'weakened' end as change from head left join base using (method, route)) select * from d where change is not null""")
def posture_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.routes(code_lines(spark, sf_dir)).withColumn("ord", F.concat("path", F.lpad(F.col("line_no").cast("string"), 4, "0"), "framework"))
    return R.posture_delta(rows.where("line_no % 3 <> 0"), rows.where("line_no % 3 <> 1"))


@query(f"""{_ALL}, b as (select *, {_BASE} as base_name from findings where line_no % 3 <> 0 and real_risk >= 2), h as (select distinct rule, {_BASE} as base_name, trim(snippet) as t from findings where line_no % 3 <> 1)
select path, line_no, rule from b where not exists (select 1 from h where h.rule = b.rule and h.base_name = b.base_name and h.t = trim(b.snippet))""")
def resolved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).withColumnRenamed("snippet", "match")
    return C.resolved(rows.where("line_no % 3 <> 0"), rows.where("line_no % 3 <> 1")).select("path", "line_no", "rule")


@query(f"""{_CODE}, guarded as (select path, line_no, case when k % 9 < 5 then 'role:Admin' when k % 9 < 7 then 'auth' else '' end as guard from (select *, line_no * 7 + length(path) as k from code_lines where ends_with(path, '.cs'))),
l as (select *, case when guard = '' then 0 when guard = 'auth' then 1 else 2 end as level from guarded), t as (select *, count(*) over w as n, max(level) over w as top from l window w as (partition by path)),
a as (select *, count_if(level = top) over (partition by path) as at_top from t), u as (select path, guard, row_number() over (partition by path order by count(*) desc, guard) as r from a where level = top group by path, guard)
select a.path, line_no, a.guard, level, u.guard as dominant from a join u on a.path = u.path and r = 1 where n >= 3 and top > 0 and at_top * 2 >= n and level < top""")
def guard_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line_no") * 7 + F.length("path")
    rows = code_lines(spark, sf_dir).where(F.endswith("path", F.lit(".cs")))
    rows = rows.select("path", "line_no", F.when(k % 9 < 5, "role:Admin").when(k % 9 < 7, "auth").otherwise("").alias("guard"))
    return R.guard_outliers(rows).select("path", "line_no", "guard", "level", "dominant")


@query(f"""{_CODE}, blame as (select path, line_no, o_orderdate as written from code_lines join (select case when (o_orderkey // 24) % 7 = 3 then 'tests/' else 'src/' end as head, o_orderkey // 24 as file, (o_orderkey % 24 + 1)::int as line_no, o_orderdate from orders)
  using (line_no) where regexp_extract(path, '[0-9]+', 0) = file::varchar)
select path, line_no, rule, greatest(floor((epoch(timestamp '2000-01-01') - epoch(written)) / 86400), 0)::bigint as days, 'exposed ~' || greatest(floor((epoch(timestamp '2000-01-01') - epoch(written)) / 86400), 0)::bigint || ' days (since ' || strftime(written, '%Y-%m-%d') || ')' as exposure
from code_findings join blame using (path, line_no)""")
def exposure_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 24").cast("string").alias("file"), (F.expr("o_orderkey % 24") + 1).cast("int").alias("line"), F.col("o_orderdate").alias("author_time"))
    blame = rows.select("path", F.col("line_no").alias("line"), F.regexp_extract("path", "[0-9]+", 0).alias("file")).join(dates, ["file", "line"])
    return C.exposure(L.code_findings(rows), blame, F.expr("timestamp '2000-01-01'")).select("path", "line_no", "rule", "days", "exposure")


_LIVE = "with live(rule, key) as (select case p_partkey % 12 " + " ".join(f"when {i} then {quoted(r)}" for i, r in enumerate(SERVICES)) + " end, p_partkey from part where p_size % 5 = 0)"
_SERVICE = "case " + " ".join(f"when rule = {quoted(r)} then {quoted(s)}" for r, s in SERVICES.items()) + " end"


@query(f"""{_LIVE}, s as (select {_SERVICE} as service, key % 2 = 0 as privileged from live)
select coalesce(string_agg(distinct service, ',' order by service), '') as live, coalesce(string_agg(distinct case when privileged then service end, ',' order by case when privileged then service end), '') as privileged, count(distinct service) >= 2 as several from s""")
def attack_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.element_at(F.array(*[F.lit(r) for r in SERVICES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(rules.alias("rule"), (F.col("p_size") % 5 == 0).alias("live"), (F.col("p_partkey") % 2 == 0).alias("privileged"))
    return A.attack_path(rows, SERVICES)


_INSTALLED = f"installed as (select 'pkg' || p_partkey % 97 as name, ([{', '.join(map(quoted, LICENCES))}])[p_partkey % {len(LICENCES)} + 1] as spdx, 'node_modules/' || p_partkey as path from part)"


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    spdx = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (key % len(LICENCES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("pkg"), (key % 97).cast("string")).alias("name"), spdx.alias("spdx"), F.concat(F.lit("node_modules/"), key.cast("string")).alias("path"))


def _contains(column: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(p)})" for p in parts) + ")"


@query(f"""with {_INSTALLED}, d as (select name, spdx, min(path) as path, upper(trim(spdx)) as s from installed group by name, spdx),
r as (select name, spdx, path, case when s in ('', 'UNLICENSED', 'SEE LICENSE IN LICENSE') then 'unknown' when contains(s, 'AGPL') then 'strong' when contains(s, 'GPL') and not contains(s, 'LGPL') then 'strong'
  when {_contains('s', P.WEAK)} then 'weak' when {_contains('s', P.PERMISSIVE)} then 'permissive' else 'unknown' end as risk from d)
select *, case risk when 'strong' then 3 when 'weak' then 2 else 2 end as severity, case risk when 'strong' then 'license-strong-copyleft' when 'weak' then 'license-weak-copyleft' else 'license-unknown' end as rule,
  case risk when 'strong' then 'strong copyleft' when 'weak' then 'weak copyleft' else 'unknown/missing license' end as words from r where risk <> 'permissive'""")
def licence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.licence_findings(_installed(spark, sf_dir), proprietary=True).select("*", P.licence_words(F.col("risk")).alias("w")).select("*", "w.rule", "w.words").drop("w")


@query("with p as (select p_partkey, p_size from part) select 'lib' || p_partkey as name, '1.' || p_size as version from p where p_partkey % 6 <> 0 and p_partkey % 9 <> 0")
def dpkg_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    status = F.when(key % 6 == 0, "not-installed").otherwise("installed")
    version = F.when(key % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("Version: 1."), F.col("p_size").cast("string")))
    text = F.concat(F.lit("Package: lib"), key.cast("string"), F.lit("\nStatus: install ok "), status, F.lit("\n"), version)
    files = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("file")).agg(F.array_join(F.collect_list(text), "\n\n").alias("content"))
    return P.dpkg_packages(files)


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    eco = F.element_at(F.array(*[F.lit(x) for x in ECOSYSTEMS]), (key % len(ECOSYSTEMS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("pkg"), (key % 61).cast("string")).alias("name"), F.concat(F.lit("1."), (F.col("p_size") % 7).cast("string")).alias("version"), eco.alias("ecosystem"))


@query(f"with {_PACKAGES} select distinct name, version, ecosystem, 'pkg:' || {_PURL} || '/' || name || '@' || version as purl from packages")
def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.components(_packages(spark, sf_dir))


@query(f"with {_KNOWN} select * from known_bad")
def vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vulnerabilities(spark, sf_dir)


def _vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    eco = F.element_at(F.array(*[F.lit(x) for x in ECOSYSTEMS]), (key % len(ECOSYSTEMS) + 1).cast("int"))
    adv = table(spark, sf_dir, "supplier").select(F.concat(F.lit("pkg"), (key % 61).cast("string")).alias("name"), F.concat(F.lit("1."), (key % 7).cast("string")).alias("version"), eco.alias("ecosystem"), F.concat(F.lit("ADV-"), key.cast("string")).alias("id"), F.when(key % 4 != 3, (key % 5).cast("int")).alias("severity"))
    imported = table(spark, sf_dir, "nation").select(F.concat(F.lit("pkg"), F.col("n_nationkey").cast("string")).alias("name"))
    return P.vulnerabilities(_packages(spark, sf_dir), adv, imported)


_TITLE = "case when kind = 'vulnerability' then regexp_extract(snippet, '^(.*)@', 1) || ' — ' || rule else case rule " + " ".join(f"when {quoted(r)} then {quoted(t)}" for r, t in titles.ALL_TITLES.items()) + " else rule end end"
_CWE = "case when kind = 'code' then case rule " + " ".join(f"when {quoted(r)} then {quoted(c)}" for r, c in titles.WEAKNESSES.items()) + " end end"


_TAINTED = f"""{_CODE.replace("with ", "with recursive ", 1)}, {REACHED},
tainted as materialized (select c.*, (coalesce(tainted, false) and not (cwe = 'CWE-79' and coalesce(html_safe, false))) or rule = 'idor' as user_input, origin from code_findings c left join reached r on r.path = c.path and r.line_no = c.line_no)"""


@query(f"""{_TAINTED} select path, line_no, rule, cwe, user_input, case when user_input and coalesce(origin, 0) > 0 and origin <> line_no then 'input enters at line ' || origin else '' end as note, case when {_TEST} then 0 when user_input then 2 else 1 end as confidence from (select *, '/' || lower(path) as low_path from tainted)""")
def tainted_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code findings with the user input that reaches them."""
    rows = code_lines(spark, sf_dir)
    found, no = T.with_taint(L.code_findings(rows), T.taint(rows)), F.lit(False)
    sure = risk.confidence(F.lit("code"), F.col("rule"), F.col("path"), no, no, no, F.col("user_input"), F.lit(None).cast("boolean"))
    return found.select("path", "line_no", "rule", "cwe", "user_input", "note", sure.alias("confidence"))


def _last_said(value: str, group: str) -> str:
    return f"last_value({value} ignore nulls) over (partition by path, {group} order by line_no rows unbounded preceding)"


_WS = "[\\t\\n\\x0b\\f\\r ]"
_CS = lambda p: quoted(p.replace("\\s", _WS))
_GUARD_OF = f"""case when regexp_matches(line, {_CS(DP.ANONYMOUS)}) then 'anonymous' when not regexp_matches(line, {_CS(DP.AUTHORIZE)}) then null
  when regexp_matches(regexp_extract(line, {_CS(DP.ARGUMENTS)}, 1), {_CS(DP.ROLES)}) then 'role:' || regexp_extract(regexp_extract(line, {_CS(DP.ARGUMENTS)}, 1), {_CS(DP.ROLES)}, 1)
  when regexp_matches(regexp_extract(line, {_CS(DP.ARGUMENTS)}, 1), {_CS(DP.POLICY)}) then 'policy:' || regexp_extract(regexp_extract(line, {_CS(DP.ARGUMENTS)}, 1), {_CS(DP.POLICY)}, 1) else 'auth' end"""
_BARE = "regexp_replace(" * 4 + "{}" + ", '\\([^()]*\\)|<[^<>]*>', '', 'g')" * 4
_CONTROLLERS = f"""cs as materialized (select path, line_no, line, {_GUARD_OF} as said, regexp_matches(line, {_CS(DP.METHOD)}) as is_method, regexp_matches(line, {_CS(DP.VERB)}) as is_verb, regexp_matches(line, {_CS(DP.CLASS)}) as is_class,
  case when regexp_matches(line, {_CS(DP.ROUTE)}) then regexp_extract(line, {_CS(DP.ROUTE)}, 1) end as own_route from code_lines where ends_with(path, '.cs')),
parts as (select *, coalesce(sum((is_method or is_verb or is_class)::int) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0) as part,
  list({{'m': is_method, 'g': said}}) over (partition by path order by line_no rows between 1 following and {DP.LINES_AHEAD} following) as below, array_to_string(list(line) over (partition by path order by line_no rows between current row and {DP.HEADER_LINES - 1} following), ' ') as header from cs),
held as materialized (select *, coalesce({_last_said('own_route', 'part')}, '') as route, {_last_said('said', 'part')} as guard,
  list_filter(below[1:coalesce(list_position(list_transform(below, lambda b: b.m), true) - 1, len(below))], lambda b: b.g is not null)[1].g as ahead from parts),
class_lines as materialized (select path, line_no, regexp_extract(line, {_CS(DP.CLASS)}, 1) as class, route as prefix, guard, {_BARE.format(f"regexp_replace(string_split(header, '{{{{')[1], '^.*?' || {_CS(DP.CLASS)}, '')")} as rest from held where is_class and not is_verb),
bases as materialized (select * exclude (rest), case when regexp_extract(rest, ':[^A-Za-z0-9_]*(\\w+)', 1) in ({', '.join(map(quoted, DP.FRAMEWORK_BASES))}) then '' else regexp_extract(rest, ':[^A-Za-z0-9_]*(\\w+)', 1) end as base from class_lines),
verbs as (select h.path, h.line_no, h.line, h.route, h.guard, case when h.is_method then null else h.ahead end as ahead, c.class, c.prefix, c.guard as class_guard from held h asof left join bases c on h.path = c.path and h.line_no > c.line_no where h.is_verb),
named as (select *, upper(regexp_extract(line, {_CS(DP.VERB)}, 1)) as method, trim(case when regexp_extract(line, {_CS(DP.VERB)}, 2) <> '' then regexp_extract(line, {_CS(DP.VERB)}, 2) else route end, chr(9) || chr(10) || chr(13) || ' ') as action from verbs),
paths as (select *, case when starts_with(action, '/') then action else '/' || array_to_string(list_filter([trim(coalesce(prefix, ''), '/'), trim(action, '/')], lambda x: x <> ''), '/') end as full_path from named),
owned as (select path, line_no, method, coalesce(class, '') as class, coalesce(case when ahead is not null and (guard is null or ahead = 'anonymous') then ahead else guard end, class_guard) as guard,
  replace(regexp_replace(replace(replace(full_path, '[controller]', lower(regexp_replace(coalesce(class, ''), 'Controller$', ''))), '[action]', ''), {_CS(DP.CONSTRAINT)}, '{{\\1}}', 'g'), '//', '/') as route from paths),
last_class as (select class, base, guard from bases qualify row_number() over (partition by class order by path desc, line_no desc) = 1),
chain as (select class, base, null::varchar as inherited, 0 as depth from last_class union all select c.class, coalesce(l.base, ''), l.guard, depth + 1 from chain c left join last_class l on l.class = c.base where c.base <> '' and c.inherited is null and depth < {DP.MOST_BASES}),
inherits as (select class, max(inherited) as inherited from chain group by class),
above as (select line, list_filter([lag(line, 1) over w, lag(line, 2) over w, lag(line, 3) over w], lambda x: x is not null and trim(x, chr(9) || chr(13) || ' ') <> '')[1] as prior from cs window w as (partition by path order by line_no)),
wide as (select coalesce((select bool_or(u and f) from (select bool_or(contains(line, {quoted(DP.GLOBAL_USER)})) as u, {" or ".join(f"bool_or(contains(line, {quoted(w)}))" for w in DP.GLOBAL_FILTERS)} as f from cs group by path)), false)
  or coalesce((select bool_or(regexp_matches(line, {_CS(DP.MAP_ALL_REQUIRED)}) or (regexp_matches(line, {_CS(DP.REQUIRE_ALONE)}) and coalesce(regexp_matches(prior, {_CS(DP.MAP_ALL)}), false))) from above), false) as everywhere),
controllers as materialized (select method, case when route = '' then '/' else route end as route, path, line_no, o.class, coalesce(guard, case when inherited <> 'anonymous' then 'auth' else inherited end, case when everywhere then 'auth' end) as said from owned o left join inherits i on i.class = o.class, wide),
controller_routes as materialized (select method, route, path, line_no, class, case when said is null or said = 'anonymous' then '' else said end as guard, not (said is null or said = 'anonymous') as auth, method <> 'GET' or contains(route, '{{') as user_input from controllers)"""
_RECURSIVE_ROUTES = _ROUTES.replace("with ", "with recursive ", 1)


@query(f"{_RECURSIVE_ROUTES}, {_CONTROLLERS} select * from controller_routes")
def controller_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute-routed routes of C# controllers, with the guards of their classes and bases."""
    return N.controller_routes(code_lines(spark, sf_dir))


@query(f"{_CODE.replace('with ', 'with recursive ', 1)}, {REACHED} select * from reached")
def input_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the files that take part, whether input reaches it, only encoded input, and where it entered."""
    return T.taint(code_lines(spark, sf_dir))


#: A policy file and a file of custom rules, one of them broken.
POLICY = "# policy\nfail-on: high\ndisable: [idor, 'weak-hash']\nignore:\n  - tests\n  - \"*.rb\"\n"
RULES = "rules:\n  - id: no-total\n    pattern: 'return total\\d+'\n    langs: [js]\n    severity: high\n    cwe: CWE-1\n  - id: broken\n    pattern: '('\n"
_KEPT_CODE = _CODE.replace("as lang from code_lines)", "as lang from code_lines where not starts_with(path, 'tests/') and not ends_with(path, '.rb'))")


@query(f"""{_KEPT_CODE}, c as (select path, line_no, rule, severity, cwe, snippet from code_findings where rule not in ('idor', 'weak-hash') union all select path, line_no, 'custom:no-total', 3, 'CWE-1', snippet from plain where lang = 'js' and regexp_matches(line, 'return total\\d+'))
select *, severity >= 3 as fails from c""")
def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code findings under a policy: ignored paths, rules switched off, custom rules, and whether each reaches the level that fails a run."""
    policy = trees.parse_policy(POLICY)
    rows = code_lines(spark, sf_dir).where(~trees.ignored(F.col("path"), policy.ignore))
    found = C.enabled(L.code_findings(rows, trees.parse_rules(RULES)), policy.disable)
    return found.withColumn("fails", F.col("severity") >= risk.SEVERITIES.index(policy.fail_on.upper()))


#: A code base for each supplier: input that goes through calls over files, is turned to numbers, encoded, assigned anew and lost at function ends.
FLOWS = [
    ("web/in_@K@.js", ["function start(req, res) {", "  const v = req.query.v;", "  const n = parseInt(v);", "  relay@K@(v);", "  count@K@(n);", "  const w = 'a' + v + 'b';", "  eval(w);", "}", "function next(a) {", "  eval(v);", "}"]),
    ("web/mid_@K@.js", ["function relay@K@(p, q) {", "  if (p) { hop@K@(p); }", "  const safe = encodeURIComponent(p);", "  el.innerHTML = safe;", "  el.innerHTML = safe + p;", "}", "function count@K@(c) {", "  eval(c);", "}"]),
    ("web/out_@K@.js", ["function hop@K@(z) {", "  db.query('select ' + z);", "  z = Number(z);", "  eval(z);", "}", "function lone@K@(y) {", "  eval(y);", "}"]),
    ("py/view_@K@.py", ["def view(request):", "    q = request.args.get('q')", "    r = html.escape(q)", "    save_@K@(q, r)", "    q = 'fixed'", "    os.system(q)", "    os.system(r)"]),
    ("py/store_@K@.py", ["def save_@K@(text, other):", "    os.system(other)", "    os.system(text)", "def twice(text):", "    os.system(text)"]),
    ("cs/Item@K@.cs", ["public class Item@K@Controller : ControllerBase {", "[HttpGet(\"{id}\")]", "[Authorize]", "public IActionResult Get(string id, [FromQuery(Name = \"n\")] Dictionary<string, int> map, int n = 0) {", "  var name = id.Trim();", "  return Ok(svc.Fetch@K@(name, 1));", "}", "public int Plain(string id) {", "  Process.Start(id);", "}"]),
    ("cs/Service@K@.cs", ["public class Service@K@ {", "  public Item Fetch@K@(string key, int kind) {", "    var count = int.Parse(key);", "    db.Run(count, kind);", "    return db.Run(\"x\" + key);", "  }", "}"]),
]
CODE_BASES_A_TASK = 2000
_FLOW_LINES = " union all ".join(f"select replace({quoted(path)}, '@K@', s_suppkey::varchar) as path, unnest(range(1, {len(own) + 1}))::int as line_no, unnest([{', '.join(map(quoted, own))}]) as text, s_suppkey as k from supplier" for path, own in FLOWS)


@query(f"with recursive code_lines as materialized (select path, line_no, replace(text, '@K@', k::varchar) as line from ({_FLOW_LINES})), {REACHED} select * from reached")
def input_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over code in which input goes from file to file."""
    texts = [F.struct(F.lit(path).alias("head"), F.lit(n).alias("line_no"), F.lit(line).alias("text")) for path, own in FLOWS for n, line in enumerate(own, 1)]
    k = F.col("s_suppkey").cast("string")
    own = table(spark, sf_dir, "supplier").select("s_suppkey")
    own = own.repartition(max(spark.sparkContext.defaultParallelism, own.count() // CODE_BASES_A_TASK))  # few bytes, but each becomes seven files
    rows = own.select("s_suppkey", F.inline(F.array(*texts))).select(F.replace("head", F.lit("@K@"), k).alias("path"), "line_no", F.replace("text", F.lit("@K@"), k).alias("line"))
    return T.taint(rows)


@query(f"""{_ALL.replace("with ", "with recursive ", 1)}, {REACHED},
j as (select f.*, '/' || lower(f.path) as low_path, kind = 'code' and ((coalesce(tainted, false) and not (coalesce({_CWE}, '') = 'CWE-79' and coalesce(html_safe, false))) or rule = 'idor') as user_input, origin from findings f left join reached r on r.path = f.path and r.line_no = f.line_no)
select path, line_no, rule, kind, user_input, case when kind = 'code' and {_TEST} then 0 when kind = 'code' and user_input then 2 else confidence end as confidence, case when user_input and coalesce(origin, 0) > 0 and origin <> line_no then 'input enters at line ' || origin else '' end as note from j""")
def confirmed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all scanners, those of code with the input that reaches them; where it does they are confirmed."""
    rows = checkpointed(code_lines(spark, sf_dir))
    every = findings(spark, sf_dir, rows=rows).withColumn("cwe", F.coalesce(titles.weakness(F.col("kind"), F.col("rule")), F.lit("")))
    code = T.with_taint(every.where("kind = 'code'"), T.taint(rows))
    no = F.lit(False)
    sure = risk.confidence(F.lit("code"), F.col("rule"), F.col("path"), no, no, no, F.col("user_input"), F.lit(None).cast("boolean"))
    others = every.where("kind <> 'code'").withColumns({"user_input": no, "note": F.lit("")})
    return code.withColumn("confidence", sure).unionByName(others).select("path", "line_no", "rule", "kind", "user_input", "confidence", "note")


_HEAD, _TAIL = _RECURSIVE_ROUTES.split("spans as (", 1)
_EVERY = f"""{_HEAD.replace("routes as materialized (", "plain_routes as materialized (", 1)} {_CONTROLLERS},
guarded_routes as materialized (select method, route, framework, path, line_no, auth, user_input, rate_limited, '' as guard from plain_routes
  union all select method, route, 'GraphQL', path, line_no, false, true, false, '' from ({SQL["graphql_routes"]}) union all select method, route, 'OpenAPI', path, line_no, false, false, false, '' from ({SQL["openapi_routes"]})
  union all select method, route, 'ASP.NET Core', path, line_no, auth, user_input, false, guard from controller_routes),
routes as materialized (select * exclude (guard) from guarded_routes), spans as ({_TAIL}"""


@query(f"{_EVERY} select * from guarded_routes")
def every_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all kinds, controllers and declared ones among them."""
    return R.every_route(code_lines(spark, sf_dir))


@query(f"{_EVERY} select * from verdicts")
def every_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure verdicts of routes of all kinds."""
    rows = checkpointed(code_lines(spark, sf_dir))
    return R.verdicts(R.targets(R.every_route(rows).drop("guard"), L.code_findings(rows)))


_NAMES = "['" + "', '".join(reversed(risk.SEVERITIES)) + "']"
_ORD = "(4 - real_risk) || chr(9) || path || chr(9) || lpad(line_no::varchar, 9, '0') || chr(9) || rule || chr(9) || fingerprint"
_Q = lambda c: f"to_json({c})::varchar"


def _document_sql(source: str, order: str, item: str, head: str, tail: str, between: str = ",") -> str:
    return f"""it as (select {order} as ord, {item} as item from {source}), st as (select min(ord) as first from it)
select 1 as part, ord, case when ord = first then item else {quoted(between)} || item end as line from it, st union all select 0, '', {quoted(head)} union all select 2, '', {quoted(tail)}"""


_DISTINCT = "(select distinct * from findings)"
_LEVEL_NAME = "(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])"


@query(f"{_ALL}, " + _document_sql(_DISTINCT, _ORD, f"""'{{"kind":' || {_Q('kind')} || ',"rule_id":' || {_Q('rule')} || ',"title":' || {_Q(_TITLE)} || ',"severity":"' || {_LEVEL_NAME}[severity + 1] || '","file":' || {_Q('path')} || ',"line":' || line_no || ',"match":' || {_Q('snippet')} || ',"fix":' || {_Q('fix')} || ',"context":' || coalesce('{{"cwe":"' || {_CWE} || '","note":"' || {_CWE} || ' — pattern-based detection"}}', '{{}}') || ',"real_risk":"' || {_LEVEL_NAME}[real_risk + 1] || '"}}'""", "[", "]"))
def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.findings_json(findings(spark, sf_dir))


@query(f"{_ALL}, " + _document_sql("(select distinct fingerprint, rule, path, snippet from findings)", "fingerprint || chr(9) || rule || chr(9) || path || chr(9) || snippet", f"""'{{"fingerprint":"' || fingerprint || '","rule":' || {_Q('rule')} || ',"file":' || {_Q('path')} || ',"note":' || {_Q('snippet')} || '}}'""", '{"entries":[', "]}"))
def baseline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.baseline(findings(spark, sf_dir))


@query(f"{_ALL}, " + _document_sql(_DISTINCT, _ORD, f"""'{{"ruleId":' || {_Q('rule')} || ',"level":"' || case when real_risk >= 3 then 'error' when real_risk = 2 then 'warning' else 'note' end || '","message":{{"text":' || {_Q(_TITLE + " || coalesce(' — ' || " + _CWE + " || ' — pattern-based detection', '') || case when fix <> '' then ' Fix: ' || fix else '' end")} || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || {_Q('path')} || '}}' || case when line_no > 0 then ',"region":{{"startLine":' || line_no || '}}' else '' end || '}}}}]}}'""", '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"riskloom","version":"1.0.0","rules":[]}},"results":[', "]}]}"))
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sarif(findings(spark, sf_dir))


@query(f"with {_PACKAGES}, c as (select distinct name, version, ecosystem, 'pkg:' || {_PURL} || '/' || name || '@' || version as purl from packages), " + _document_sql("c", "name || chr(9) || version || chr(9) || ecosystem", f"""'{{"type":"library","name":' || {_Q('name')} || ',"version":' || {_Q('version')} || ',"purl":' || {_Q('purl')} || '}}'""", '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{"tools":[{"vendor":"riskloom","name":"riskloom"}]},"components":[', "]}"))
def sbom_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cyclonedx(P.components(_packages(spark, sf_dir)))


@query(f"""{_ALL}, d as (select distinct * from findings), n as (select count_if(real_risk >= 2) as "real", count(*) as total from d)
select 0 as part, '' as ord, '## riskloom security report' || chr(10) || chr(10) || case when total = 0 then 'No findings — clean scan.' else '**' || "real" || ' real risk(s)** · ' || (total - "real") || ' filtered as noise · ' || total || ' total' || chr(10) end as line from n
union all select 0, '~', '| Risk | Finding | Location | Fix |' || chr(10) || '|------|---------|----------|-----|' from n where total > 0 union all select 2, '', chr(10) || '<sub>' || (total - "real") || ' finding(s) verified harmless and filtered out.</sub>' from n where total > "real"
union all select 1, {_ORD}, '| ' || {_LEVEL_NAME}[real_risk + 1] || ' | ' || replace({_TITLE}, '|', '\\|') || ' | `' || path || case when line_no > 0 then ':' || line_no else '' end || '` | ' || replace(fix, '|', '\\|') || ' |' from d where real_risk >= 2""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.markdown(findings(spark, sf_dir))


@query(SQL["audit_grade"].replace(f"select *, {_GRADE} as grade from s", f"""select '{{"grade":"' || {_GRADE} || '","score":' || score || ',"risk_counts":{{"CRITICAL":' || critical || ',"HIGH":' || high || ',"MEDIUM":' || medium || ',"LOW":' || low || ',"INFO":' || info || '}},"endpoints":' || endpoints || ',"no_auth_endpoints":' || "open" || ',"exploitable_endpoints":' || exploitable || '}}' as audit from s"""))
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.audit_json(A.audit(*_judged(spark, sf_dir)))


@query(f"""{_ALL}, f as (select *, max(real_risk) over (partition by path) as worst, count(*) over (partition by path) as many from findings), n as (select count(*) as findings, coalesce(max(real_risk), 0) as highest, count(distinct path) as files, count_if(real_risk = 4) as n4, count_if(real_risk = 3) as n3, count_if(real_risk = 2) as n2, count_if(real_risk = 1) as n1 from findings),
b as (select rule || ' in ' || {_BASE} || ':' || line_no as start from f order by worst desc, many desc, path, real_risk desc, line_no, rule limit 1)
select findings, highest, case when findings = 0 then 'APPROVE — no security issues found. LGTM.' when highest >= 3 then 'REQUEST CHANGES — high-risk issue(s) must be addressed before merge.' when highest = 2 then 'COMMENT — some issues to consider; not blocking.' else 'APPROVE — only minor notes.' end as verdict,
  case when findings = 0 then 'This change introduces no new security risk.' else 'This change introduces ' || concat_ws(', ', case when n4 > 0 then n4 || ' critical' end, case when n3 > 0 then n3 || ' high' end, case when n2 > 0 then n2 || ' medium' end, case when n1 > 0 then n1 || ' low' end) || ' across ' || files || ' file(s). Start with ' || start || '.' end as summary from n, b""")
def review_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review_verdict(findings(spark, sf_dir))


@query(f"{_ALL} select coalesce(max(real_risk), 0) >= 3 as failed from findings")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gate(findings(spark, sf_dir), "HIGH")


@query(f"{_ALL} select path, line_no, rule, fingerprint from findings where rule not in ('idor', 'tf-public-rds', 'github-pat')")
def enabled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enabled(findings(spark, sf_dir), ["idor", "tf-public-rds", "github-pat"]).select("path", "line_no", "rule", "fingerprint")


@query(f"{_ALL} select path, line_no, rule from findings where path in (select path from code_lines where line_no = 3 and length(path) % 2 = 0)")
def findings_in_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_changed_files(findings(spark, sf_dir), code_lines(spark, sf_dir).where("line_no = 3 and length(path) % 2 = 0")).select("path", "line_no", "rule")


_LINE_SECRETS = f"{_CODE}, {_CODE_TEXTS}, {_SECRETS}, placed_secrets as materialized (select *, key as path from secrets)"


def _line_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_secrets(L.whole_texts(code_lines(spark, sf_dir)))


@query(f"{_LINE_SECRETS} select path, line_no, rule, {_REDACTED} as match from placed_secrets h anti join (select distinct rule, secret from placed_secrets where line_no % 3 <> 1) b using (rule, secret) where line_no % 3 <> 0 and not placeholder")
def new_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_secrets(spark, sf_dir).withColumnRenamed("secret", "match")
    return C.new_secrets(rows.where("line_no % 3 <> 1"), rows.where("line_no % 3 <> 0")).select("path", "line_no", "rule", risk.redact(F.col("match")).alias("match"))


@query(f"""{_LINE_SECRETS}, h as (select *, path || lpad(line_no::varchar, 4, '0') || rule as ord from placed_secrets where line_no % 2 = 0), f as (select secret, arg_min(rule, ord) as rule, arg_min(path, ord) as path, arg_min(line_no, ord) as line_no from h group by secret)
select rule, path, line_no, {_REDACTED} as match from f where not exists (select 1 from code_lines t where t.line_no % 2 = 1 and contains(t.line, f.secret))""")
def history_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even lines stand for blobs of the history, odd ones for the tree."""
    rows = _line_secrets(spark, sf_dir)
    history = rows.where("line_no % 2 = 0").select("secret", "rule", "path", "line_no", F.concat("path", F.lpad(F.col("line_no").cast("string"), 4, "0"), "rule").alias("ord"))
    tree = code_lines(spark, sf_dir).where("line_no % 2 = 1").select(F.col("line").alias("text"))
    return C.history_only(history, tree).select("rule", "path", "line_no", risk.redact(F.col("secret")).alias("match"))


_SCOPED = "case when substr(h, 3, 1) < '4' then ['repo', 'read:org'] when substr(h, 3, 1) < '8' then ['admin:org'] else ['gist', 'user'] end"


@query(f"""{_LINE_SECRETS}, a as (select path, line_no, rule, severity, placeholder, {_REDACTED} as match, md5(secret) as h from placed_secrets),
v as (select *, substr(h, 2, 1) < '8' as validated, substr(h, 2, 1) < '8' and substr(h, 1, 1) < '8' as live, case when substr(h, 2, 1) < '8' then {_SCOPED} else [] end as s from a)
select path, line_no, rule, match, validated, live, array_to_string(s, ',') as scopes, live and (list_contains(s, 'repo') or list_contains(s, 'admin:org')) as privileged,
  case when placeholder then 0 when not validated then severity when live then 4 else 0 end as real_risk, case when placeholder then 0 when validated and live then 2 when rule = 'generic-high-entropy' then 0 else 1 end as confidence, {_FIX} as fix from v""")
def validated_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are dealt by a hash of the secret: half of all have one, half of these are live."""
    rows = _line_secrets(spark, sf_dir)
    h = F.md5(F.col("secret").cast("binary"))
    digit = lambda k: F.substring(h, k, 1)
    header = F.when(digit(3) < "4", "repo, read:org").when(digit(3) < "8", "admin:org,").otherwise(" gist , user")
    answers = rows.where(digit(2) < "8").select("rule", "secret", (digit(1) < "8").alias("live"), header.alias("scope_header"))
    made = K.judged(rows, answers)
    return made.select("path", "line_no", "rule", risk.redact(F.col("secret")).alias("match"), "validated", "live", F.array_join("scopes", ",").alias("scopes"), "privileged", "real_risk", "confidence", "fix")


_SERVICE_OF = "case " + " ".join(f"when rule = {quoted(r)} then {quoted(v)}" for r, v in SERVICES.items()) + " end"
_MOVE = "case " + " ".join("when " + " or ".join(f"contains(service, {quoted(x)})" for x in parts) + f" then replace({quoted(text)}, '{{}}', service)" for parts, text in K.MOVES) + " end"


@query(f"{_LIVE}, s as (select distinct {_SERVICE_OF} as service from live) select distinct {_MOVE} as move from s where service is not null")
def lateral_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.element_at(F.array(*[F.lit(r) for r in SERVICES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return K.lateral_moves(table(spark, sf_dir, "part").select(rules.alias("rule"), (F.col("p_size") % 5 == 0).alias("live")), SERVICES)


_AWS, _AWS_SECRET = "AKIA[0-9A-Z]{16}", "[A-Za-z0-9/+]{40}"


@query(f"""with i as (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{_AWS}'))) as secret from documents where text is not null), p as (select doc_id, secret, list_filter(regexp_extract_all(text, '{_AWS_SECRET}'), lambda x: x <> secret)[1] as other from i)
select doc_id, {_REDACTED} as match, other is not null as paired, {_REDACTED.replace('secret', 'other')} as partner from p""")
def credential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_AWS), F.lit(0)))).alias("id"))
    rows = rows.select("doc_id", "id", K.partner(F.col("text"), F.col("id"), _AWS_SECRET).alias("other"))
    return rows.select("doc_id", risk.redact(F.col("id")).alias("match"), F.col("other").isNotNull().alias("paired"), risk.redact(F.col("other")).alias("partner"))


_ARN = "case p_partkey % 4 when 0 then 'arn:aws:iam::' || p_partkey || ':root' when 1 then 'arn:aws:iam::' || p_partkey || ':user/Admin' when 2 then 'arn:aws:iam::' || p_partkey || ':user/reader' else '' end"


@query(f"with a as (select p_partkey, {_ARN} as arn from part) select p_partkey, arn, case when arn = '' then '' else p_partkey::varchar end as account, ends_with(arn, ':root') or contains(lower(arn), 'admin') or contains(lower(arn), 'root') as privileged from a")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an identity service, dealt to parts."""
    key = F.col("p_partkey")
    arn = F.concat(F.lit("arn:aws:iam::"), key.cast("string"), F.when(key % 4 == 0, ":root").when(key % 4 == 1, ":user/Admin").otherwise(":user/reader"))
    body = F.when(key % 4 == 3, "<Error/>").otherwise(F.concat(F.lit("<R>\n<Arn>"), arn, F.lit("</Arn><Account>"), key.cast("string"), F.lit("</Account></R>")))
    rows = table(spark, sf_dir, "part").select("p_partkey", K.between(body, "<Arn>", "</Arn>").alias("arn"), K.between(body, "<Account>", "</Account>").alias("account"))
    return rows.withColumn("privileged", K.wide_identity(F.col("arn")))


@query(SQL["exposure_days"].split("select path, line_no, rule, greatest")[0].replace(_CODE, _ROUTES) + "select method, route, path, line_no, greatest(floor((epoch(timestamp '2000-01-01') - epoch(written)) / 86400), 0)::bigint as days from verdicts join blame using (path, line_no) where sinks > 0 and not auth")
def open_route_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 24").cast("string").alias("file"), (F.expr("o_orderkey % 24") + 1).cast("int").alias("line"), F.col("o_orderdate").alias("author_time"))
    blame = rows.select("path", F.col("line_no").alias("line"), F.regexp_extract("path", "[0-9]+", 0).alias("file")).join(dates, ["file", "line"])
    return R.open_ages(R.verdicts(R.targets(R.routes(rows), L.code_findings(rows))), blame, F.expr("timestamp '2000-01-01'"))


@query(f"{_CODE}, g as (select case when (line_no * 7 + length(path)) % 9 < 5 then 'role:Admin' when (line_no * 7 + length(path)) % 9 < 7 then 'auth' else '(none)' end as guard from code_lines where ends_with(path, '.cs')) select guard, count(*) as routes from g group by guard")
def guard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line_no") * 7 + F.length("path")
    rows = code_lines(spark, sf_dir).where(F.endswith("path", F.lit(".cs")))
    return R.guard_histogram(rows.select(F.when(k % 9 < 5, "role:Admin").when(k % 9 < 7, "auth").otherwise("").alias("guard")))


@query(f"""with d as (select p_partkey as k, ([{', '.join(map(quoted, LICENCES))}])[p_partkey % {len(LICENCES)} + 1] as s from part)
select 'py' || k as name, case k % 3 when 0 then 'Expr-' || k when 1 then s else case when s = '' then 'MIT License' else s end end as spdx, 'site/p' || k || '.dist-info/METADATA' as path from d where k % 2 = 0
union all select 'js' || k, s, 'x/node_modules/js' || k || '/package.json' from d where k % 2 = 1 and k % 7 <> 0""")
def installed_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package files dealt to parts: Python metadata with a licence, a classifier and an expression, npm manifests, some without a name."""
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    spdx = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (key % len(LICENCES) + 1).cast("int"))
    extra = F.when(key % 3 == 0, F.concat(F.lit("Classifier: License :: OSI Approved :: X\nLicense-Expression: Expr-"), text(key), F.lit("\n"))).when(key % 3 == 2, "Classifier: License :: OSI Approved :: MIT License\n").otherwise("")
    python = F.concat(F.lit("Name: py"), text(key), F.lit("\nLicense: "), spdx, F.lit("\n"), extra)
    npm = F.to_json(F.struct(F.when(key % 7 != 0, F.concat(F.lit("js"), text(key))).alias("name"), spdx.alias("license")))
    path = F.when(key % 2 == 0, F.concat(F.lit("site/p"), text(key), F.lit(".dist-info/METADATA"))).otherwise(F.concat(F.lit("x/node_modules/js"), text(key), F.lit("/package.json")))
    return P.installed_packages(table(spark, sf_dir, "part").select(path.alias("path"), F.when(key % 2 == 0, python).otherwise(npm).alias("content")))


@query("select p_partkey, not (p_partkey % 4 = 1) as proprietary from part")
def proprietary_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root manifests dealt to parts: private ones, public ones with a licence, unlicensed ones, broken ones."""
    key = F.col("p_partkey")
    manifest = F.when(key % 4 == 0, '{"private": true, "license": "MIT"}').when(key % 4 == 1, '{"license": "Apache-2.0"}').when(key % 4 == 2, '{"license": "unlicensed"}').otherwise("{broken")
    return table(spark, sf_dir, "part").select("p_partkey", P.is_proprietary(manifest).alias("proprietary"))


@query("select s_suppkey, case s_suppkey % 6 when 0 then 4 when 1 then 3 when 2 then 2 when 3 then 2 when 4 then 1 end::int as severity from supplier")
def advisory_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("critical", "HIGH", "Moderate", "MEDIUM", "low", "odd")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.advisory_severity(word).alias("severity"))


@query("select 'lib' || p_partkey as name, '1.' || p_size as version from part where p_partkey % 9 <> 0")
def apk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.concat(F.lit("C:Q1\nP:lib"), key.cast("string"), F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("\nV:1."), F.col("p_size").cast("string"))), F.lit("\nA:x86"))
    return P.apk_packages(table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("file")).agg(F.array_join(F.collect_list(text), "\n\n").alias("content")))


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'Ubuntu:2' || s_suppkey % 5 || '.04' when 1 then 'Alpine:v3.' || s_suppkey % 5 else 'Debian:1' || s_suppkey % 5 end as ecosystem from supplier")
def image_ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("s_suppkey"), (F.col("s_suppkey") % 5).cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit('ID=ubuntu\nVERSION_ID="2'), n, F.lit('.04"'))).when(key % 3 == 1, F.concat(F.lit("ID=alpine\nVERSION_ID=3."), n, F.lit(".7"))).otherwise(F.concat(F.lit('ID=debian\nVERSION_ID="1'), n, F.lit('"')))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.ecosystem(text).alias("ecosystem"))


@query("with recursive d as (select p_partkey as parent, p_partkey * 2 + p_size % 2 as child from part), r as (select distinct p_partkey as name from part where p_partkey % 50 = 1 union select child from r join d on parent = name) select 'p' || name as name from r")
def reachable_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part depends on one of twice its number; every fiftieth is imported."""
    named = lambda c: F.concat(F.lit("p"), c.cast("string"))
    rows = table(spark, sf_dir, "part")
    imports = rows.where("p_partkey % 50 = 1").select(named(F.col("p_partkey")).alias("name"))
    return P.reachable_packages(imports, rows.select(named(F.col("p_partkey")).alias("parent"), named(F.col("p_partkey") * 2 + F.col("p_size") % 2).alias("child")))
