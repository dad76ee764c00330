"""Registered queries of reports that put findings together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secret_patterns import SERVICES
from ..operators import audit as A
from ..operators import credentials as K
from ..operators import lines as L
from ..operators import narrative as S
from ..operators import ordinals as O
from ..operators import routes as R
from ..functions import risk
from ..sources.derived import code_lines, quoted
from . import history_queries  # noqa: F401  its orders are used here
from .queries import SQL, _OWASP, _PARAMS, _REDACTED, _ROUTES, query, table
from .state_queries import _ALL, _GRADE, _KNOWN, _judged, _vulnerabilities, findings

_RULE = "case p_partkey % 12 " + " ".join(f"when {i} then {quoted(r)}" for i, r in enumerate(SERVICES)) + " end"
_PROVIDER = "case " + " ".join(f"when starts_with(rule, {quoted(k)}) then {quoted(v)}" for k, v in reversed(S.PROVIDERS.items())) + " else 'a service' end"
_HELD = f"""held as (select {_RULE} as rule, p_size % 5 = 0 as live, p_size % 5 = 0 and p_partkey % 7 = 0 as privileged, case when p_partkey % 3 = 0 then 'user' || p_partkey else '' end as identity,
  case when p_partkey % 2 = 0 then ['repo', 'admin:org'] else [] end as access, case when p_partkey % 11 = 0 then 'git history @ c1' else 'src/a.py' end as path from part), named as (select *, {_PROVIDER} as provider from held)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials dealt to parts, with what validation says of them."""
    k = F.col("p_partkey")
    rule = F.element_at(F.array(*[F.lit(r) for r in SERVICES]), (k % 12 + 1).cast("int"))
    live = F.col("p_size") % 5 == 0
    access = F.when(k % 2 == 0, F.array(F.lit("repo"), F.lit("admin:org"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(F.lit("secret").alias("kind"), rule.alias("rule"), F.when(k % 11 == 0, "git history @ c1").otherwise("src/a.py").alias("path"), live.alias("live"), (live & (k % 7 == 0)).alias("privileged"), F.when(k % 3 == 0, F.concat(F.lit("user"), k.cast("string"))).otherwise("").alias("identity"), access.alias("access"), F.lit(None).cast("boolean").alias("reachable"), F.lit(3).alias("real_risk"))


@query(f"""with {_HELD}, {_KNOWN}, s as (select count_if(live) as n, count_if(privileged) as wide, coalesce(list_sort(list(distinct provider) filter (live)), []) as providers, count_if(live and contains(path, 'git history')) as gone, (select count_if(reachable and real_risk >= 3) from known_bad) as holes from named)
select 0 as part, 'A live, high-privilege ' || provider || ' (' || case when identity = '' then 'the account' else identity end || ') is exposed — an attacker gains ' || case when len(access) = 0 then 'privileged access' else array_to_string(access, ', ') end || '.' as line from named where privileged
union all select 1, {quoted(S.SEVERAL[0])} || array_to_string(providers, ', ') || {quoted(S.SEVERAL[1])} from s where len(providers) >= 2
union all select 2, {quoted(S.FOOTHOLD)} from s where n > 0 and holes > 0 union all select 3, {quoted(S.REMOVED)} from s where gone > 0
union all select 4, {quoted(S.EXPOSED)} from s where n > 0 and wide = 0 and len(providers) < 2 and not (holes > 0) and gone = 0""")
def attack_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = _held(spark, sf_dir)
    no = F.lit(False)
    bad = _vulnerabilities(spark, sf_dir).select(F.lit("vulnerability").alias("kind"), F.col("id").alias("rule"), F.lit("").alias("path"), no.alias("live"), no.alias("privileged"), F.lit("").alias("identity"), F.array().cast("array<string>").alias("access"), "reachable", "real_risk")
    return S.attack_story(secrets.unionByName(bad))


_FIRST = lambda name, test: f"{name} as (select method || ' ' || route as spot, auth from t where {test} order by rank, path, line_no, method, route, auth limit 1)"
_SERVICE = "case " + " ".join(f"when rule = {quoted(r)} then {quoted(v)}" for r, v in SERVICES.items()) + " end"


@query(f"""{_ROUTES}, {_HELD}, t as (select *, -(case when auth then 0 else 2 end + case when user_input then 1 else 0 end) as rank from targets),
{_FIRST('command', "cwe = 'CWE-78' and not auth")}, {_FIRST('code', "cwe = 'CWE-95' and not auth")}, {_FIRST('up', "cwe = 'CWE-434'")}, {_FIRST('inc', "cwe = 'CWE-22'")}, {_FIRST('pull', "cwe = 'CWE-918'")}, {_FIRST('db', "cwe = 'CWE-89' and not auth")},
alive as (select coalesce(bool_or(live), false) as any_live, coalesce(bool_or(live and contains(coalesce({_SERVICE}, ''), 'AWS')), false) as cloud from named)
select 1 as part, 'Unauthenticated RCE: ' || spot || ' reaches OS command execution with no auth — a single request runs code on the server.' as line from command
union all select 1, 'Unauthenticated code injection: ' || spot || ' evaluates attacker input with no auth gate.' from code where not exists (select 1 from command)
union all select 2, 'Upload-to-RCE: write a payload via ' || up.spot || ' (file upload), then have ' || inc.spot || ' include/read it (path traversal) — chains to code execution.' from up, inc
union all select 2, 'Unrestricted upload: ' || spot || ' accepts files with no auth — test for webshell upload into a served directory.' from up where not auth and not exists (select 1 from inc)
union all select 3, 'SSRF pivot: ' || spot || ' fetches a user URL — target the cloud metadata endpoint to mint temporary credentials.' || case when cloud then ' A live AWS key is already present, confirming this account is reachable.' else '' end from pull, alive
union all select 4, 'Unauthenticated SQLi: ' || spot || ' builds SQL from input with no auth — likely full read of the database.' from db
union all select 5, 'A live credential was found alongside reachable code sinks — foothold and post-exploitation are both in hand.' from alive where any_live and exists (select 1 from t where cwe is not null)""")
def attack_chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    targets = R.targets(R.routes(rows), L.code_findings(rows)).withColumn("rank", -R.surface_points(F.col("auth"), F.col("user_input")))
    service = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in SERVICES.items()])
    return S.chain_lines(targets, _held(spark, sf_dir).select(service.alias("service"), "live"))


@query(f"{_ROUTES}, s as (select distinct path, line_no, method, route, framework, sink_line, cwe, {_OWASP} as owasp from targets where cwe is not null) select owasp, count(*) as sinks from s where owasp <> '' group by owasp")
def owasp_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return S.owasp_by_target(R.targets(R.routes(rows), L.code_findings(rows)))


@query(f"{_ALL} select path, line_no, rule, kind from findings where kind in ('code', 'secret')")
def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of_sources(findings(spark, sf_dir), ["code", "secret"]).select("path", "line_no", "rule", "kind")


@query(SQL["surface_in_order"].replace("from routes)", "from routes where not auth)"))
def open_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["path", "line_no", "method", "route", "framework"]
    found = S.open_only(R.routes(code_lines(spark, sf_dir))).withColumn("points", R.surface_points(F.col("auth"), F.col("user_input")))
    return O.placed(found.select(*order, "points"), F.desc("points"), *map(F.col, order))


@query(f"""{_ALL}, base as (select distinct fingerprint from findings where line_no % 5 = 0), k as (select * from findings where fingerprint not in (select fingerprint from base))
select (select count(*) from k)::bigint as kept, ((select count(*) from findings) - (select count(*) from k))::bigint as suppressed, (select coalesce(max(real_risk), 0) from k)::int as highest, (select coalesce(max(real_risk), 0) from k) >= 3 as failed""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run against a baseline says: findings kept and suppressed, the highest risk, and whether it fails."""
    rows = findings(spark, sf_dir)
    _, numbers = S.gated(rows, rows.where("line_no % 5 = 0"), "HIGH")
    return spark.createDataFrame([(numbers["kept"], numbers["suppressed"], numbers["highest"], numbers["failed"])], "kept long, suppressed long, highest int, failed boolean")


_JSON_PATH = "array_to_string(list_transform(string_split(string_split(case when starts_with(route, '/') then route else '/' || route end, '#')[1], '/'), lambda s: case when starts_with(s, ':') then '{' || substr(s, 2) || '}' else s end), '/')"


@query(f"""{_ROUTES}, pp as ({_PARAMS}), names as (select coalesce(list_sort(list(distinct param) filter (param <> '')), []) as names from pp),
m as (select distinct {_JSON_PATH} as path, case when lower(method) in ('any', 'query', 'mutation') then 'get' else lower(method) end as method from routes),
q as (select path, method, list_concat(list_transform(list_sort(list_distinct(regexp_extract_all(path, '[:{{](\\w+)}}?', 1))), lambda n: '{{"name":' || to_json(n)::varchar || ',"in":"path","required":true,"schema":{{"type":"string"}}}}'), list_transform(names, lambda n: '{{"name":' || to_json(n)::varchar || ',"in":"query","required":false,"schema":{{"type":"string"}}}}')) as ps from m, names),
op as (select path, to_json(method)::varchar || ':{{"summary":"discovered by riskloom","responses":{{"200":{{"description":"ok"}}}}' || case when len(ps) > 0 then ',"parameters":[' || array_to_string(ps, ',') || ']' else '' end || '}}' as op, method from q),
it as (select path as ord, to_json(path)::varchar || ':{{' || string_agg(op, ',' order by method) || '}}' as item from op group by path), st as (select min(ord) as first from it)
select 1 as part, ord, case when ord = first then item else ',' || item end as line from it, st union all select 0, '', '{{"openapi":"3.0.3","info":{{"title":"riskloom — discovered attack surface","version":"1.0.0"}},"servers":[{{"url":"https://TARGET"}}],"paths":{{' union all select 2, '', '}}}}'""")
def openapi_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return S.openapi_document(R.routes(rows), R.parameters(rows).where("param <> ''"))


_POSTURE = "case left(grade, 1) " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in S.POSTURES.items()) + " end"


@query(SQL["audit_grade"].replace(f"select *, {_GRADE} as grade from s", f", g as (select score, {_GRADE} as grade from s) select score, grade, {_POSTURE} as verdict from g"))
def posture_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = A.audit(*_judged(spark, sf_dir))
    return audited.select("score", "grade", S.posture(F.col("grade")).alias("verdict"))


# A text a part: an account id, with a token beside it or only the id's own digits; a key id, with a secret beside it or without.
_PAIR_TEXT = "case p_partkey % 4 when 0 then 'sid=AC' || md5(p_partkey::varchar) || ' token ' || md5('t' || p_partkey) when 1 then 'sid=AC' || md5(p_partkey::varchar) || ' again ' || md5(p_partkey::varchar) when 2 then 'AKIA' || upper(left(md5(p_partkey::varchar), 16)) || ' ' || md5('s' || p_partkey) || 'ABCD/+12' else 'AKIA' || upper(left(md5(p_partkey::varchar), 16)) end"


@query(f"""with t as (select p_partkey, {_PAIR_TEXT} as text from part), i as (select p_partkey, text, rule, unnest(list_distinct(ids)) as secret from (
  select p_partkey, text, 'twilio-account-sid' as rule, regexp_extract_all(text, 'AC[0-9a-fA-F]{{32}}') as ids from t union all select p_partkey, text, 'aws-access-key', regexp_extract_all(text, '(?:AKIA|ASIA)[A-Z0-9]{{16}}') from t)),
p as (select *, case when rule like 'twilio%' then list_filter(regexp_extract_all(text, '[0-9a-fA-F]{{32}}'), lambda x: x <> substr(secret, 3))[1] else list_filter(regexp_extract_all(text, '[A-Za-z0-9/+]{{40}}'), lambda x: x <> secret)[1] end as other from i)
select p_partkey, rule, {_REDACTED} as match, other is not null as paired, {_REDACTED.replace('secret', 'other')} as partner from p""")
def credential_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that can be tried only with a partner, and the partner found in the same text."""
    k, hashed = F.col("p_partkey").cast("string"), lambda *parts: F.md5(F.concat(*parts).cast("binary"))
    key = F.concat(F.lit("AKIA"), F.upper(F.left(hashed(k), F.lit(16))))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("sid=AC"), hashed(k), F.lit(" token "), hashed(F.lit("t"), k))).when(kind == 1, F.concat(F.lit("sid=AC"), hashed(k), F.lit(" again "), hashed(k))).when(kind == 2, F.concat(key, F.lit(" "), hashed(F.lit("s"), k), F.lit("ABCD/+12"))).otherwise(key)
    rows = K.paired(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    return rows.select("p_partkey", "rule", risk.redact(F.col("id")).alias("match"), F.col("partner").isNotNull().alias("paired"), risk.redact(F.col("partner")).alias("partner"))
