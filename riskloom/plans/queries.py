"""Registered queries over the driver's tables, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.code_patterns import CODE_RULES, ENDINGS, GLOBAL_ANTIFORGERY, LOOKUP, OWNERSHIP, PATCHES
from ..functions.config_patterns import CONFIG_RULES, KIND_NAMES, SAFE_ASSIGNMENT
from ..functions.route_patterns import GRAPHQL_FIELD, GRAPHQL_TYPE, GUARD, ID_LIKE, INTERNAL_HOST, OPENAPI_MARK, OPENAPI_METHOD, OPENAPI_PATH, OWNED, PARAMETERS, PATH_PARAM, PRIVATE_IP, RATE_LIMIT, RESOURCES, ROUTE_INPUT, ROUTE_RULES, SENSITIVE
from ..functions.secret_patterns import ASSIGNMENT, HINTS, LEAST_ENTROPY, PLACEHOLDER, SECRET_RULES
from ..operators import lines as L
from ..operators import routes as R
from ..operators import specs as S
from ..sources.derived import CODE_LINES_SQL, code_lines, quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL parts -----------------------------------------------------------------------------------------------------------


def _any_part(column: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(p)})" for p in parts) + ")"


_LANG = "case " + " ".join(f"when regexp_extract(path, '\\.[A-Za-z0-9]+$') in ({', '.join(map(quoted, ends))}) then {quoted(name)}" for name, ends in ENDINGS.items()) + " end"
_LEFT = "regexp_replace(line, '^[ \\t]+', '')"
_COMMENT = f"""case when lang in ('py', 'ruby') then starts_with({_LEFT}, '#')
  when lang = 'php' then starts_with({_LEFT}, '//') or starts_with({_LEFT}, '#') or starts_with({_LEFT}, '/*') or starts_with({_LEFT}, '*')
  else starts_with({_LEFT}, '//') or starts_with({_LEFT}, '/*') or starts_with({_LEFT}, '*') end"""
_cut = lambda s: f"case when strlen({s}) > 100 then left({s}, 99) || '…' else {s} end"
_SNIPPET, _TRIMMED = _cut(_LEFT), _cut("trim(line)")
_LEVEL = {name: k for k, name in enumerate(risk.SEVERITIES)}
_OWASP = "case " + " ".join(f"when cwe in ({', '.join(map(quoted, ids))}) then {quoted(label)}" for label, ids in risk.OWASP.items()) + " else '' end"
_TEST = f"({_any_part('low_path', risk.TEST_PARTS)} or ends_with(low_path, 'tests.cs') or ends_with(low_path, 'test.cs'))"
_CODE_ROWS = "\nunion all ".join(f"select path, line_no, {quoted(r[0])} as rule, {_LEVEL[r[1]]} as severity, {quoted(r[2])} as cwe, snippet from plain where lang in ({', '.join(map(quoted, r[3].split()))}) and regexp_matches(line, {quoted(r[4])})" for r in CODE_RULES)
_CODE = f"""with {CODE_LINES_SQL},
spoken as materialized (select path, line_no, line, {_LANG} as lang from code_lines),
plain as materialized (select *, {_SNIPPET} as snippet from spoken where lang is not null and strlen(line) <= 1000 and not ({_COMMENT})),
near as (select *, max(case when regexp_matches(line, {quoted(OWNERSHIP)}) then 1 else 0 end) over (partition by path order by line_no range between 8 preceding and 8 following) as owned from spoken where lang is not null),
code_findings as materialized (
  select * from ({_CODE_ROWS}) where rule <> 'cs-csrf-disabled' or exists (select 1 from spoken where lang = 'cs' and contains(line, {quoted(GLOBAL_ANTIFORGERY)}))
  union all
  select n.path, n.line_no, 'idor', 3, 'CWE-639', p.snippet from near n join plain p on n.path = p.path and n.line_no = p.line_no where owned = 0 and regexp_matches(n.line, {quoted(LOOKUP)}))
"""


@query(f"{_CODE} select path, line_no, rule, severity, cwe, snippet, {_OWASP} as owasp, case when {_TEST} then 0 else 1 end as confidence from (select *, '/' || lower(path) as low_path from code_findings)")
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    found = L.code_findings(code_lines(spark, sf_dir))
    sure = risk.confidence(F.lit("code"), F.col("rule"), F.col("path"), no, no, no, no, F.lit(None).cast("boolean"))
    return found.withColumns({"owasp": risk.owasp(F.col("cwe")), "confidence": sure})


@query(f"{_CODE} select {_OWASP} as owasp, count(*) as sinks, count(distinct path) as files from (select distinct path, line_no, cwe from code_findings) group by 1")
def owasp_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.code_findings(code_lines(spark, sf_dir)).select("path", "line_no", "cwe").distinct()
    return found.groupBy(risk.owasp(F.col("cwe")).alias("owasp")).agg(F.count("*").alias("sinks"), F.countDistinct("path").alias("files"))


_PATCH = "coalesce(" + ", ".join(f"case when rule = {quoted(r)} and regexp_matches(line, {quoted(p)}) then regexp_replace(line, {quoted(p)}, {quoted(to)}, 'g') end" for r, p, to in PATCHES) + ")"


@query(f"{_CODE}, p as (select path, line_no, rule, line, {_PATCH} as patched from code_findings join code_lines using (path, line_no)) select path, line_no, rule, patched from p where patched <> line")
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return L.patches(rows, L.code_findings(rows))


_CHARS = "list_filter(string_split(secret, ''), lambda c: c <> '')"
_ENTROPY = f"list_sum(list_transform(list_distinct({_CHARS}), lambda c: -(len(list_filter({_CHARS}, lambda d: d = c))::double / len({_CHARS})) * log2(len(list_filter({_CHARS}, lambda d: d = c))::double / len({_CHARS}))))"
def _found_sql(rule: str, level: int, pattern: str, group: int) -> str:
    """Matches in whole texts with their line: the line feeds of all pieces and matches before."""
    p = quoted(pattern)
    lead = "regexp_extract(m[k], '^[\\t\\n\\f\\r ]*')" if not group else "m[k]"
    return f"""select key, {quoted(rule)} as rule, {level} as severity, v[k] as secret, coalesce(numbers[feeds + 1], feeds + 1)::int as line_no from (select *, len(string_split(array_to_string(s[1:k], '') || array_to_string(m[1:k - 1], '') || {lead}, chr(10))) - 1 as feeds from (
  select key, numbers, m, s, v, unnest(range(1, len(m) + 1)) as k from (select key, numbers, regexp_extract_all(text, {p}, 0) as m, regexp_extract_all(text, {p}, {group}) as v, regexp_split_to_array(text, {p}) as s from texts where regexp_matches(text, {p}))))"""


_TYPED = "\nunion all ".join(_found_sql(r[0], _LEVEL[r[2]], r[3], 0) for r in SECRET_RULES)
#: Over texts(key, text, numbers); numbers are the line numbers of a text's lines, or null for 1, 2, 3.
_SECRETS = f"""typed as ({_TYPED}),
likely as ({_found_sql('generic-high-entropy', 2, ASSIGNMENT, 2)}),
secrets as (select *, regexp_matches(secret, {quoted(PLACEHOLDER)}) or (strlen(secret) >= 6 and replace(secret, left(secret, 1), '') = '') as placeholder from (
  select * from typed union all select * from likely where strlen(secret) >= 12 and not {_any_part('lower(secret)', HINTS)} and {_ENTROPY} >= {LEAST_ENTROPY}
    and not ({" or ".join(f"regexp_matches(secret, {quoted(r[3])})" for r in SECRET_RULES)})))
"""
_REDACTED = "case when strlen(trim(secret)) <= 8 then repeat('*', strlen(trim(secret))::int) else left(trim(secret), 4) || '******' || right(trim(secret), 2) end"
_SECRET_ALL = f"""select key, line_no, rule, {_REDACTED} as match, severity, case when placeholder then 0 else severity end as real_risk,
  case when placeholder then 0 when rule = 'generic-high-entropy' then 0 else 1 end as confidence,
  left(sha256(rule || chr(0) || key || chr(0) || line_no || chr(0) || {_REDACTED}), 16) as fingerprint from secrets"""
_SECRET_OUT = _SECRET_ALL.replace("as match, severity,", "as match,")
_CODE_TEXTS = "texts as (select path as key, string_agg(line, chr(10) order by line_no) as text, list(line_no order by line_no) as numbers from code_lines group by path)"


def placed_secrets(texts: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity, secret, placeholder) of whole texts(path, text, numbers); without numbers lines count from 1."""
    own = F.struct("path", *(["numbers"] if "numbers" in texts.columns else []))
    found = L.secrets(texts.select(own.alias("key"), "text"))
    line = F.col("feeds") + 1
    line = F.coalesce(F.try_element_at("key.numbers", line.cast("int")), line) if "numbers" in texts.columns else line
    return found.select("key.path", line.cast("int").alias("line_no"), "rule", "severity", "secret", "placeholder")


def _secret_rows(texts: DataFrame) -> DataFrame:
    """Secrets of texts with their place and the redacted match."""
    no, unknown = F.lit(False), F.lit(None).cast("boolean")
    found = placed_secrets(texts).withColumn("match", risk.redact(F.col("secret")))
    real = risk.real_risk(F.lit("secret"), F.col("severity"), F.col("placeholder"), no, no, unknown)
    sure = risk.confidence(F.lit("secret"), F.col("rule"), F.lit(""), F.col("placeholder"), no, no, no, unknown)
    mark = risk.fingerprint(F.col("rule"), F.col("path"), F.col("line_no"), F.col("match"))
    return found.select(F.col("path").alias("key"), "line_no", "rule", "match", "severity", real.alias("real_risk"), sure.alias("confidence"), mark.alias("fingerprint"))


@query(f"with texts as (select doc_id::varchar as key, text, null::int[] as numbers from documents where text is not null), {_SECRETS} {_SECRET_OUT}")
def secrets_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    return _secret_rows(rows).drop("severity")


@query(f"with {CODE_LINES_SQL}, {_CODE_TEXTS}, {_SECRETS} {_SECRET_OUT}")
def secrets_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secret_rows(L.whole_texts(code_lines(spark, sf_dir))).drop("severity")


_BASE, _DIR = "regexp_extract(path, '[^/]*$')", "regexp_extract(path, '^(.*)/', 1)"
_CONFIG_ROWS = "\nunion all ".join(f"select path, line_no, {quoted(r[0])} as rule, {_LEVEL[r[1]]} as severity, kind, line from kind_lines where kind = {quoted(r[2])} and regexp_matches(line, {quoted(r[3])})" for r in CONFIG_RULES)
_CONFIG = f"""with {CODE_LINES_SQL},
files as (select path, bool_or(starts_with(trim(line), 'apiVersion:')) and bool_or(starts_with(trim(line), 'kind:')) as kube from code_lines group by path),
kinds_of as (select path, case when {_BASE} = 'Dockerfile' or starts_with({_BASE}, 'Dockerfile.') or ends_with({_BASE}, '.Dockerfile') then 'dockerfile'
  when {_BASE} in ('docker-compose.yml', 'docker-compose.yaml', 'compose.yml', 'compose.yaml') then 'compose'
  when contains({_DIR}, '.github/workflows') and (ends_with(path, '.yml') or ends_with(path, '.yaml')) then 'gha'
  when ends_with(path, '.tf') then 'terraform' when (ends_with(path, '.yml') or ends_with(path, '.yaml')) and kube then 'k8s' end as kind from files),
kind_lines as materialized (select path, line_no, line, kind from code_lines join kinds_of using (path) where kind is not null),
config_findings as (select path, line_no, rule, severity, kind, {_TRIMMED} as snippet from ({_CONFIG_ROWS}) where not (rule = 'gha-script-injection' and regexp_matches(line, {quoted(SAFE_ASSIGNMENT)}) and lower(regexp_extract(line, {quoted(SAFE_ASSIGNMENT)}, 1)) <> 'run'))
"""


_KIND = "case kind " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in KIND_NAMES.items()) + " else kind end"


@query(f"{_CONFIG} select *, {_KIND} as label from config_findings")
def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.config_findings(code_lines(spark, sf_dir)).withColumn("label", L.kind_label(F.col("kind")))


def _route_sql() -> str:
    parts = []
    for name, lang, p, method, at, around in ROUTE_RULES:
        m = f"upper(regexp_extract(line, {quoted(p)}, {method}))" if method else "'GET'"
        guard = "guard_near" if around else "guard"
        parts.append(f"select case when {m} in ('ROUTE', 'HANDLE', 'ALL', 'ANY') then 'ANY' else {m} end as method, regexp_extract(line, {quoted(p)}, {at}) as route, {quoted(name)} as framework, path, line_no, {guard} as auth, line from guarded where lang = {quoted(lang)} and regexp_matches(line, {quoted(p)})")
    return "\nunion all ".join(parts)


_ROUTES = f"""{_CODE},
flagged as (select *, regexp_matches(line, {quoted(GUARD)}) as guard from spoken where lang is not null),
guarded as (select *, bool_or(guard) over (partition by path order by line_no range between 2 preceding and 2 following) as guard_near from flagged),
matched as materialized ({_route_sql()}),
routes as materialized (select method, route, framework, path, line_no, auth, regexp_matches(line, {quoted(ROUTE_INPUT)}) as user_input, regexp_matches(line, {quoted(RATE_LIMIT)}) as rate_limited from matched where route <> ''
  union all select m.method, '/' || regexp_extract(line, {quoted(RESOURCES)}, 1) || m.tail, 'Rails (resources)', path, line_no, false, false, false
  from spoken, (values ('GET', ''), ('POST', ''), ('GET', '/:id'), ('PUT', '/:id'), ('DELETE', '/:id')) m(method, tail) where lang = 'ruby' and regexp_matches(line, {quoted(RESOURCES)})),
spans as (select *, coalesce(min(line_no) over (partition by path order by line_no range between 1 following and 119 following), line_no + 120)::int as span_end from routes),
targets as (select s.*, f.line_no as sink_line, f.rule as sink_rule, f.cwe from spans s left join code_findings f on s.path = f.path and f.line_no >= s.line_no and f.line_no < s.span_end),
judged as (select method, route, framework, path, line_no, auth, user_input, rate_limited, count(sink_rule) as sinks, coalesce(bool_or(sink_rule = 'idor'), false) as no_ownership from targets group by all),
verdicts as materialized (select *, case when not auth and sinks > 0 and user_input then 'EXTERNAL-CRITICAL' when not auth and sinks > 0 then 'EXTERNAL-HIGH' when sinks > 0 and user_input then 'AUTHED-HIGH' when not auth then 'EXPOSED' else '' end as verdict,
  (case when sinks > 0 then 4 else 0 end + case when not auth then 2 else 0 end + case when user_input then 1 else 0 end) as score from judged)
"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.routes(code_lines(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return R.verdicts(R.targets(R.routes(rows), L.code_findings(rows)))


@query(f"{_ROUTES} select * from routes")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)


@query(f"{_ROUTES} select method, route, path, line_no, span_end, sink_line, sink_rule from targets")
def route_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return R.targets(R.routes(rows), L.code_findings(rows)).select("method", "route", "path", "line_no", "span_end", "sink_line", "sink_rule")


@query(f"{_ROUTES} select * from verdicts")
def route_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"""{_ROUTES}, seg as (select *, regexp_extract(route, '^/*([^/]*)', 1) as segment from routes),
w as (select *, bool_or(auth) over (partition by segment) as closed from seg where segment <> '' and not regexp_matches(segment, '^[:{{<]')) select * exclude (closed) from w where closed and not auth""")
def auth_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.auth_anomalies(_routes(spark, sf_dir))


@query(f"{_ROUTES} select * from routes where not rate_limited and regexp_matches(route, {quoted(SENSITIVE)})")
def brute_forceable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.brute_forceable(_routes(spark, sf_dir))


@query(f"""{_ROUTES}, s as (select * from routes where regexp_matches(route, {quoted(SENSITIVE)})), n as (select count(*) as n, count_if(rate_limited) as limited from s)
select s.*, limited from s, n where n >= 3 and limited > 0 and limited < n and not rate_limited""")
def rate_limit_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rate_limit_deviations(_routes(spark, sf_dir))


@query(f"""{_ROUTES}, p as (select *, list_filter(list_transform(regexp_extract_all(route, {quoted(PATH_PARAM)}), lambda m: regexp_extract(m, '^[:{{]([^:?}}]*)', 1)), lambda x: x <> '') as params from verdicts)
select method, route, path, line_no, framework, (case when upper(method) in ('POST', 'PUT', 'PATCH', 'DELETE') then 2 else 0 end + case when no_ownership then 3 else 0 end + case when not auth then 2 else 0 end
  + case when len(list_filter(params, lambda x: regexp_matches(x, {quoted(ID_LIKE)}))) > 0 then 1 else 0 end + case when regexp_matches(route, {quoted(OWNED)}) then 1 else 0 end) as points from p where len(params) > 0""")
def object_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.object_candidates(_verdicts(spark, sf_dir)).select("method", "route", "path", "line_no", "framework", "points")


@query(f"{_ROUTES} select * from routes where not auth and upper(method) in ('POST', 'PUT', 'PATCH', 'DELETE') and regexp_matches(route, {quoted(OWNED)})")
def open_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.open_changes(_routes(spark, sf_dir))


_PARAMS = " union all ".join(f"select unnest(regexp_extract_all(line, {quoted(p)}, 1)) as param from code_lines" for p in PARAMETERS)


@query(f"with {CODE_LINES_SQL}, h as (select unnest(regexp_extract_all(line, {quoted(PRIVATE_IP)})) as host from code_lines union all select lower(unnest(regexp_extract_all(line, {quoted(INTERNAL_HOST)}))) from code_lines) select distinct host from h")
def internal_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hosts(code_lines(spark, sf_dir))


@query(f"with {CODE_LINES_SQL}, p as ({_PARAMS}) select distinct param from p where param <> ''")
def request_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parameters(code_lines(spark, sf_dir))


@query(f"{_ROUTES}, p as ({_PARAMS}), w as (select regexp_replace(route, '^/', '') as word, 0 as part from routes union all select param, 1 from p) select word, min(part) as part from w where word <> '' group by word")
def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir)
    return R.wordlist(R.routes(rows), R.parameters(rows))


_SO_FAR = "over (partition by path order by line_no rows between unbounded preceding and current row)"


@query(f"""with {CODE_LINES_SQL}, t as (select *, regexp_matches(line, {quoted(GRAPHQL_TYPE)}) as opens from code_lines where ends_with(path, '.graphql') or ends_with(path, '.gql')),
p as (select *, count_if(opens) {_SO_FAR} as part, last_value(case when opens then upper(regexp_extract(line, {quoted(GRAPHQL_TYPE)}, 1)) end ignore nulls) {_SO_FAR} as op from t),
d as (select *, sum(length(replace(line, '}}', '')) - length(replace(line, '{{', ''))) over (partition by path, part order by line_no rows between unbounded preceding and current row) as depth from p where part > 0 and not opens),
c as (select *, count_if(contains(line, '}}') and depth <= 0) over (partition by path, part order by line_no rows between unbounded preceding and current row) as closed from d)
select op as method, '/graphql#' || regexp_extract(line, {quoted(GRAPHQL_FIELD)}, 1) as route, path, line_no from c where closed = 0 and regexp_matches(line, {quoted(GRAPHQL_FIELD)}) and regexp_extract(line, {quoted(GRAPHQL_FIELD)}, 1) <> 'type'""")
def graphql_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.graphql_routes(code_lines(spark, sf_dir))


@query(f"""with {CODE_LINES_SQL}, f as (select * from code_lines where regexp_extract(path, '\\.[A-Za-z0-9]+$') in ('.yaml', '.yml', '.json')),
m as (select distinct path from f where line_no <= 31 and regexp_matches(line, {quoted(OPENAPI_MARK)})),
r as (select *, regexp_matches(line, {quoted(OPENAPI_PATH)}) as is_path, last_value(case when regexp_matches(line, {quoted(OPENAPI_PATH)}) then regexp_extract(line, {quoted(OPENAPI_PATH)}, 1) end ignore nulls) {_SO_FAR} as route from f where path in (select path from m))
select upper(regexp_extract(line, {quoted(OPENAPI_METHOD)}, 1)) as method, route, path, line_no from r where not is_path and route is not null and regexp_matches(line, {quoted(OPENAPI_METHOD)})""")
def openapi_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.openapi_routes(code_lines(spark, sf_dir))
