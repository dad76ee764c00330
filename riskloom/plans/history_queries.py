"""Registered queries over histories and diffs, and those that put rows in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import risk
from ..operators import compare as C
from ..operators import history as H
from ..operators import lines as L
from ..operators import ordinals as O
from ..operators import routes as R
from ..sources.derived import code_lines
from .queries import SQL, _REDACTED, _ROUTES, _SECRETS, _verdicts, query, table
from .state_queries import guard_histogram as _guards

# A repository a customer, a commit an order: parents are the order before and, for every fifth, the third before. Dates are the orders', so clocks
# run back. Trees have a folder that commits share, with a folder in it that folders share; a blob stands at several paths.
_COMMITS = """commits as materialized (select o_custkey as repo, 'c' || o_orderkey as commit, o_orderkey as k, 'r' || o_orderkey as tree, 'dev' || o_orderkey % 7 as author, o_orderdate as author_time, epoch(o_orderdate)::bigint as at,
  lag('c' || o_orderkey, 1) over w as p1, case when o_orderkey % 5 = 0 then lag('c' || o_orderkey, 3) over w end as p2 from orders window w as (partition by o_custkey order by o_orderkey)),
links as materialized (select repo, commit, p1 as parent from commits where p1 is not null union select repo, commit, p2 from commits where p2 is not null)"""
_TREES = """trees as materialized (select repo, tree, unnest(['app.js', 'conf', 'old.js']) as name, unnest(['blob', 'tree', 'blob']) as kind, unnest(['b' || k % 97, 's' || k % 40, 'b' || (k // 7) % 97]) as object from commits
  union select repo, 's' || k % 40, unnest(['.env', 'deep']), unnest(['blob', 'tree']), unnest(['e' || k % 40, 'd' || k % 40 % 5]) from commits union select repo, 'd' || k % 40 % 5, 'x.py', 'blob', 'b' || k % 40 % 5 * 3 from commits)"""
_CLOSURE = f"""with recursive {_COMMITS}, {_TREES},
anc as (select repo, commit, commit as a, 0::bigint as d from commits union select anc.repo, anc.commit, l.parent, d + 1 from anc join links l on l.repo = anc.repo and l.commit = anc.a),
places as materialized (select x.repo, x.commit, max(c.at + d) as place from anc x join commits c on c.repo = x.repo and c.commit = x.a group by 1, 2),
flat as (select repo, tree as root, name as path, kind, object from trees where tree like 'r%' union all select f.repo, f.root, f.path || '/' || t.name, t.kind, t.object from flat f join trees t on t.repo = f.repo and t.tree = f.object where f.kind = 'tree'),
files as materialized (select c.repo, c.commit, f.path, f.object as blob from commits c join flat f on f.repo = c.repo and f.root = c.tree where kind = 'blob')"""
_BLOB_COMMITS = f"""{_CLOSURE}, pc as (select c.repo, c.commit, parent from commits c left join links using (repo, commit)),
x as (select pc.repo, pc.commit, coalesce(pc.parent, '') as pk, path, blob as after from pc join files f on f.repo = pc.repo and f.commit = pc.commit), y as (select pc.repo, pc.commit, pc.parent as pk, path, blob as before from pc join files f on f.repo = pc.repo and f.commit = pc.parent),
made as (select * from x full join y using (repo, commit, pk, path) where after is distinct from before), np as (select repo, commit, count(*) as n_parents from pc group by 1, 2),
own as (select repo, commit, path, max(after) as after, list(distinct before) filter (before is not null) as gone from made join np using (repo, commit) group by repo, commit, path, n_parents having count(*) >= n_parents),
touched as (select repo, commit, path, after, unnest(list_distinct(list_concat(coalesce(gone, []), case when after is null then [] else [after] end))) as blob from own),
placed as (select *, blob is not distinct from after as brings from touched join places using (repo, commit)),
firsts as (select repo, blob, commit as first_commit, path as first_path from placed where brings qualify row_number() over (partition by repo, blob order by place, commit, path) = 1),
lasts as (select repo, blob, commit as last_commit from placed qualify row_number() over (partition by repo, blob order by place desc, commit desc, path desc) = 1),
many as (select repo, blob, count(distinct path) filter (brings) as paths from placed group by 1, 2),
blob_commits as materialized (select repo, blob, first_commit, first_path, author as first_author, author_time as first_time, last_commit, paths from lasts join firsts using (repo, blob) join many using (repo, blob) join commits c using (repo) where c.commit = first_commit)"""

#: Texts that a task searches for secrets.
TEXTS_A_TASK = 20000


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, own = F.col("o_orderkey").cast("string"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    commit = F.concat(F.lit("c"), key)
    parents = F.array_compact(F.array(F.lag(commit, 1).over(own), F.when(F.col("o_orderkey") % 5 == 0, F.lag(commit, 3).over(own))))
    rows = table(spark, sf_dir, "orders").withColumns({"commit": commit, "parents": parents})
    return rows.select(F.col("o_custkey").alias("repo"), "commit", F.col("o_orderkey").alias("k"), "parents", F.concat(F.lit("r"), key).alias("tree"), F.concat(F.lit("dev"), (F.col("o_orderkey") % 7).cast("string")).alias("author"), F.col("o_orderdate").alias("author_time"))


def _trees(commits: DataFrame) -> DataFrame:
    """Entries of trees; those of folders once for each commit that has them."""
    named = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    entry = lambda tree, name, kind, thing: F.struct(tree.alias("tree"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), thing.alias("object"))
    k = F.col("k")
    folder, deep = k % 40, k % 40 % 5
    rows = F.array(
        entry(F.col("tree"), "app.js", "blob", named("b", k % 97)), entry(F.col("tree"), "conf", "tree", named("s", folder)), entry(F.col("tree"), "old.js", "blob", named("b", F.expr("k div 7") % 97)),
        entry(named("s", folder), ".env", "blob", named("e", folder)), entry(named("s", folder), "deep", "tree", named("d", deep)), entry(named("d", deep), "x.py", "blob", named("b", deep * 3)),
    )
    return commits.select("repo", F.inline(rows))


def _blobs(trees: DataFrame) -> DataFrame:
    """Contents by repository and object: keys in .env files, values on the line after their name, some binary, some over the size."""
    rows = checkpointed(trees.where("kind = 'blob'").select("repo", F.col("object").alias("blob"), "object").distinct())
    rows = rows.repartition(max(trees.sparkSession.sparkContext.defaultParallelism, rows.count() // TEXTS_A_TASK))  # few bytes, but each becomes a text to search
    hashed = lambda *parts: F.md5(F.concat(*parts).cast("binary"))
    repo, n = F.concat(F.col("repo").cast("string"), F.lit("/")), F.substring("object", 2, 9).cast("int")
    own = hashed(repo, F.col("object"))
    env = F.concat(F.lit("TOKEN=ghp_"), own, F.lit("abcd\nMAIL=key-"), hashed(F.col("object")), F.lit("\n"))
    code = F.concat(F.when(n % 11 == 0, "\0").otherwise(""), F.lit("const a = 1;\nlet apiToken =\n  '"), own, F.lit("';\n// was ghp_"), hashed(repo, F.lit("e"), (n % 40).cast("string")), F.lit("abcd\n"))
    content = F.when(F.startswith("object", F.lit("e")), env).otherwise(code)
    return rows.select("repo", "blob", F.when(n % 13 == 12, 3 << 20).otherwise(F.length(content)).alias("size"), content.alias("content"))


@query(f"{_CLOSURE} select repo, commit, place from places")
def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ordered(_commits(spark, sf_dir))


@query(f"{_BLOB_COMMITS} select * from blob_commits")
def blob_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = checkpointed(_commits(spark, sf_dir))
    return H.blob_commits(commits, _trees(commits))


_BLOBS = """raw as (select distinct repo, object as blob, substr(object, 2)::int as n, md5(repo || '/' || object) as own, md5(object) as shared from trees where kind = 'blob'),
sized as (select repo, blob, n, case when blob like 'e%' then 'TOKEN=ghp_' || own || 'abcd' || chr(10) || 'MAIL=key-' || shared || chr(10)
  else case when n % 11 = 0 then chr(0) else '' end || 'const a = 1;' || chr(10) || 'let apiToken =' || chr(10) || '  ''' || own || ''';' || chr(10) || '// was ghp_' || md5(repo || '/e' || n % 40) || 'abcd' || chr(10) end as content from raw),
blobs as materialized (select repo, blob, content from sized where n % 13 <> 12 and not contains(content, chr(0)))"""


@query(f"""{_BLOB_COMMITS}, {_BLOBS}, texts as (select repo || '|' || blob as key, content as text, null::int[] as numbers from blobs), {_SECRETS},
own_secrets as materialized (select string_split(key, '|')[1]::bigint as repo, string_split(key, '|')[2] as blob, rule, severity, secret from secrets),
first_of as (select * from own_secrets qualify row_number() over (partition by repo, secret order by blob, rule, severity) = 1),
newest as (select repo, commit from places qualify row_number() over (partition by repo order by place desc, commit desc) = 1),
head as materialized (select distinct f.repo, content from newest n join files f using (repo, commit) join blobs b on b.repo = f.repo and b.blob = f.blob)
select f.repo, rule, severity, f.blob, first_commit, {_REDACTED} as match, coalesce('git history @ ' || first_commit || ' (' || first_author || ', ' || strftime(first_time, '%Y-%m-%d') || ')', 'git history') as place
from first_of f left join blob_commits b on b.repo = f.repo and b.blob = f.blob where not exists (select 1 from head h where h.repo = f.repo and contains(h.content, f.secret))""")
def history_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = checkpointed(_commits(spark, sf_dir))
    trees = _trees(commits)
    blobs = _blobs(trees)
    found = L.secrets(H.readable(blobs).select(F.struct("repo", "blob").alias("key"), F.col("content").alias("text"))).select("key.repo", "key.blob", "rule", "severity", "secret")
    return H.leaks(found, blobs, commits, trees).select("repo", "rule", "severity", "blob", "first_commit", risk.redact(F.col("secret")).alias("match"), "place")


# A diff, a line an order: headers, hunks, added and removed lines, and added lines that look like headers.
_DIFF = """diff as (select k as ord, case when k % 40 = 1 then '+++ b/src/f' || k // 40 || '.py' when k % 40 = 2 or k % 13 = 0 then '@@ -' || k % 300 || ' +' || k % 500 + 1 || ',3 @@ def'
  when k % 29 = 0 then '+++ not a header' when k % 3 = 0 then '-gone' else '+new' end as text from (select o_orderkey as k from orders))"""


@query(f"""with {_DIFF}, untracked as (select 'new/' || p_partkey as path from part where p_size = 7),
r as (select *, text like '+%' and text not like '+++%' as added from diff), n as (select *, count_if(added) over (order by ord rows unbounded preceding) as n from r),
c as (select *, last_value(case when text like '+++ b/%' then substr(text, 7) end ignore nulls) over w as path, last_value(case when text like '@@ %' then regexp_extract(text, '\\+(\\d+)', 1)::bigint - n end ignore nulls) over w as base from n window w as (order by ord rows unbounded preceding))
select distinct path, (coalesce(base, 0) + n - 1)::int as line from c where added and path is not null union select path, 0 from untracked""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    line = F.when(k % 40 == 1, F.concat(F.lit("+++ b/src/f"), text(F.expr("o_orderkey div 40")), F.lit(".py"))).when((k % 40 == 2) | (k % 13 == 0), F.concat(F.lit("@@ -"), text(k % 300), F.lit(" +"), text(k % 500 + 1), F.lit(",3 @@ def")))
    line = line.when(k % 29 == 0, "+++ not a header").when(k % 3 == 0, "-gone").otherwise("+new")
    untracked = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("new/"), text(F.col("p_partkey"))).alias("path"))
    return C.changed_lines(table(spark, sf_dir, "orders").select(k.alias("ord"), line.alias("text")), untracked)


_ARRIVAL = ["path", "line_no", "method", "route", "framework"]
_STABLE = ", ".join(_ARRIVAL)


@query(f"{_ROUTES} select {_STABLE}, score, row_number() over (order by score desc, {_STABLE}) as place from verdicts")
def targets_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed(_verdicts(spark, sf_dir).select(*_ARRIVAL, "score"), F.desc("score"), *map(F.col, _ARRIVAL))


@query(f"{_ROUTES}, s as (select *, case when auth then 0 else 2 end + case when user_input then 1 else 0 end as points from routes) select {_STABLE}, points, row_number() over (order by points desc, {_STABLE}) as place from s")
def surface_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.routes(code_lines(spark, sf_dir)).withColumn("points", R.surface_points(F.col("auth"), F.col("user_input")))
    return O.placed(found.select(*_ARRIVAL, "points"), F.desc("points"), *map(F.col, _ARRIVAL))


@query(SQL["object_candidates"].replace("select method, route, path, line_no, framework, (", f"select *, row_number() over (order by points desc, {_STABLE}) as place from (select method, route, path, line_no, framework, (") + ")")
def candidates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed(R.object_candidates(_verdicts(spark, sf_dir)).select(*_ARRIVAL, "points"), F.desc("points"), *map(F.col, _ARRIVAL))


@query(f"with g as ({SQL['guard_histogram']}) select *, row_number() over (order by routes desc, guard) as place from g")
def guards_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed(_guards(spark, sf_dir), F.desc("routes"), F.asc("guard"))
