"""HTTP routes of source lines, the sinks inside their handlers, and what their guards say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.dialect import to_java
from ..functions.route_patterns import ANY_METHODS, CHANGING, GUARD, ID_LIKE, INTERNAL_HOST, OWNED, PARAMETERS, PATH_PARAM, PRIVATE_IP, RATE_LIMIT, RESOURCE_ROUTES, RESOURCES, ROUTE_INPUT, ROUTE_RULES, SENSITIVE, SPAN_LINES
from . import dotnet, specs
from .lines import language


def _like(column, pattern: str) -> Column:
    return F.rlike(column, F.lit(to_java(pattern)))


def routes(lines: DataFrame) -> DataFrame:
    """(method, route, framework, path, line_no, auth, user_input, rate_limited): at most one route a line and framework."""
    rows = lines.withColumn("lang", language(F.col("path"))).where("lang is not null").withColumn("guard", _like("line", GUARD))
    near = Window.partitionBy("path").orderBy("line_no")
    wide = max(r[5] for r in ROUTE_RULES)
    rows = rows.withColumn("guard_near", F.max("guard").over(near.rangeBetween(-wide, wide)))
    made = []
    for name, lang, pattern, method_at, path_at, around in ROUTE_RULES:
        p = to_java(pattern)
        method = F.upper(F.regexp_extract("line", p, method_at)) if method_at else F.lit("GET")
        method = F.when(method.isin(ANY_METHODS), "ANY").otherwise(method)
        one = F.struct(method.alias("method"), F.regexp_extract("line", p, path_at).alias("route"), F.lit(name).alias("framework"), (F.col("guard_near") if around else F.col("guard")).alias("auth"))
        made.append(F.when((F.col("lang") == lang) & F.rlike("line", F.lit(p)), one))
    found = rows.select("path", "line_no", "line", F.inline(F.array_compact(F.array(*made)))).where("route <> ''")
    found = found.select("method", "route", "framework", "path", "line_no", "auth", _like("line", ROUTE_INPUT).alias("user_input"), _like("line", RATE_LIMIT).alias("rate_limited"))
    name = F.regexp_extract("line", to_java(RESOURCES), 1)
    listed = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(end).alias("end")) for m, end in RESOURCE_ROUTES])
    rails = rows.where((F.col("lang") == "ruby") & _like("line", RESOURCES)).select(name.alias("name"), "path", "line_no", F.inline(listed))
    no = F.lit(False)
    rails = rails.select("method", F.concat(F.lit("/"), "name", "end").alias("route"), F.lit("Rails (resources)").alias("framework"), "path", "line_no", no.alias("auth"), no.alias("user_input"), no.alias("rate_limited"))
    return found.unionByName(rails)


def every_route(lines: DataFrame) -> DataFrame:
    """routes with what GraphQL and OpenAPI files declare and C# controllers, and their guard where it is known by name."""
    no = F.lit(False)
    plain = lambda rows, name, given: rows.select("method", "route", F.lit(name).alias("framework"), "path", "line_no", no.alias("auth"), F.lit(given).alias("user_input"), no.alias("rate_limited"))
    declared = plain(specs.graphql_routes(lines), "GraphQL", True).unionByName(plain(specs.openapi_routes(lines), "OpenAPI", False))
    named = routes(lines).unionByName(declared).withColumn("guard", F.lit(""))
    dotnet_ = dotnet.controller_routes(lines).select("method", "route", F.lit("ASP.NET Core").alias("framework"), "path", "line_no", "auth", "user_input", no.alias("rate_limited"), "guard")
    return named.unionByName(dotnet_)


def guard_histogram(found: DataFrame) -> DataFrame:
    """(guard, routes): how many routes name each guard, `(none)` for none."""
    return found.groupBy(F.when(F.col("guard") == "", "(none)").otherwise(F.col("guard")).alias("guard")).agg(F.count("*").alias("routes"))


def open_ages(judged: DataFrame, blame: DataFrame, now: Column) -> DataFrame:
    """Open routes with sinks and the days since their line was written, from blame(path, line, author_time)."""
    rows = judged.where("sinks > 0 and not auth").join(blame.select("path", F.col("line").alias("line_no"), "author_time"), ["path", "line_no"])
    return rows.select("method", "route", "path", "line_no", risk.exposed_days(now, F.col("author_time")).alias("days"))


def handler_spans(found: DataFrame) -> DataFrame:
    """Routes with start and end: up to the next route's line in the file, at most 120 lines."""
    after = Window.partitionBy("path").orderBy("line_no").rangeBetween(1, SPAN_LINES - 1)
    return found.withColumn("span_end", F.coalesce(F.min("line_no").over(after), F.col("line_no") + SPAN_LINES).cast("int"))


def targets(found: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each route and sink in its handler, or for the route alone: an equality on the file and a range on the line."""
    spans = handler_spans(found).alias("r")
    sinks = findings.select("path", F.col("line_no").alias("sink_line"), F.col("rule").alias("sink_rule"), "cwe").alias("s")
    inside = (F.col("r.path") == F.col("s.path")) & (F.col("sink_line") >= F.col("line_no")) & (F.col("sink_line") < F.col("span_end"))
    return spans.join(sinks, inside, "left").select("r.*", "sink_line", "sink_rule", "cwe")


def verdicts(joined: DataFrame) -> DataFrame:
    """Each route's number of sinks, exposure verdict and rank."""
    keys = ["method", "route", "framework", "path", "line_no", "auth", "user_input", "rate_limited"]
    rows = joined.groupBy(*keys).agg(F.count("sink_rule").alias("sinks"), F.coalesce(F.max(F.col("sink_rule") == "idor"), F.lit(False)).alias("no_ownership"))
    sink, open_, given = F.col("sinks") > 0, ~F.col("auth"), F.col("user_input")
    verdict = F.when(open_ & sink & given, "EXTERNAL-CRITICAL").when(open_ & sink, "EXTERNAL-HIGH").when(sink & given, "AUTHED-HIGH").when(open_, "EXPOSED").otherwise("")
    score = F.when(sink, 4).otherwise(0) + F.when(open_, 2).otherwise(0) + F.when(given, 1).otherwise(0)
    return rows.withColumns({"verdict": verdict, "score": score})


def surface_points(auth: Column, user_input: Column) -> Column:
    """How soon a route is worth a look: two points where it is open, one where it takes input."""
    return F.when(auth, 0).otherwise(2) + F.when(user_input, 1).otherwise(0)


def auth_anomalies(found: DataFrame) -> DataFrame:
    """Open routes beside guarded ones with the same first fixed path segment."""
    segment = F.regexp_extract("route", "^/*([^/]*)", 1)
    rows = found.withColumn("segment", segment).where((F.col("segment") != "") & ~F.col("segment").rlike("^[:{<]"))
    closed = rows.groupBy("segment").agg(F.max("auth").alias("closed")).where("closed").select("segment")
    return rows.where("not auth").join(closed, "segment", "left_semi").select(*found.columns, "segment")


def brute_forceable(found: DataFrame) -> DataFrame:
    return found.where(~F.col("rate_limited") & _like("route", SENSITIVE))


def rate_limit_deviations(found: DataFrame) -> DataFrame:
    """Sensitive routes without a limit where some of at least three, but not all, have one."""
    rows = found.where(_like("route", SENSITIVE))
    norm = rows.agg(F.count("*").alias("n"), F.count_if("rate_limited").alias("limited"))
    return rows.crossJoin(F.broadcast(norm)).where("n >= 3 and limited > 0 and limited < n and not rate_limited").drop("n")


def object_candidates(judged: DataFrame) -> DataFrame:
    """Routes with object ids in their path, scored by how easily others' objects are reached."""
    names = F.transform(F.regexp_extract_all("route", F.lit(to_java(PATH_PARAM)), F.lit(0)), lambda m: F.regexp_extract(m, r"^[:{]([^:?}]*)", 1))
    rows = judged.withColumn("params", F.array_distinct(F.filter(names, lambda n: n != ""))).where(F.size("params") > 0)
    one = lambda test, points: F.when(test, points).otherwise(0)
    points = one(F.upper("method").isin(CHANGING), 2) + one(F.col("no_ownership"), 3) + one(~F.col("auth"), 2) + one(F.exists("params", lambda p: F.rlike(p, F.lit(to_java(ID_LIKE)))), 1) + one(_like("route", OWNED), 1)
    return rows.withColumn("points", points)


def open_changes(found: DataFrame) -> DataFrame:
    """Open routes that change state of resources that belong to someone."""
    return found.where(~F.col("auth") & F.upper("method").isin(CHANGING) & _like("route", OWNED))


def guard_level(guard: Column) -> Column:
    return F.when(guard == "", 0).when(guard == "auth", 1).otherwise(2)


def guard_outliers(guarded: DataFrame) -> DataFrame:
    """Routes(path, guard, ...) below the level that at least half of three or more routes of their file have; ties of the usual guard go to the least name."""
    group = Window.partitionBy("path")
    rows = guarded.withColumn("level", guard_level(F.col("guard"))).withColumns({"n": F.count("*").over(group), "top": F.max("level").over(group)})
    rows = rows.withColumn("at_top", F.count_if(F.col("level") == F.col("top")).over(group))
    usual = rows.where("level = top").groupBy("path", "guard").count().groupBy("path").agg(F.min_by("guard", F.struct(-F.col("count"), "guard")).alias("dominant"))
    return rows.where("n >= 3 and top > 0 and at_top * 2 >= n and level < top").join(usual, "path").drop("n", "top", "at_top")


def posture_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(method, route, change): new, new-open or weakened routes of head(method, route, auth, ord) against base; of equal routes head's first and base's last count."""
    key = [F.upper("method").alias("method"), "route"]
    old = base.select(*key, "auth", "ord").groupBy("method", "route").agg(F.max_by("auth", "ord").alias("was"))
    new = head.select(*key, "auth", "ord").groupBy("method", "route").agg(F.min_by("auth", "ord").alias("auth"))
    rows = new.join(old, ["method", "route"], "left")
    change = F.when(F.col("was").isNull() & ~F.col("auth"), "new-open").when(F.col("was").isNull(), "new").when(F.col("was") & ~F.col("auth"), "weakened")
    return rows.select("method", "route", change.alias("change")).where("change is not null")


def hosts(lines: DataFrame) -> DataFrame:
    """Private addresses and internal host names of all lines."""
    one = F.regexp_extract_all("line", F.lit(to_java(PRIVATE_IP)), F.lit(0))
    other = F.transform(F.regexp_extract_all("line", F.lit(to_java(INTERNAL_HOST)), F.lit(0)), F.lower)
    return lines.select(F.explode(F.concat(one, other)).alias("host")).distinct()


def parameters(lines: DataFrame) -> DataFrame:
    """Names of the request parameters that the lines read."""
    found = F.concat(*[F.regexp_extract_all("line", F.lit(to_java(p)), F.lit(1)) for p in PARAMETERS])
    return lines.select(F.explode(found).alias("param")).where("param <> ''").distinct()


def wordlist(found: DataFrame, params: DataFrame) -> DataFrame:
    """Paths without their first slash, then parameters; each word once."""
    words = found.select(F.regexp_replace("route", "^/", "").alias("word"), F.lit(0).alias("part")).unionByName(params.select(F.col("param").alias("word"), F.lit(1).alias("part")))
    return words.where("word <> ''").groupBy("word").agg(F.min("part").alias("part"))
