"""Routes of attribute-routed C# controllers: order-dependent state by file, inherited guards by joins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import dotnet_patterns as D
from ..shipping import ship

_RE = {name: re.compile(getattr(D, name), re.ASCII) for name in ("CLASS", "ROUTE", "VERB", "AUTHORIZE", "ANONYMOUS", "CONSTRAINT", "METHOD", "ARGUMENTS", "ROLES", "POLICY")}
#: Verdicts of an attribute: a guard, "anonymous", or None where nothing is said.
ANON = "anonymous"


def guard_of(line: str) -> str | None:
    """What a line's attributes say: `role:...`, `policy:...`, `auth`, `anonymous` or nothing."""
    if _RE["ANONYMOUS"].search(line):
        return ANON
    if not _RE["AUTHORIZE"].search(line):
        return None
    inner = _RE["ARGUMENTS"].search(line)
    for kind, name in (("role", "ROLES"), ("policy", "POLICY")):
        m = _RE[name].search(inner[1]) if inner else None
        if m:
            return f"{kind}:{m[1]}"
    return "auth"


def base_class(lines: list[str], at: int) -> str:
    """The first base in a class header that may span lines; framework bases and none are empty."""
    header = " ".join(lines[at : at + D.HEADER_LINES]).split("{")[0]
    m = _RE["CLASS"].search(header)
    rest, before = header[m.end() :] if m else "", None
    while before != rest:
        before, rest = rest, re.sub(r"\([^()]*\)|<[^<>]*>", "", rest)
    names = re.search(r":[^A-Za-z0-9_]*(\w+)", rest, re.ASCII)
    return "" if not names or names[1] in D.FRAMEWORK_BASES else names[1]


def route_path(prefix: str, action: str, controller: str) -> str:
    action = action.strip()
    path = action if action.startswith("/") else "/" + "/".join(p for p in (prefix.strip("/"), action.strip("/")) if p)
    path = path.replace("[controller]", controller.removesuffix("Controller").lower()).replace("[action]", "")
    return _RE["CONSTRAINT"].sub(r"{\1}", path).replace("//", "/") or "/"


def _ahead(lines: list[str], at: int) -> str | None:
    """The guard between a verb attribute and its method, at most eleven lines below."""
    if _RE["METHOD"].search(lines[at]):
        return None
    for line in lines[at + 1 : at + 1 + D.LINES_AHEAD]:
        if _RE["METHOD"].search(line):
            return None
        said = guard_of(line)
        if said:
            return said
    return None


def scan(lines: list[str]) -> tuple[list[tuple], list[tuple]]:
    """(routes, classes) of a file: (method, path, line, class, guard or None) and (class, base, guard or None)."""
    routes, classes, name, prefix, class_guard = [], [], "", "", None
    route, guard = "", None
    for i, line in enumerate(lines):
        m = _RE["ROUTE"].search(line)
        route = m[1] if m else route
        guard = guard_of(line) or guard
        verb = _RE["VERB"].search(line)
        new_class = _RE["CLASS"].search(line)
        if verb:
            ahead = _ahead(lines, i)
            own = ahead if ahead and (guard is None or ahead == ANON) else guard
            routes.append((verb[1].upper(), route_path(prefix, verb[2] or route, name), i, name, own or class_guard))
        elif new_class:
            name, prefix, class_guard = new_class[1], route, guard
            classes.append((name, base_class(lines, i), guard))
        if verb or new_class or _RE["METHOD"].search(line):
            route, guard = "", None
    return routes, classes


def _file_rows(key, file: pd.DataFrame) -> pd.DataFrame:
    file = file.sort_values("line_no")
    numbers = file["line_no"].tolist()
    routes, classes = scan(file["line"].tolist())
    rows = [("route", key[0], numbers[i], m, p, c, "", g) for m, p, i, c, g in routes]
    rows += [("class", key[0], k, "", "", c, b, g) for k, (c, b, g) in enumerate(classes)]
    return pd.DataFrame(rows, columns=["what", "path", "line_no", "method", "route", "class", "base", "guard"])


def guarded_maps(lines: DataFrame) -> DataFrame:
    """One row, by_map: whether a mapping of all controllers or pages is followed by a demand for authorisation.

    The demand stands on the mapping's line, or on a line of its own whose nearest line above that isn't blank, at most
    three lines up, maps them all.
    """
    near = Window.partitionBy("path").orderBy("line_no")
    above = lambda k: F.lag("line", k, "").over(near)
    filled = [F.when(F.trim(F.regexp_replace(above(k), "[\\t\\r]", " ")) != "", above(k)) for k in (1, 2, 3)]
    alone = F.col("line").rlike(D.REQUIRE_ALONE) & F.coalesce(F.coalesce(*filled).rlike(D.MAP_ALL), F.lit(False))
    rows = lines.select((F.col("line").rlike(D.MAP_ALL_REQUIRED) | alone).alias("found"))
    return rows.agg(F.coalesce(F.max("found"), F.lit(False)).alias("by_map"))


def controller_routes(lines: DataFrame) -> DataFrame:
    """(method, route, path, line_no, class, guard, auth, user_input) of the .cs files of lines(path, line_no, line).

    The action's word counts first, then the class's, then that of its nearest base in the code base that says
    anything (at most sixteen bases away), then a global policy. A class defined twice takes its last definition in
    order of path. guard is empty where nobody need sign in.
    """
    spark = lines.sparkSession
    ship(spark)
    own = lines.where(F.endswith("path", F.lit(".cs")))
    rows = checkpointed(own.groupBy("path").applyInPandas(_file_rows, "what string, path string, line_no int, method string, route string, class string, base string, guard string"))
    classes = rows.where("what = 'class'").groupBy("class").agg(F.max_by(F.struct("base", "guard"), F.struct("path", "line_no")).alias("c")).select("class", "c.base", "c.guard")
    edges = classes.select(F.col("class").alias("base"), F.col("base").alias("next"), F.col("guard").alias("said"))
    state = checkpointed(classes.select("class", "base", F.lit(None).cast("string").alias("inherited")))
    for _ in range(D.MOST_BASES):
        if state.where("base <> '' and inherited is null").isEmpty():
            break
        step = state.join(edges, "base", "left").select("class", F.when(F.col("inherited").isNull(), F.coalesce("next", F.lit(""))).otherwise("").alias("base"), F.coalesce("inherited", "said").alias("inherited"))
        state = checkpointed(step)
    holds = lambda word: F.coalesce(F.max(F.contains("line", F.lit(word))), F.lit(False))
    wide = own.groupBy("path").agg(holds(D.GLOBAL_USER).alias("user"), *[holds(w).alias(f"f{k}") for k, w in enumerate(D.GLOBAL_FILTERS)])
    wide = wide.agg(F.coalesce(F.max(F.col("user") & (F.col("f0") | F.col("f1") | F.col("f2"))), F.lit(False)).alias("by_policy"))
    wide = wide.crossJoin(F.broadcast(guarded_maps(own))).select((F.col("by_policy") | F.col("by_map")).alias("everywhere"))
    found = rows.where("what = 'route'").select("method", "route", "path", "line_no", "class", "guard").join(state.select("class", "inherited"), "class", "left").crossJoin(F.broadcast(wide))
    inherited = F.when(F.col("inherited").isNotNull() & (F.col("inherited") != ANON), "auth").otherwise(F.col("inherited"))
    said = F.coalesce("guard", inherited, F.when(F.col("everywhere"), F.lit("auth")))
    guard = F.when(said.isNull() | (said == ANON), "").otherwise(said)
    return found.select("method", "route", "path", "line_no", "class", guard.alias("guard"), (guard != "").alias("auth"), ((F.col("method") != "GET") | F.contains("route", F.lit("{"))).alias("user_input"))
