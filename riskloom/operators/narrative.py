"""Reports that put findings together: the attack path, chains of weaknesses, gates over a baseline, and an OpenAPI document of the surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import risk
from . import documents

#: What a rule's name starts with, and the provider that it tells of; the sentences of the reports.
PROVIDERS = {"github": "GitHub", "gitlab": "GitLab", "aws": "AWS", "stripe": "Stripe", "slack": "Slack", "npm": "npm", "sendgrid": "SendGrid", "telegram": "Telegram", "openai": "OpenAI", "twilio": "Twilio", "google": "Google"}
SEVERAL = ("Multiple live credentials are exposed together (", ") — one leaked repo hands an attacker all of them at once.")
FOOTHOLD = "A reachable vulnerability alongside a live credential chains a code foothold into account takeover."
REMOVED = "A credential removed from the code is still live in git history — deleting the line never rotated the key."
EXPOSED = "A live credential is exposed — anyone with read access to this repo can use it right now."
POSTURES = {"A": "Strong posture — no real risk surfaced.", "B": "Good — a few items to tighten.", "C": "Moderate — real risks need attention.", "D": "Weak — address the high-risk findings.", "F": "At risk — fix the critical findings now."}


def provider(rule: Column) -> Column:
    out = F.lit("a service")
    for start, name in PROVIDERS.items():
        out = F.when(F.startswith(rule, F.lit(start)), name).otherwise(out)
    return out


def posture(grade: Column) -> Column:
    """The sentence for a grade, by its letter."""
    out = F.lit(POSTURES["F"])
    for letter, text in POSTURES.items():
        out = F.when(F.startswith(grade, F.lit(letter)), text).otherwise(out)
    return out


def attack_story(findings: DataFrame) -> DataFrame:
    """(part, line) of findings(kind, rule, path, live, privileged, identity, access, reachable, real_risk): one line for each privileged live
    credential, then those that the whole set gives rise to, by part. No live credential and no reachable serious advisory, no line.
    """
    live = (F.col("kind") == "secret") & F.coalesce("live", F.lit(False))
    rows = findings.withColumn("provider", provider(F.col("rule")))
    serious = (F.col("kind") == "vulnerability") & F.coalesce("reachable", F.lit(False)) & (F.col("real_risk") >= risk.HIGH)
    who = F.coalesce(F.nullif("identity", F.lit("")), F.lit("the account"))
    gains = F.coalesce(F.nullif(F.array_join("access", ", "), F.lit("")), F.lit("privileged access"))
    own = rows.where(live & F.col("privileged")).select(F.lit(0).alias("part"), F.concat(F.lit("A live, high-privilege "), "provider", F.lit(" ("), who, F.lit(") is exposed — an attacker gains "), gains, F.lit(".")).alias("line"))
    state = rows.agg(
        F.count_if(live).alias("n"), F.count_if(live & F.col("privileged")).alias("wide"), F.count_if(serious).alias("holes"), F.array_sort(F.collect_set(F.when(live, F.col("provider")))).alias("all"),
        F.count_if(live & F.contains("path", F.lit("git history"))).alias("gone"),
    )
    several, both = F.size("all") >= 2, (F.col("n") > 0) & (F.col("holes") > 0)
    texts = [(several, F.concat(F.lit(SEVERAL[0]), F.array_join("all", ", "), F.lit(SEVERAL[1]))), (both, F.lit(FOOTHOLD)), (F.col("gone") > 0, F.lit(REMOVED)), ((F.col("n") > 0) & (F.col("wide") == 0) & ~several & ~both & (F.col("gone") == 0), F.lit(EXPOSED))]
    lines = F.array(*[F.struct(F.lit(k).alias("part"), F.when(test, text).alias("line")) for k, (test, text) in enumerate(texts, 1)])
    return own.unionByName(state.select(F.inline(lines)).where("line is not null"))


def chain_lines(targets: DataFrame, secrets: DataFrame) -> DataFrame:
    """(part, line) of targets(method, route, path, line_no, auth, cwe) in their order by score and place, and secrets(service, live).

    The first open route to a command, else to an evaluation; the first upload with the first inclusion, or alone if it is open; the first fetch, with
    what a live cloud key adds; the first open query; a live credential beside any sink.
    """
    place = F.struct(*[c for c in ("rank", "path", "line_no", "method", "route") if c in targets.columns], F.col("auth"))
    first = lambda cwe, only_open: F.min(F.when((F.col("cwe") == cwe) & (~F.col("auth") if only_open else F.lit(True)), place))
    row = targets.agg(first("CWE-78", True).alias("command"), first("CWE-95", True).alias("code"), first("CWE-434", False).alias("upload"), first("CWE-22", False).alias("read"), first("CWE-918", False).alias("fetch"), first("CWE-89", True).alias("sql"), F.count("cwe").alias("sinks"))
    alive = secrets.agg(F.coalesce(F.max("live"), F.lit(False)).alias("any_live"), F.coalesce(F.max(F.col("live") & F.contains(F.coalesce("service", F.lit("")), F.lit("AWS"))), F.lit(False)).alias("cloud"))
    at = lambda c: F.concat_ws(" ", F.col(f"{c}.method"), F.col(f"{c}.route"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    there = lambda c: F.col(c).isNotNull()
    run = F.when(there("command"), said("Unauthenticated RCE: ", at("command"), " reaches OS command execution with no auth — a single request runs code on the server.")).when(there("code"), said("Unauthenticated code injection: ", at("code"), " evaluates attacker input with no auth gate."))
    drop = F.when(there("upload") & there("read"), said("Upload-to-RCE: write a payload via ", at("upload"), " (file upload), then have ", at("read"), " include/read it (path traversal) — chains to code execution.")).when(there("upload") & ~F.col("upload.auth"), said("Unrestricted upload: ", at("upload"), " accepts files with no auth — test for webshell upload into a served directory."))
    cloud = F.when(F.col("cloud"), " A live AWS key is already present, confirming this account is reachable.").otherwise("")
    fetch = F.when(there("fetch"), said("SSRF pivot: ", at("fetch"), " fetches a user URL — target the cloud metadata endpoint to mint temporary credentials.", cloud))
    sql = F.when(there("sql"), said("Unauthenticated SQLi: ", at("sql"), " builds SQL from input with no auth — likely full read of the database."))
    hand = F.when(F.col("any_live") & (F.col("sinks") > 0), "A live credential was found alongside reachable code sinks — foothold and post-exploitation are both in hand.")
    lines = F.array(*[F.struct(F.lit(k).alias("part"), text.alias("line")) for k, text in enumerate([run, drop, fetch, sql, hand], 1)])
    return row.crossJoin(F.broadcast(alive)).select(F.inline(lines)).where("line is not null")


def owasp_by_target(targets: DataFrame) -> DataFrame:
    """(owasp, sinks): the sinks of all targets by category, each weakness and line once a target; sinks of two targets count for both."""
    key = ["path", "line_no", "method", "route", "framework", "sink_line", "cwe"]
    rows = targets.where("cwe is not null").select(*key).distinct().withColumn("owasp", risk.owasp(F.col("cwe")))
    return rows.where("owasp <> ''").groupBy("owasp").agg(F.count("*").alias("sinks"))


def of_sources(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """Findings of the scanners that are switched on."""
    return findings.where(F.col("kind").isin(kinds))


def open_only(found: DataFrame) -> DataFrame:
    return found.where(~F.col("auth"))


def gated(findings: DataFrame, accepted: DataFrame, fail_on: str) -> tuple[DataFrame, dict]:
    """(findings beyond the baseline, written; {kept, suppressed, highest, failed}).

    The numbers are observed in the pass that writes the findings, so nothing is read or computed twice. An empty baseline suppresses nothing; without
    findings nothing fails.
    """
    known = accepted.select("fingerprint", F.lit(True).alias("known_")).distinct()
    seen = Observation("gate")
    rows = findings.join(known, "fingerprint", "left").withColumn("known_", F.coalesce("known_", F.lit(False)))
    fresh = F.when(~F.col("known_"), F.col("real_risk"))
    rows = rows.observe(seen, F.count_if(~F.col("known_")).alias("kept"), F.count_if("known_").alias("suppressed"), F.coalesce(F.max(fresh), F.lit(0)).alias("highest"))
    kept = checkpointed(rows.where("not known_").drop("known_"))
    numbers = dict(seen.get)
    return kept, numbers | {"failed": numbers["kept"] > 0 and numbers["highest"] >= risk.SEVERITIES.index(fail_on.upper())}


def openapi_document(found: DataFrame, parameters: DataFrame) -> DataFrame:
    """The OpenAPI 3.0 document of routes, a path a row: operations with the parameters of the path and the names that requests are read for.

    Paths start with a slash, end before #, and have {name} for :name; ANY, QUERY and MUTATION are get. The names are one list for all
    operations, as nothing says which belongs where; they are joined to each path once.
    """
    known = F.lower("method")
    method = F.when(known.isin("any", "query", "mutation"), "get").otherwise(known)
    path = F.split(F.when(F.startswith("route", F.lit("/")), F.col("route")).otherwise(F.concat(F.lit("/"), "route")), "#")[0]
    path = F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(F.startswith(s, F.lit(":")), F.concat(F.lit("{"), F.substring(s, 2, 1 << 20), F.lit("}"))).otherwise(s)), "/")
    rows = found.select(path.alias("path"), method.alias("method")).groupBy("path").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    names = parameters.select("param").distinct().agg(F.array_sort(F.collect_list("param")).alias("names"))
    kind = F.struct(F.lit("string").alias("type"))
    one = lambda name, where, must: F.struct(name.alias("name"), F.lit(where).alias("in"), F.lit(must).alias("required"), kind.alias("schema"))
    inner = F.array_sort(F.array_distinct(F.regexp_extract_all("path", F.lit(r"[:{](\w+)}?"), F.lit(1))))
    listed = F.concat(F.transform(inner, lambda n: one(n, "path", True)), F.transform("names", lambda n: one(n, "query", False)))
    operation = F.struct(F.lit(f"discovered by {documents.TOOL}").alias("summary"), F.create_map(F.lit("200"), F.struct(F.lit("ok").alias("description"))).alias("responses"), F.when(F.size(listed) > 0, listed).alias("parameters"))
    operations = F.map_from_entries(F.transform("methods", lambda m: F.struct(m.alias("key"), operation.alias("value"))))
    key = F.expr("substring(to_json(named_struct('p', path)), 6, length(to_json(named_struct('p', path))) - 6)")
    item = F.concat(key, F.lit(":"), F.to_json(operations))
    head = f'{{"openapi":"3.0.3","info":{{"title":"{documents.TOOL} — discovered attack surface","version":"1.0.0"}},"servers":[{{"url":"https://TARGET"}}],"paths":{{'
    return documents.document(rows.crossJoin(F.broadcast(names)), [F.col("path")], item, head, "}}")
