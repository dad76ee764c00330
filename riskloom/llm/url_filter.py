"""URL rules as a sort-merge range join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise

#: The rules of the contract (host, path, verdict).
CONTRACT_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A cell of the sweep gets about so many urls, or four times the rules of its host where that is more.
CELL_URLS = 256


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_parts(url):
    """(host, path) columns of a url column: both empty without a url or without ``://``."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    rest = F.when(F.locate("://", url) > 0, rest).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _nested_rules(rules: DataFrame) -> DataFrame:
    """(owner, path, chain): chain holds the rules of that host whose path begins this one, shortest first, itself last."""
    known = rules.where("host is not null and host <> '' and verdict is not null").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    owner = F.concat_ws(".", F.reverse(F.split("host", "[.]")))
    known = known.select(owner.alias("owner"), "path", F.concat("host", "path").alias("rule"), "verdict")
    lengths = known.groupBy("owner").agg(F.collect_set(F.length("path")).alias("lengths"))
    parts = known.join(lengths, "owner").select("owner", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    parts = parts.select("owner", "path", F.substring("path", F.lit(1), F.col("n")).alias("outer"))
    outer = known.select("owner", F.col("path").alias("outer"), "rule", "verdict")
    one = F.struct(F.length("outer").alias("n"), F.col("outer").alias("path"), "rule", "verdict")
    return parts.join(outer, ["owner", "outer"]).groupBy("owner", "path").agg(F.array_sort(F.collect_list(one)).alias("chain"))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url).

    A rule (host, path, verdict) fits its host and the host's subdomains where the url's path begins with the rule's
    path; the longest rule string wins, of equally long ones that of the longer host. A rule without a host or a verdict is left out, a
    null path is an empty one, and of equal rules with different verdicts the last in order (block) holds. Without a
    fitting rule the rule is null and the verdict is `otherwise`. Null urls and urls without ``://`` have an empty
    host and path. Repeated rows are each judged; further columns of pages, whatever their names, are ignored; empty
    tables give empty results.

    Each host is written with its labels reversed, so that a rule's subdomains and paths are one interval of keys.
    Distinct urls meet the rules of each host above them in cells of bounded size; in a cell, sorted by key, the last
    rule passed brings the stack of rules that enclose it, and the deepest one that is still open is the url's.
    Hot hosts are split over many cells by a hash of the url; their rules are repeated in each.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = materialise(parts.where("host <> ''").select("host", "path").distinct(), "urls")
    nested = materialise(_nested_rules(rules), "rules")
    depth = nested.agg(F.max(F.size(F.split("owner", "[.]")))).first()[0] or 0
    labels = F.reverse(F.split("host", "[.]"))
    steps = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1))))
    over = urls.select("host", "path", F.explode(F.transform(steps, lambda i: F.concat_ws(".", F.slice(labels, 1, i)))).alias("owner"))
    owners = materialise(nested.groupBy("owner").agg(F.count("*").alias("n_rules")), "owners")
    cells = over.join(owners, "owner").groupBy("owner").agg(F.ceil(F.count("*") / F.greatest(F.lit(CELL_URLS), 4 * F.first("n_rules"))).alias("cells"))
    cells = materialise(cells, "cells")
    url_rows = over.join(cells, "owner").select("owner", F.pmod(F.xxhash64("host", "path"), "cells").alias("cell"), "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(nested.schema["chain"].dataType).alias("chain"))
    rule_rows = nested.join(cells, "owner").select("owner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("cell"), "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "chain")
    sweep = Window.partitionBy("owner", "cell").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = url_rows.unionByName(rule_rows).withColumn("stack", F.last("chain", ignorenulls=True).over(sweep)).where("kind = 1")
    still_open = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    hits = passed.select("host", "path", "owner", F.try_element_at(still_open, F.lit(-1)).alias("hit")).where("hit is not null")
    order = F.struct(F.length("hit.rule"), F.length("owner"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("hit.rule", "hit.verdict"), order).alias("best"))
    best = materialise(best.select("host", "path", "best.rule", "best.verdict"), "best")
    return parts.join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


#: DuckDB's form of the contract.
OP1_SQL = """
with rules(rule, rh, rp, v) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
u as (select distinct host, path from b),
f as (select host, path, max_by(rule, length(rule)) as rule, max_by(v, length(rule)) as v from u join rules
  on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select b.page_id, b.host, b.path, f.rule, coalesce(f.v, 'allow') as verdict from b left join f on b.host = f.host and b.path = f.path
"""
