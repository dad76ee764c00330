"""Routes that files declare: GraphQL schemas and OpenAPI documents, by windows over the lines of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.route_patterns import GRAPHQL_FIELD, GRAPHQL_TYPE, OPENAPI_LINES, OPENAPI_MARK, OPENAPI_METHOD, OPENAPI_PATH


def _so_far(*keys: str):
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def graphql_routes(lines: DataFrame) -> DataFrame:
    """(method, route, path, line_no): fields between a Query or Mutation type line and the brace that closes it."""
    rows = lines.where(F.endswith("path", F.lit(".graphql")) | F.endswith("path", F.lit(".gql")))
    opens = F.rlike("line", F.lit(to_java(GRAPHQL_TYPE)))
    rows = rows.withColumns({"opens": opens, "op": F.upper(F.regexp_extract("line", to_java(GRAPHQL_TYPE), 1))})
    rows = rows.withColumns({"part": F.count_if("opens").over(_so_far("path")), "op": F.last(F.when(F.col("opens"), F.col("op")), ignorenulls=True).over(_so_far("path"))}).where("part > 0 and not opens")
    in_part = _so_far("path", "part")
    braces = F.length(F.replace("line", F.lit("}"), F.lit(""))) - F.length(F.replace("line", F.lit("{"), F.lit("")))
    rows = rows.withColumn("depth", F.sum(braces).over(in_part))
    rows = rows.withColumn("closed", F.count_if(F.contains("line", F.lit("}")) & (F.col("depth") <= 0)).over(in_part)).where("closed = 0")
    name = F.regexp_extract("line", to_java(GRAPHQL_FIELD), 1)
    return rows.where(F.rlike("line", F.lit(to_java(GRAPHQL_FIELD))) & (name != "type")).select(F.col("op").alias("method"), F.concat(F.lit("/graphql#"), name).alias("route"), "path", "line_no")


def openapi_routes(lines: DataFrame) -> DataFrame:
    """(method, route, path, line_no) of files with a mark in their first lines: each method under the last path above it."""
    ends = [".yaml", ".yml", ".json"]
    rows = lines.where(F.regexp_extract("path", r"\.[A-Za-z0-9]+$", 0).isin(ends))
    marked = rows.where(F.col("line_no") <= OPENAPI_LINES).where(F.rlike("line", F.lit(to_java(OPENAPI_MARK)))).select("path").distinct()
    rows = rows.join(marked, "path", "left_semi")
    is_path = F.rlike("line", F.lit(to_java(OPENAPI_PATH)))
    rows = rows.withColumns({"is_path": is_path, "route": F.last(F.when(is_path, F.regexp_extract("line", to_java(OPENAPI_PATH), 1)), ignorenulls=True).over(_so_far("path"))})
    rows = rows.where(~F.col("is_path") & F.col("route").isNotNull() & F.rlike("line", F.lit(to_java(OPENAPI_METHOD))))
    return rows.select(F.upper(F.regexp_extract("line", to_java(OPENAPI_METHOD), 1)).alias("method"), "route", "path", "line_no")
