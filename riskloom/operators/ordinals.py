"""Total orders over many partitions: ordinals, running sums and values carried forward, without a window over all rows.

Rows are dealt by range, so each partition is a run of the order, and written once with its number. What a run needs from those before it is
one row of each, at most as many as partitions; these are added up on the driver and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..durable import checkpointed

#: The column that holds the number of a row's run.
RUN = "run_"


def runs(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with the number of the run that they are in; the order should be total, else equal rows come in any order."""
    return checkpointed(rows.repartitionByRange(*order).withColumn(RUN, F.spark_partition_id()))


def _joined(rows: DataFrame, made: DataFrame, start: dict, step: Callable[[dict, dict], dict]) -> DataFrame:
    """rows with what the runs before theirs add up to, in columns of made but for its first one."""
    state, out = start, []
    for r in made.orderBy(RUN).collect():
        out.append((r[RUN], *(state[c] for c in made.columns[1:])))
        state = step(state, r.asDict())
    schema = StructType([StructField(RUN, IntegerType()), *[StructField(f"before_{f.name}", f.dataType, True) for f in made.schema.fields[1:]]])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(out, schema)), RUN, "left")


def running(rows: DataFrame, order: list[Column], counted: Column, name: str) -> DataFrame:
    """rows of runs() with the sum of a whole number over all rows up to each one."""
    own = F.coalesce(counted.cast("bigint"), F.lit(0))
    made = rows.groupBy(RUN).agg(F.sum(own).alias("n"))
    window = Window.partitionBy(RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _joined(rows, made, {"n": 0}, lambda s, r: {"n": s["n"] + r["n"]})
    return out.withColumn(name, F.sum(own).over(window) + F.col("before_n")).drop("before_n")


def carried(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows of runs() in a rising order with the last value of each expression that isn't null, up to each row."""
    rows = rows.withColumns({f"own_{c}": e for c, e in values.items()})
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    made = rows.groupBy(RUN).agg(*[F.max_by(f"own_{c}", F.when(F.col(f"own_{c}").isNotNull(), place)).alias(c) for c in values])
    out = _joined(rows, made, dict.fromkeys(values), lambda s, r: {c: s[c] if r[c] is None else r[c] for c in values})
    window = Window.partitionBy(RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({c: F.coalesce(F.last(f"own_{c}", ignorenulls=True).over(window), F.col(f"before_{c}")) for c in values})
    return out.drop(*[f"{p}_{c}" for c in values for p in ("own", "before")])


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their number in the order, from 1."""
    return running(runs(rows, *order), list(order), F.lit(1), name).drop(RUN)
