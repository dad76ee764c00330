"""Checkpoints that outlive executors, and scopes that delete them when a result is on storage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error,
    as each machine would have a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc.getCheckpointDir():
        base = sc.getCheckpointDir().rsplit("/", 1)[0]
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths of the innermost scope of the running thread or task, and the scope around it.
_scope: ContextVar[tuple[list[str], object] | None] = ContextVar("scope", default=None)


#: How scratch tables are written. Hadoop without its native library starts a chmod for each file, checksum file and folder of a
#: task; until that runs it shares the JVM's memory, and whoever adds up processes counts the JVM twice. Local folders get no
#: checksum files and no _SUCCESS; other stores aren't touched by this.
WRITTEN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def checkpointed(df: DataFrame, label: str = "table", codec: str | None = None) -> DataFrame:
    """df written, once, as a table in the folder of spark.checkpoint.dir and read from there. A scope around deletes it at its end. codec: other than the session's."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scope.get():
        _scope.get()[0].append(path)
    with _exchanges_go(spark):
        df.write.options(**WRITTEN | ({"compression": codec} if codec else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The setting by which the files of an execution's exchanges are deleted at its end; what it wrote doesn't need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _exchanges_go(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def shuffled_joins(spark: SparkSession):
    """Joins that are planned inside aren't broadcasts: sizes are taken from files, and of rows that compress well or are derived from
    few those are far under what the driver would have to hold. Joins with a broadcast hint are left as they are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def scratch_tables():
    """Tables that are written inside are deleted at its end, but for the one whose frame is given to keep().

    What is kept belongs to the scope around, if there is one. Frames other than the kept one can't be read afterwards. Scopes of
    different threads don't meet.
    """
    own: list[str] = []
    outer = _scope.get()
    token = _scope.set((own, outer))
    used: list[SparkSession] = []

    def keep(df: DataFrame, label: str = "table") -> DataFrame:
        used.append(df.sparkSession)
        df = checkpointed(df, label)
        last = own.pop()
        if outer:
            outer[0].append(last)
        return df

    try:
        yield keep
    finally:
        _scope.reset(token)
        spark = used[0] if used else SparkSession.getActiveSession()
        for path in own if spark else ():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
