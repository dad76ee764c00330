"""A corpus pipeline over the table documents: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of documents. Further columns are carried along,
whatever their names. Rows are judged by their own text: a doc_id that several texts share loses only the texts judged.
An empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, language_id, minhash_dedup, packing, substring_dedup
from riskloom.llm.shared import drop_table, having, in_few_files, read_table, scratch
from riskloom.llm.shared import materialise_few as materialise


def _unused(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the learnt languages don't account for go: null texts, texts without a letter, and texts of which the model knows too few n-grams.

    Rows with a null doc_id are judged like others; repeated rows all stay or all go. Without labelled rows every text
    with a letter stays. lang is read for learning only.
    """
    return language_id.in_known_languages(docs)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, then text key.

    Of rows that agree in doc_id and text one stays. Rows with a null doc_id, and texts without words, are in no group and stay.
    """
    with scratch() as keep:
        found = materialise(minhash_dedup.near_duplicates(docs).where("group_key is not null and doc_id is not null").select("doc_id", "text_key", "group_key"), "near-rows")
        first = materialise(found.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "first-rows")
        gone = found.join(first, "group_key").where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key").distinct()
        twice = found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
        marked = gone.withColumn("gone", F.lit(True)).unionByName(twice.join(gone, ["doc_id", "text_key"], "left_anti").withColumn("gone", F.lit(False)))
        marked = keep(marked.select(F.col("doc_id").alias("id"), "text_key", "gone"), "near-copies")
    key, mark = _unused("text_key", docs), _unused("gone", docs)
    rows = docs.withColumn(key, F.xxhash64("text"))
    marked = marked.select(F.col("id").alias("doc_id"), F.col("text_key").alias(key), F.col("gone").alias(mark))
    stay = having(rows, marked, ["doc_id", key], "left_anti").select(*docs.columns)
    repeated = marked.where(~F.col(mark)).drop(mark)
    if repeated.isEmpty():
        return stay
    return stay.unionByName(having(rows, repeated, ["doc_id", key]).dropDuplicates(["doc_id", key]).select(*docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which no word is left goes.

    n_chars follows the text where it was cut. Rows with a null doc_id or text are as they were; repeated rows are cut alike.
    """
    rows, cut = substring_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.where(~cut | F.col("text").rlike(r"[^ \t-\r]")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold ten following words of a benchmark item, or a whole shorter item, go, and all rows that have them.

    Rows with a null text stay; a null doc_id makes no difference.
    """
    with scratch() as keep:
        found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
        found = keep(found.where("contaminated").select("text_key").distinct(), "contaminated")
    key = _unused("text_key", docs)
    return having(docs.withColumn(key, F.xxhash64("text")), found.select(F.col("text_key").alias(key)), key, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequence and place.

    A null text is an empty one, its end id only; repeated rows and rows with a null doc_id are packed each for itself.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Rows that a task hands to Python at once, at most: a batch of texts is held by the JVM and by its worker, beside all that is made from it.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def _in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage with batches of at most BATCH_ROWS, and its frame in few files; the session keeps the setting, as the frame is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return in_few_files(stage(spark, docs, sf_dir))

    return run


STAGES = [
    ("language_id", _in_batches(language_stage)),
    ("minhash_dedup", _in_batches(minhash_stage)),
    ("substring_dedup", _in_batches(substring_stage)),
    ("decontamination", _in_batches(decontamination_stage)),
    ("packing", _in_batches(packing_stage)),
]
#: SQL has no form of the language, packing and tokenizer stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, rows = read_table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            with scratch() as keep:
                docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
            if before is not None:
                drop_table(before)
            before = docs
    finally:
        spark.conf.set(BATCH, rows)
    return docs
