"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, decontaminate, embedding_dedup, language_id, license_scan, minhash_dedup, packing, phrase_graph, repair_files, substring_dedup, token_counts, url_filter, vector_codes
from .shared import read_table, work_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.CONTRACT_RULES))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans_table(substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), minhash_dedup.OP7_RULE).select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{work_folder(spark)}/token-files-{uuid.uuid4().hex}"
    repair_files.write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return repair_files.read_documents(spark, out, ids_crc32=F.crc32("ids"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(read_table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_bpe.encoded(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compressed(read_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(vector_codes.books_sha256(books)))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_token_counts, op4_substring_dedup, op5_best_fit_packing, op6_decontamination, op7_minhash_dedup, op8_license_scan, op9_token_output, op10_embedding_dedup, op11_phrase_mining, op12_bpe_codec, op13_vector_codes)}


def llm_oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op8_license_scan": license_scan.OP8_SQL, "op11_phrase_mining": phrase_graph.OP11_SQL}
