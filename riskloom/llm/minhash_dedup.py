"""Near copies of whole documents: MinHash bands, verification on full sets, components."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .minhash_links import NearRule, near_groups, set_columns
from .shared import as_text, drop_table, having, leave_tokenizers, scratch, text_slices
from .shared import materialise_few as materialise
from .textkernel import NOT_SPACE, Words, shingle_set

#: Five words and 0.8, the rule unless a contract names another.
DEFAULT = NearRule()


def _document_sets(rule: NearRule, with_bands: bool):
    def run(batches):
        leave_tokenizers()
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(as_text(part.column("text")), NOT_SPACE)
                sets = [shingle_set(w.hash[w.row_at[i] : w.row_at[i + 1]], rule.words) for i in range(len(part))]
                columns = {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), **set_columns(sets, rule, with_bands)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def near_duplicates(docs: DataFrame, rule: NearRule = DEFAULT) -> DataFrame:
    """(doc_id, text_key, n_shingles, group_key, component_id, kept) of every row of docs(doc_id, text).

    Words are runs of bytes other than space and \\t to \\r, after lower-casing A-Z; the set of a document are its
    distinct shingles of rule.words words, or its whole sequence if it has fewer. Documents whose sets reach
    rule.percent are linked; component_id is the smallest doc_id reachable; kept says that it is the row's own. text_key is
    xxhash64 of the text, and group_key the same for all rows of a component and null for sets without shingles.
    Null, empty and blank texts have no set and are linked with nothing. A row with a null doc_id is linked with
    nothing either and is kept, with a null component_id. Repeated rows get equal results, each in its own row;
    a doc_id of several texts has a result for each text. Further columns of docs are ignored. An empty table gives
    an empty result. A pair at exactly rule.percent is missed with a probability of about
    (1 - 0.8 ** rows) ** bands, 1.5e-5 by default; texts of any length are read whole.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    with scratch() as keep:
        return keep(_near_duplicates(docs, rule), "near-copies")


def _near_duplicates(docs: DataFrame, rule: NearRule) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = materialise(docs.mapInArrow(_document_sets(rule, True), f"doc_id {kind}, text_key bigint, n int, key binary, bands array<bigint>"), "document-sets")
    classes = made.where("key is not null and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    rows = materialise(made.drop("bands"), "documents")
    drop_table(made)

    def fetch(keys: DataFrame) -> DataFrame:
        asked = classes.select("key", "first_id").join(keys, "key")
        ids = materialise(asked.select(F.col("first_id").alias("doc_id")).distinct(), "asked")
        sets = having(docs, ids, "doc_id").mapInArrow(_document_sets(rule, False), f"doc_id {kind}, text_key bigint, n int, key binary, sig binary, shingles binary")
        return sets.select("key", "sig", "shingles").where("key is not null")

    groups = near_groups(classes.select("key", "n", "bands"), fetch, rule)
    least = groups.join(classes.select("key", "first_id"), "key").groupBy("component").agg(F.min("first_id").alias("least_id"))
    of_class = groups.join(materialise(least, "least"), "component").select("key", "component", "least_id")
    of_class = classes.select("key", "first_id").join(of_class, "key", "left").select("key", F.coalesce("component", "key").alias("group_key"), F.coalesce("least_id", "first_id").alias("component_id"))
    of_class = materialise(of_class, "class-component")
    out = rows.select("doc_id", "text_key", F.col("n").cast("bigint").alias("n_shingles"), "key").join(of_class, "key", "left")
    component = F.when(F.col("key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", "group_key", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The contract's rule of op7: two words.
OP7_RULE = replace(DEFAULT, words=2)
