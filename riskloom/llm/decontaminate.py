"""Benchmark passages in documents by winnowing: one fingerprint for each run of windows with one least k-gram, joined and extended."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import as_text, binary_rows, materialise, scratch, text_slices
from .textkernel import ALNUM, Words, grams, least_places

#: Words of a window, and of a k-gram; a window holds WINDOW - GRAM + 1 k-grams.
WINDOW, GRAM = 10, 5
#: Bits of the filter of fingerprints that every task gets: 2 MB at most, however large the benchmark is.
FILTER_BITS = 24
PRINT = "start int, size int, print bigint, around binary"


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _prints(w: Words, size: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams that are the least one, the first if there are several, of some window of size words.

    rows: whether each row takes part. Windows lie in one row, and following windows with one least k-gram give it once.
    """
    gram = min(GRAM, size)
    if len(w.hash) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.rows()
    inside = row[: len(row) - size + 1] == row[size - 1 :]
    if rows is not None:
        inside &= rows[row[: len(inside)]]
    g = grams(w.hash, gram)
    place = np.unique(least_places(g, size - gram + 1)[np.flatnonzero(inside)])
    return place, g[place]


def _around(w: Words, place: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the words that windows of size words around a k-gram can hold: those before it, from near to far, then
    those from its first on; 0 beyond the text."""
    before = size - min(GRAM, size)
    at = place[:, None] + np.concatenate([-1 - np.arange(before), np.arange(size)])[None, :]
    row = np.searchsorted(w.row_at, place, side="right") - 1
    inside = (at >= w.row_at[row][:, None]) & (at < w.row_at[row + 1][:, None])
    out = np.zeros(at.shape, np.uint64)
    out[inside] = w.hash[at[inside]] | np.uint64(1)
    return out


def _print_rows(w: Words, found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.StructArray]:
    """(rows, fingerprints) of (size, places, hashes), in the order of the rows."""
    place = np.concatenate([p for _, p, _ in found] or [np.zeros(0, np.int64)])
    size = np.concatenate([np.full(len(p), s, np.int32) for s, p, _ in found] or [np.zeros(0, np.int32)])
    prints = np.concatenate([h for _, _, h in found] or [np.zeros(0, np.uint64)])
    around = pa.concat_arrays([binary_rows(_around(w, p, s)) for s, p, _ in found] or [pa.array([], pa.binary())])
    row = np.searchsorted(w.row_at, place, side="right") - 1
    order = np.argsort(row, kind="stable")
    fields = [pa.array((place - w.row_at[row])[order].astype(np.int32)), pa.array(size[order]), pa.array(prints[order].view(np.int64)), around.take(pa.array(order))]
    return row[order], pa.StructArray.from_arrays(fields, ["start", "size", "print", "around"])


def _item_prints(batches):
    for batch in batches:
        for part in text_slices(batch, "text"):
            w = Words(as_text(part.column("text")), ALNUM)
            sizes = np.minimum(w.counts(), WINDOW)
            row, prints = _print_rows(w, [(s, *_prints(w, s, sizes == s)) for s in np.unique(sizes[sizes > 0]).tolist()])
            slot = _slots(prints.field(2).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_pydict({"item_id": part.column("item_id").take(pa.array(row)), "slot": slot, **{n: prints.field(k) for k, n in enumerate(("start", "size", "print", "around"))}})


def _document_prints(bits: dict[int, bytes], sizes: list[int]):
    """Rows with the document's words and those fingerprints that the benchmark may hold."""

    def run(batches):
        tables = {size: np.frombuffer(bits[size], np.uint8) for size in sizes}
        for batch in batches:
            for part in text_slices(batch, "text"):
                text = as_text(part.column("text"))
                w = Words(text, ALNUM)
                found = []
                for size in sizes:
                    place, h = _prints(w, size)
                    slot = _slots(h)
                    hit = (tables[size][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    found.append((size, place[hit], h[hit]))
                row, prints = _print_rows(w, found)
                per_row = np.bincount(row, minlength=len(part))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
                keys = [hashlib.blake2b(text[i].as_buffer(), digest_size=16).digest() if per_row[i] else None for i in range(len(part))]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_words": pa.array(w.counts().astype(np.int64)), "key": pa.array(keys, pa.binary()), "prints": pa.ListArray.from_arrays(offsets, prints)})

    return run


def _extended(batches):
    """Joined fingerprints whose alike words, left and right of the k-gram's first, make up a window; start and end of these words."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        alike = np.zeros((len(batch), 2), np.int64)
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            before = s - min(GRAM, s)
            a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1) for c in ("around", "known"))
            same = (a == b) & (a != 0)
            alike[own, 0] = np.cumprod(same[:, :before], axis=1).sum(axis=1)
            alike[own, 1] = np.cumprod(same[:, before:], axis=1).sum(axis=1)
        start = batch.column("start").to_numpy()
        out = pa.RecordBatch.from_pydict({"key": batch.column("key"), "place": batch.column("place"), "start": (start - alike[:, 0]).astype(np.int32), "end": (start + alike[:, 1]).astype(np.int32)})
        yield out.filter(pa.array(alike.sum(axis=1) >= size))


def _filters(items: DataFrame) -> dict[int, bytes]:
    """A bit field of the fingerprints of each window size; its size is fixed, so it may go to every task."""
    words = items.groupBy("size", F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for size, at, bits in words.toLocalIterator():
        out.setdefault(size, np.zeros(1 << (FILTER_BITS - 6), np.int64))[at] = bits
    return {size: table.tobytes() for size, table in out.items()}


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, spans, contaminated) of every row of docs(doc_id, text) against benchmark(item_id, text).

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. A window of an item is ten following
    words; an item of fewer words, but not none, is one window. n_hit counts the words inside any occurrence of a
    window, spans (start, end in words) are the occurrences joined where they meet, items the sorted ids, as strings,
    of the items found; text_key is xxhash64 of the text. Null and empty texts have no words and no hits; items with a
    null id are left out; rows of the same item_id count once; repeated documents get equal results each; further
    columns are ignored; empty tables give empty results or no hits.

    Each window's fingerprint is the hash of its least k-gram, kept once, with its place, for all following windows that
    share it; so two equal windows always have an equal fingerprint at the same place within them. Fingerprints of
    documents that a fixed-size bit field admits are joined with those of the items, copies of a text once and equal
    surroundings in items once, and extended to both sides by comparing 64-bit hashes of words; alike words that make up
    a window are hits.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        return keep(_contamination(docs, benchmark), "contamination")


def _contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = benchmark.where("item_id is not null").select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    items = materialise(items.mapInArrow(_item_prints, f"item_id {kind}, slot bigint, {PRINT}"), "item-prints")
    bits = _filters(items)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    base = base.mapInArrow(_document_prints(bits, sorted(bits)), f"doc_id {doc_kind}, text_key bigint, n_words bigint, key binary, prints array<struct<{PRINT.replace(' ', ': ').replace(',:', ',')}>>")
    base = materialise(base, "document-prints")
    texts = base.where("key is not null").groupBy("key").agg(F.first("prints").alias("prints")).select("key", F.inline("prints"))
    items = items.withColumn("place", F.sha2(F.concat_ws("/", "size", F.hex("around")), 256))
    known = items.select("print", "size", "place", F.col("around").alias("known")).distinct()
    joined = materialise(texts, "candidates").join(materialise(known, "known"), ["print", "size"]).select("key", "place", "start", "size", "around", "known")
    hits = materialise(joined.mapInArrow(_extended, "key binary, place string, start int, end int"), "hits")
    found = hits.select("key", "place").distinct().join(materialise(items.select("place", F.col("item_id").cast("string").alias("item")).distinct(), "places"), "place")
    found = found.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    grow = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    first = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    per_text = materialise(spans.select("key", F.aggregate("found", first, grow).alias("spans")).join(found, "key"), "text-hits")
    joined = base.where("key is not null").select("doc_id", "text_key", "n_words", "key").join(per_text, "key", "left").drop("key")
    plain = base.where("key is null").select("doc_id", "text_key", "n_words", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))
    out = joined.select("doc_id", "text_key", "n_words", "items", "spans").unionByName(plain)
    out = out.withColumns({"items": F.coalesce("items", F.expr("cast(array() as array<string>)")), "spans": F.coalesce("spans", first)})
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
