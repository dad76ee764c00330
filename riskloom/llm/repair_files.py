"""Token ids in files of Re-Pair grammars: blocks of whole documents with rules, expansion lengths and symbols.

A file is Parquet with one row a block, in the order of (shard, block), documents in ascending doc_id:

    shard, block   int            place in the order of all blocks
    doc_ids        array<bigint>  the documents of the block
    doc_tokens     array<int>     ids of each, with the end id
    doc_symbols    array<int>     symbols of each; no rule spans two documents
    first_rule     int            the symbol of the first rule; first_rule - 1 stands for the end of a document
    rules          binary         two little-endian unsigned 32-bit symbols for each rule
    lengths        binary         little-endian unsigned 32-bit: ids that each rule expands to
    symbols        binary         little-endian symbols of `width` bytes
    width          int            2 or 4

A rule refers to ids and earlier rules only, so a block, a document or a range of a document's ids is decoded from
its own row; the lengths tell where a range begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import as_text, binary_slices, ragged, text_slices
from .tokenpieces import ids_of, load, with_end

BLOCK_SCHEMA = "shard int, block int, doc_ids array<bigint>, doc_tokens array<int>, doc_symbols array<int>, first_rule int, rules binary, lengths binary, symbols binary, width int"


@dataclass(frozen=True)
class GrammarRule:
    """rounds of at most `pairs` new rules each; a pair needs `least` occurrences; a block is closed at block_ids ids."""

    rounds: int = 6
    pairs: int = 1500
    least: int = 8
    block_ids: int = 1 << 21
    counter_bits: int = 20


def _frequent_pairs(symbols: np.ndarray, end: int, rule: GrammarRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, which): frequent pairs, where they occur, and which of them occurs there.

    Pairs are counted in a hashed table; each of its fullest places names the pair that occurs there first.
    """
    left, right = symbols[:-1], symbols[1:]
    slot = left * np.uint32(0x9E3779B1)
    slot += right * np.uint32(0x85EBCA77)
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(0xC2B2AE3D)
    slot >>= np.uint32(32 - rule.counter_bits)
    counts = np.bincount(slot, minlength=1 << rule.counter_bits)
    full = np.flatnonzero(counts >= rule.least)
    if len(full) > rule.pairs:
        full = full[np.argpartition(-counts[full], rule.pairs)[: rule.pairs]]
    number = np.full(1 << rule.counter_bits, -1, np.int16)
    number[full] = np.arange(len(full))
    which = number[slot]
    at = np.flatnonzero(which >= 0)
    which = which[at].astype(np.int64)
    own = (left[at] != end) & (right[at] != end)
    at, which = at[own], which[own]
    first = np.full(len(full), -1)
    first[which[::-1]] = at[::-1]
    same = (left[at] == left[first[which]]) & (right[at] == right[first[which]])
    at, which = at[same], which[same]
    used = np.flatnonzero(np.bincount(which, minlength=len(full)) >= rule.least)
    place = np.full(len(full), -1)
    place[used] = np.arange(len(used))
    which = place[which]
    pairs = np.stack([left[first[used]], right[first[used]]], axis=1).astype(np.uint32)
    return pairs, at[which >= 0], which[which >= 0]


def compress(ids: np.ndarray, doc_at: np.ndarray, first_rule: int, rule: GrammarRule = GrammarRule()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, symbols of each document) of documents ids[doc_at[i]:doc_at[i+1]], each with its end id last."""
    end = first_rule - 1
    symbols = ids.astype(np.uint32)
    symbols[doc_at[1:] - 1] = end
    rules, lengths, top = [np.zeros((0, 2), np.uint32)], np.ones(first_rule, np.uint32), first_rule
    for _ in range(rule.rounds):
        if len(symbols) < 2:
            break
        new, at, which = _frequent_pairs(symbols, end, rule)
        if not len(new):
            break
        run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, which = at[place % 2 == 0], which[place % 2 == 0]
        symbols[at] = top + which
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules.append(new)
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
        top += len(new)
    ends = np.flatnonzero(symbols == end)
    return np.concatenate(rules), lengths[first_rule:], symbols, np.diff(np.concatenate([[-1], ends]))


def expansions(rules: np.ndarray, lengths: np.ndarray, first_rule: int, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(flat, start): the ids of symbol s are flat[start[s]:start[s+1]]."""
    size = np.concatenate([np.ones(first_rule, np.int64), lengths.astype(np.int64)])
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(start[-1], np.uint32)
    flat[:first_rule] = np.arange(first_rule)
    flat[first_rule - 1] = end_id
    for k, (a, b) in enumerate(rules.tolist(), first_rule):
        cut = start[k] + size[a]
        flat[start[k] : cut] = flat[start[a] : start[a + 1]]
        flat[cut : start[k + 1]] = flat[start[b] : start[b + 1]]
    return flat, start


def decode_symbols(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    flat, start = table
    symbols = symbols.astype(np.int64)
    return flat[ragged(start[symbols], start[symbols + 1] - start[symbols])]


def block_parts(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(symbols, expansion table, first symbol of each document) of a block's row."""
    symbols = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4")
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    table = expansions(rules, np.frombuffer(row["lengths"], "<u4"), row["first_rule"])
    return symbols, table, np.concatenate([[0], np.cumsum(np.asarray(row["doc_symbols"], np.int64))])


def read_ids(row: dict, doc: int, start: int = 0, stop: int | None = None, end_id: int = 0) -> np.ndarray:
    """ids start to stop of the doc-th document of a block; the lengths of rules tell which of them hold these ids, and only those are taken apart."""
    symbols = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4")
    rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4")
    first_rule, at = row["first_rule"], np.concatenate([[0], np.cumsum(np.asarray(row["doc_symbols"], np.int64))])
    own = symbols[at[doc] : at[doc + 1]].astype(np.int64)
    size = np.ones(len(own), np.int64)
    ruled = own >= first_rule
    size[ruled] = lengths[own[ruled] - first_rule]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
    first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
    todo, out, place = own[first : last + 1][::-1].tolist(), [], int(ends[first - 1]) if first else 0
    while todo and place < stop:
        s = todo.pop()
        n = int(lengths[s - first_rule]) if s >= first_rule else 1
        if s >= first_rule and place + n > start:
            todo += [int(rules[s - first_rule, 1]), int(rules[s - first_rule, 0])]
            continue
        if place >= start:
            out.append(end_id if s == first_rule - 1 else s)
        place += n
    return np.array(out, np.uint32)


def _encode(path: str, rule: GrammarRule):
    def block_row(number: int, doc_ids: list, ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(sizes)
        flat = np.concatenate(ids)
        first_rule = load(path).get_vocab_size() + 1
        rules, lengths, symbols, doc_symbols = compress(flat, np.concatenate([[0], np.cumsum(tokens)]), first_rule, rule)
        width = 2 if first_rule + len(rules) < 1 << 16 else 4
        one = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_pydict({
            "shard": one(TaskContext.get().partitionId(), pa.int32()), "block": one(number, pa.int32()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.concat_arrays(doc_ids).cast(pa.int64())),
            "doc_tokens": one(tokens, pa.list_(pa.int32())), "doc_symbols": one(doc_symbols, pa.list_(pa.int32())), "first_rule": one(first_rule, pa.int32()), "rules": one(rules.astype("<u4").tobytes(), pa.binary()),
            "lengths": one(lengths.astype("<u4").tobytes(), pa.binary()), "symbols": one(symbols.astype(f"<u{width}").tobytes(), pa.binary()), "width": one(width, pa.int32()),
        })

    def run(batches):
        number, held, doc_ids, ids, sizes = 0, 0, [], [], []
        maker = ids_of(path)
        for batch in batches:
            for part in text_slices(batch, "text", 6_000_000):
                flat, at = with_end(*maker.ids(as_text(part.column("text"))))
                doc_ids.append(part.column("doc_id"))
                ids.append(flat)
                sizes.append(np.diff(at))
                held += len(flat)
                if held >= rule.block_ids:
                    yield block_row(number, doc_ids, ids, sizes)
                    number, held, doc_ids, ids, sizes = number + 1, 0, [], [], []
        if held:
            yield block_row(number, doc_ids, ids, sizes)

    return run


def write_ids(docs: DataFrame, path: str, out: str, rule: GrammarRule = GrammarRule()) -> None:
    """Writes the ids of docs(doc_id, text), by the library of the tokenizer file `path` and with id 0 after each
    document, to the folder `out`, in ascending doc_id order over shards and blocks.

    A null text is an empty one: its end id only. Documents with equal ids keep an arbitrary order; a null doc_id
    comes first; texts of any length are one document of one block; further columns are ignored; an empty table
    writes no block. Documents are dealt by ranges of doc_id, a shard each, and encoded block by block.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_encode(path, rule), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(out)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            symbols, table, _ = block_parts(row)
            tokens = np.asarray(row["doc_tokens"], np.int64)
            at = np.concatenate([[0], np.cumsum(tokens)])
            ids = decode_symbols(symbols, table)
            if len(ids) != at[-1]:
                raise ValueError("a block does not expand to its documents")
            n = len(tokens)
            for k in range(0, n, 4096):
                end = min(n, k + 4096)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(end - k, row["shard"], np.int32)), "block": pa.array(np.full(end - k, row["block"], np.int32)), "doc_id": pa.array(row["doc_ids"][k:end], pa.int64()),
                    "within": pa.array(at[k:end]), "n_tokens": pa.array(tokens[k:end]), "ids": binary_slices(ids[at[k] : at[end]].astype("<u4"), at[k : end + 1] - at[k]),
                })


def read_documents(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """(doc_id, start, n_tokens) and ids, or instead the named columns derived from ids, from files of write_ids.

    ids are little-endian unsigned 32-bit; start is the number of ids of all documents before.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("shard", "block", F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    bases = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    docs = blocks.mapInArrow(_decode, "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids binary")
    docs = docs.select("shard", "block", "doc_id", "within", "n_tokens", *[c.alias(k) for k, c in (derived or {"ids": F.col("ids")}).items()])
    return docs.join(bases, ["shard", "block"]).drop("shard", "block").withColumn("start", F.col("base") + F.col("within")).drop("base", "within")

