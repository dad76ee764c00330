"""Best-fit packing of documents into sequences by length patterns that non-negative least squares fits to the histogram."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import as_text, binary_slices, materialise, text_slices, work_folder
from .tokenpieces import ids_of, with_end

#: Rows of a cell in which pieces of one length are numbered, at least.
CELL = 256


def patterns(present: np.ndarray, room: int) -> np.ndarray:
    """All sets of two or three present lengths that fill the room exactly, as rows (a, b, c) with a <= b <= c; a may be 0."""
    held = np.zeros(room + 1, bool)
    held[present[present <= room]] = True
    a = np.flatnonzero(held[1:]) + 1
    out = [np.zeros((0, 3), np.int64)]
    two = a[(room - a >= a)]
    two = two[held[room - two]]
    out.append(np.stack([np.zeros_like(two), two, room - two], axis=1))
    for x in a[a <= room // 3]:
        b = a[(a >= x) & (a <= (room - x) // 2)]
        b = b[held[room - x - b]]
        out.append(np.stack([np.full_like(b, x), b, room - x - b], axis=1))
    return np.concatenate(out)


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths close to the histogram in the least-squares sense.

    Accelerated projected gradient; a pattern has three places at most, so both products are gathers and sums.
    """
    if not len(rows):
        return np.zeros(0)
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))
    weight[0] = 0.0
    flat = rows.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), minlength=len(histogram)) * weight

    def backward(r: np.ndarray) -> np.ndarray:
        return (r * weight)[rows].sum(axis=1)

    target = histogram * weight
    v = np.random.default_rng(3).random(len(rows))
    for _ in range(12):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * backward(forward(y) - target), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def best_fit(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences for all counted lengths: longest first, each into the fullest sequence that takes it."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    spaces = np.zeros(room + 1, np.int64)
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                spaces[room - length] += left
                group = open_.setdefault(room - length, {})
                group[(length,)] = group.get((length,), 0) + left
                break
            space = length + int(fits[0])
            pattern, times = open_[space].popitem()
            placed = min(times, left)
            if times > placed:
                open_[space][pattern] = times - placed
            spaces[space] -= placed
            spaces[space - length] += placed
            group = open_.setdefault(space - length, {})
            group[(*pattern, length)] = group.get((*pattern, length), 0) + placed
            left -= placed
    return [(pattern, times) for space in sorted(open_) for pattern, times in open_[space].items()]


def plan(histogram: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): patterns of exact fit as often as the fit says, whole sequences, and the rest by best fit."""
    counts = histogram.astype(np.int64).copy()
    counts[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[room]:
        out.append(((room,), int(counts[room])))
        counts[room] = 0
    rows = patterns(np.flatnonzero(counts), room)
    repeats = np.floor(fit_repeats(rows, counts.astype(np.float64)) + 0.5).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        lengths = rows[k][rows[k] > 0]
        need = np.bincount(lengths, minlength=len(counts))
        used = np.flatnonzero(need)
        times = min(int(repeats[k]), int((counts[used] // need[used]).min()))
        if times:
            counts[used] -= times * need[used]
            out.append((tuple(lengths[::-1].tolist()), times))
    return out + best_fit(counts, room)


def _slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the n-th piece of a length goes: rows (length, first, sequence, offset), sorted by length and first."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    table = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(docs: DataFrame, path: str, room: int) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and its end id 0, cut into pieces of at most `room`."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        maker = ids_of(path)
        for batch in batches:
            for part in text_slices(batch, "text", 4_000_000):
                pa.default_memory_pool().release_unused()
                ids, at = with_end(*maker.ids(as_text(part.column("text"))))
                sizes = np.diff(at)
                parts = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * room
                length = np.minimum(sizes[doc] - start, room)
                for k in range(0, len(doc), 2048):
                    cut = slice(k, min(k + 2048, len(doc)))
                    first = at[doc[cut.start]] + start[cut.start]
                    last = at[doc[cut.stop - 1]] + start[cut.stop - 1] + length[cut.stop - 1]
                    bounds = np.append(at[doc[cut]] + start[cut], last) - first
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(doc[cut])), "piece": pa.array(piece[cut].astype(np.int32)), "start": pa.array(start[cut]), "length": pa.array(length[cut]), "ids": binary_slices(ids[first:last].astype("<u4"), bounds)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def pack(docs: DataFrame, path: str, room: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids, of every piece of docs(doc_id, text).

    Only documents longer than `room` ids, their end id included, are cut. A null or empty text is its end id alone.
    Pieces fill sequences without gaps from offset 0; sequence ids are 0, 1, 2 and so on. Pieces of equal length are
    interchangeable and numbered by doc_id and piece; repeated rows are pieces of their own; texts of any length are
    taken whole; further columns are ignored; an empty table gives no pieces.

    The driver sees the histogram alone, of at most `room` numbers: it makes the plan, a table whose size depends on
    `room` and not on the data. The n-th piece of a length takes the n-th place that the plan has for that length;
    pieces of a frequent length are counted in cells of bounded size.
    """
    made = token_pieces(docs, path, room)
    spark = docs.sparkSession
    out = f"{work_folder(spark)}/pieces-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(out)
    pieces = spark.read.schema(made.schema).parquet(out)
    histogram = np.zeros(room + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():
        histogram[length] = count
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, room)))
    cells = [int(-(-c // max(CELL, int(c**0.5)))) for c in histogram.tolist()]
    cell_of = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(cells), (F.col("length") + 1).cast("int")).cast("bigint"))
    rows = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), cell_of.alias("cell"), *(["ids"] if with_ids else []))
    sizes = rows.groupBy("length", "cell").count()
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sizes.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "bases")
    in_cell = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("at", F.row_number().over(in_cell)).join(bases, ["length", "cell"])
    ordered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at") - 1).alias("rank"), *(["ids"] if with_ids else []))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def place(batches):
        table = slots.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(table["key"], (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            found = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            found |= {"sequence_id": pa.array(table["sequence"][k] + rank - table["first"][k]), "offset": pa.array(table["offset"][k])}
            yield pa.RecordBatch.from_pydict(found | ({"ids": batch.column("ids")} if with_ids else {}))

    return ordered.mapInArrow(place, schema)
