"""Which of many values stand anywhere in many texts: a join on hashes of their starts, verified on the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed, scratch_tables
from ..shipping import ship

#: Bytes at the start of a value that are hashed: the largest that the value has. Bits of the filter of hashes, and bytes hashed at a time.
WIDTHS, FILTER_BITS, SLICE = (16, 8, 4, 2, 1), 22, 1 << 17
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2^64."""
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """At each place the hash of the `width` bytes that start there."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = _powers(_ODD, SLICE + width)
        down = _powers(pow(_ODD, -1, 1 << 64), SLICE + width)
        out = []
        for at in range(0, len(raw) - width + 1, SLICE):
            part = (raw[at : at + SLICE + width - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            part ^= part >> np.uint64(32)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
            out.append((sums[width:] - sums[:-width]) * down[: len(sums) - width])
        found = np.concatenate(out)
        return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each hash."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (hashes >> np.uint64(40)) & mask, (hashes >> np.uint64(8)) & mask


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _anchors(batches):
    """Each value with the width and hash of its start."""
    for batch in batches:
        raw, at = _bytes(batch.column("needle"))
        size = np.diff(at)
        width, anchor = np.zeros(len(size), np.int32), np.zeros(len(size), np.uint64)
        for w in sorted(WIDTHS):
            own = np.flatnonzero(size >= w)
            width[own] = w
            anchor[own] = _window_hashes(raw, w)[at[own]] if len(own) else anchor[own]
        first, second = _slots(anchor)
        yield pa.RecordBatch.from_pydict({"needle": batch.column("needle"), "width": pa.array(width), "anchor": pa.array(anchor.astype(np.int64)), "slot": pa.array(first.astype(np.int32)), "slot_": pa.array(second.astype(np.int32))})


def _hits(widths: list[int], bits: np.ndarray, longest: int, by: list[str]):
    def run(batches):
        allowed = np.unpackbits(bits).astype(bool)
        for batch in batches:
            raw, at = _bytes(batch.column("text"))
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            row_end = at[1:][row]
            for w in widths:
                found = _window_hashes(raw, w)
                first, second = _slots(found)
                place = np.flatnonzero(allowed[first] & allowed[second])
                place = place[place + w <= row_end[place]]
                if not len(place):
                    continue
                ends = np.minimum(place + longest, row_end[place])
                pieces = [raw[a:b].tobytes() for a, b in zip(place.tolist(), ends.tolist(), strict=True)]
                own = {c: batch.column(c).take(pa.array(row[place])) for c in by}
                yield pa.RecordBatch.from_pydict(own | {"width": pa.array(np.full(len(place), w, np.int32)), "anchor": pa.array(found[place].astype(np.int64)), "piece": pa.array(pieces, pa.binary())})

    return run


def standing_in(needles: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, needle): the distinct, non-empty needles(*by, needle) that some text of texts(*by, text) with the same `by` holds, byte for byte.

    The start of each needle, of one of five widths, is hashed; in one pass over the texts the hashes of all their places are held
    against a filter of fixed size that all needles fill, and places that pass are joined with the needles on the hash, where
    the bytes decide. The filter's size doesn't grow with the needles; with many of them more places reach the join, which is a shuffle by hash.
    Null and empty needles stand nowhere, a null text is an empty one.
    """
    ship(needles.sparkSession)
    by = by or []
    with scratch_tables() as keep:
        known = checkpointed(needles.select(*by, "needle").where("needle is not null and needle <> ''").distinct())
        starts = checkpointed(known.select("needle").distinct().mapInArrow(_anchors, "needle string, width int, anchor bigint, slot int, slot_ int"))
        size = starts.agg(F.max(F.octet_length("needle")), F.collect_set("width")).first()
        if size[0] is None:
            return keep(known)
        slots = starts.select("slot").union(starts.select("slot_")).distinct().toArrow().column(0).to_numpy()
        full = np.zeros(1 << FILTER_BITS, bool)
        full[slots] = True
        kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in by]
        hits = texts.select(*by, "text").mapInArrow(_hits(sorted(size[1]), np.packbits(full), size[0], by), ", ".join([*kinds, "width int, anchor bigint, piece binary"]))
        asked = starts.select("needle", "width", "anchor")
        found = hits.join(known.join(asked, "needle") if by else asked, [*by, "width", "anchor"])
        return keep(found.where(F.expr("substring(piece, 1, octet_length(needle)) = cast(needle as binary)")).select(*by, "needle").distinct())


def standing_nowhere(needles: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of needles(*by, needle, ...) whose value no text of texts(*by, text) holds; null and empty ones stay."""
    return needles.join(standing_in(needles, texts, by), [*(by or []), "needle"], "left_anti")
