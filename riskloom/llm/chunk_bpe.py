"""Encoding and decoding of whole texts from content-defined chunks: a chunk is encoded once, joins of chunks are encoded again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe_merge import byte_letters
from .shared import as_text, ragged, text_bytes, text_slices, texts_of
from .tokenpieces import TokenIds, load

#: Bytes that a rolling hash covers, its leading bits that are zero at a cut (so 2 KB a chunk on average), the longest chunk,
#: and the bytes that are hashed at a time.
WINDOW, ZERO_BITS, LONGEST, SLICE = 48, 11, 1 << 15, 1 << 17
#: Bytes of chunks and their ids, and pieces between spaces, that a worker remembers; beyond it starts again.
MOST_BYTES, MOST_PIECES = 24 << 20, 500_000
_MULTIPLIER = 0xD1342543DE82EF95


def _mixed(n: int) -> np.ndarray:
    """n numbers of 64 bits that look random, by rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """hashes(raw): of each place the hash of the WINDOW bytes that end there, whatever stands before them."""

    def __init__(self):
        n = SLICE + WINDOW
        self.value = _mixed(256)
        with np.errstate(over="ignore"):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Where a chunk may end: behind each place whose hash starts with ZERO_BITS zeros."""
        places = []
        with np.errstate(over="ignore"):
            for at in range(0, max(0, len(raw) - WINDOW + 1), SLICE):
                part = raw[at : at + SLICE + WINDOW - 1]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[part] * self.up[: len(part)])])
                found = (sums[WINDOW:] - sums[:-WINDOW]) * self.down[: len(sums) - WINDOW]
                places.append(np.flatnonzero((found >> np.uint64(64 - ZERO_BITS)) == 0) + at + WINDOW)
        return np.concatenate(places) if places else np.zeros(0, np.int64)


_tools: dict[str, object] = {}


def _rolling() -> RollingHash:
    if "rolling" not in _tools:
        _tools["rolling"] = RollingHash()
    return _tools["rolling"]


def _sorted_set(*places: np.ndarray) -> np.ndarray:
    """Each place once, in order."""
    found = np.sort(np.concatenate(places))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def chunk_ends(raw: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Where the chunks of all rows end, in order, after a first 0.

    Cuts depend on the WINDOW bytes before them alone, move on to the start of a character, and a chunk over LONGEST bytes is
    cut again; a window never spans two rows.
    """
    at = _rolling().cuts(raw)
    row = np.searchsorted(row_at, at - WINDOW, side="right") - 1
    ends = _sorted_set(at[at <= row_at[row + 1]], row_at)
    wide = np.flatnonzero(np.diff(ends) > LONGEST)
    if len(wide):
        ends = _sorted_set(ends, *[np.arange(ends[k] + LONGEST, ends[k + 1], LONGEST) for k in wide])
    for _ in range(3):
        inner = ends < len(raw)
        middle = np.zeros(len(ends), bool)
        middle[inner] = (raw[ends[inner]] & 0xC0) == 0x80
        ends = ends + middle
    return _sorted_set(ends)


class ChunkIds:
    """ids(texts), by chunks.

    A sure place is one where a printable ASCII character stands before a space or line end. The tokenizer files that are
    read here never join over one, and what stands before it doesn't change how the text goes on: pre-tokens are matched from left to right.
    So of a chunk's ids only those before its first and behind its last sure place may be wrong, for the chunk's ends
    cut a word. A join is encoded again from a sure place of one chunk to a sure place of the next, with one span
    between sure places more on either side; it agrees if these two spans have the ids that they have in their chunks. Where it
    doesn't, or a chunk has fewer than four sure places, the chunk belongs to the join and the next chunk's span decides; in the
    end the join is the text.
    """

    def __init__(self, path: str):
        self.path, self.base = path, TokenIds(path, MOST_PIECES)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, 8), np.int64)
        self.ids_flat = np.zeros(0, np.uint32)
        self.bytes = 0

    def _learn(self, new: list[str]) -> None:
        raw, at = text_bytes(pa.array(new, pa.large_string()))
        sure = np.zeros(len(raw), bool)
        if len(raw) > 1:
            sure[1:] = ((raw[1:] == 32) | (raw[1:] == 10)) & (raw[:-1] > 32) & (raw[:-1] < 127)
        place = np.flatnonzero(sure)
        low, high = np.searchsorted(place, at[:-1] + 1), np.searchsorted(place, at[1:])
        tight = high - low >= 4
        bounds = np.zeros((len(new), 4), np.int64)
        bounds[tight] = np.stack([place[low[tight]], place[low[tight] + 1], place[high[tight] - 2], place[high[tight] - 1]], axis=1)
        spans = texts_of(raw, bounds[:, :3].ravel(), bounds[:, 1:].ravel())
        ids, ids_at = self.base.ids(spans.cast(pa.string()))
        used = len(self.ids_flat)
        made = np.zeros((len(new), 8), np.int64)
        made[:, 0] = tight
        made[:, 1:4] = ids_at[:-1].reshape(-1, 3) + used
        made[:, 4] = ids_at[3::3] + used
        made[:, 5] = bounds[:, 1] - at[:-1]
        made[:, 6] = bounds[:, 2] - at[:-1]
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, made])
        self.ids_flat = np.concatenate([self.ids_flat, ids])
        self.bytes += len(raw) + 4 * len(ids) + 160 * len(new)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        if self.bytes > MOST_BYTES:
            self._clear()
        raw, row_at = text_bytes(text)
        ends = chunk_ends(raw, row_at)
        starts, ends = ends[:-1], ends[1:]
        coded = texts_of(raw, starts, ends).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        chunk = np.array([self.known[w] for w in words], np.int64)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        row = np.searchsorted(row_at, starts, side="right") - 1
        tight = self.rows[chunk, 0].astype(bool)
        while True:
            made, wrong = self._joined(raw, row_at, starts[tight], self.rows[chunk[tight]], row[tight])
            if not len(wrong):
                return made
            tight[np.flatnonzero(tight)[wrong]] = False

    def _joined(self, raw: np.ndarray, row_at: np.ndarray, starts: np.ndarray, known: np.ndarray, row: np.ndarray):
        """((ids, offsets), chunks with which a join doesn't agree): rows from the joins and the middles of these chunks, in order."""
        n = len(row_at) - 1
        per_row = np.bincount(row, minlength=n)
        first_join = np.concatenate([[0], np.cumsum(per_row + 1)])
        before = np.arange(len(row)) + row
        begin, end = np.empty(first_join[-1], np.int64), np.empty(first_join[-1], np.int64)
        begin[first_join[:-1]], end[first_join[1:] - 1] = row_at[:-1], row_at[1:]
        begin[before + 1], end[before] = starts + known[:, 6], starts + known[:, 5]
        joins, at = self.base.ids(texts_of(raw, begin, end).cast(pa.string()))
        head, tail = known[:, 2] - known[:, 1], known[:, 4] - known[:, 3]
        fits = (at[before + 1] - at[before] >= head) & (at[before + 2] - at[before + 1] >= tail)
        ok = np.flatnonzero(fits)
        for size, mine, theirs in ((head[ok], known[ok, 1], at[before[ok] + 1] - head[ok]), (tail[ok], known[ok, 3], at[before[ok] + 1])):
            same = self.ids_flat[ragged(mine, size)] == joins[ragged(theirs, size)]
            bad = np.repeat(np.arange(len(ok)), size)[~same]
            fits[ok[bad]] = False
        wrong = np.flatnonzero(~fits)
        if len(wrong):
            return None, wrong
        kinds = first_join[-1] + len(row)
        source, size = np.empty(kinds, np.int64), np.empty(kinds, np.int64)
        of_join = np.arange(first_join[-1]) * 2 - np.repeat(np.arange(n), per_row + 1)
        of_middle = of_join[before] + 1
        source[of_join], size[of_join] = at[:-1], np.diff(at)
        source[of_middle], size[of_middle] = known[:, 2] + len(joins), known[:, 3] - known[:, 2]
        ids = np.concatenate([joins, self.ids_flat])[ragged(source, size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        return (ids, sums[np.concatenate([[0], np.cumsum(2 * per_row + 1)])]), wrong


class Decoder:
    """texts(ids, offsets) as the library's decode() without skipping special tokens: tokens with a space between, or their bytes."""

    def __init__(self, path: str):
        made = load(path)
        vocab = sorted(made.get_vocab(with_added_tokens=True).items(), key=lambda kv: kv[1])
        self.bytewise = made.decoder is not None
        letters = {c: b for b, c in enumerate(byte_letters())}
        parts = []
        for token, k in vocab:
            while len(parts) < k:
                parts.append(b"")
            plain = bytes(letters[c] for c in token) if self.bytewise and all(c in letters for c in token) else token.encode()
            parts.append(plain if self.bytewise else plain + b" ")
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(parts), np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        size = self.at[ids.astype(np.int64) + 1] - self.at[ids]
        raw = self.raw[ragged(self.at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.bytewise:
            joined = raw.tobytes()
            return pa.array([joined[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.large_string())
        return texts_of(raw, at[:-1], np.where(at[1:] > at[:-1], at[1:] - 1, at[1:]))


def _of(kind, path: str):
    key = f"{kind.__name__} {path}"
    if key not in _tools:
        _tools[key] = kind(path)
    return _tools[key]


def _content_key(text):
    """The least hash of a text's sentences: copies and near copies mostly have the same."""
    return F.array_min(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]"), lambda x: F.xxhash64(x)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of docs(doc_id, text): the ids that the library gives for the whole text, without special tokens
    added, and the text that it decodes from them with special tokens kept.

    Texts are cut into chunks by a rolling hash of their bytes, so that copies and passages that documents share give the same chunks
    wherever they stand. Rows are dealt by the least hash of their sentences, so that documents with the same content meet in a task; a large group of them
    is split by the adaptive rebalance. A worker encodes each distinct chunk once, while it remembers it (MOST_BYTES), and repairs the joins.
    A null text is an empty one, without ids; texts of any length and without a space go the same way, repeated rows give repeated
    results, a null doc_id stays null; further columns are ignored; an empty table gives an empty result.
    The file is one of the byte-pair kinds that tokenpieces reads.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made, decoder = _of(ChunkIds, path), _of(Decoder, path)
        for batch in batches:
            for part in text_slices(batch, "text", 2_000_000):
                ids, at = made.ids(as_text(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoder.texts(ids, at).cast(pa.string())], ["doc_id", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", "text", _content_key(F.col("text")).alias("content_key")).hint("rebalance", "content_key")
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
