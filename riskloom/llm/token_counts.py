"""Token counts of whole texts by rank-synchronous merging of their distinct pre-tokens."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe_merge import RankMerger
from .shared import as_text, text_slices
from .tokenpieces import MOST_PIECES, PLAIN, WORD_PRETOKENS, Pieces

#: The added tokens of the word_bpe file.
ADDED = ["<|startoftext|>", "<|endoftext|>"]
_workers: dict[str, "PieceCounts"] = {}


def _general(piece: str) -> tuple[int, list[str]]:
    """The number of added tokens in a piece, and its other pre-tokens after normalisation."""
    import regex

    pattern = regex.compile(WORD_PRETOKENS)
    parts = regex.split("|".join(map(regex.escape, ADDED)), piece)
    out: list[str] = []
    for part in parts:
        low = "".join(c.lower() for c in regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part)))
        out += pattern.findall(low)
    return len(parts) - 1, out


class PieceCounts:
    """Counts of pieces between spaces, each counted once and remembered."""

    def __init__(self, path: str):
        self.pieces, self.merger = Pieces(path), RankMerger(path)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        words = pa.array(new, pa.string())
        plain = pc.and_(pc.match_substring_regex(words, f"^{PLAIN}*$"), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        easy = words.filter(pa.array(plain))
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(easy), WORD_PRETOKENS, "\\0\x01"), "\x01")
        lists, extra = [cut.flatten()], []
        sizes = np.zeros(len(new), np.int64)
        sizes[plain] = np.diff(cut.offsets.to_numpy())
        added = np.zeros(len(new), np.int64)
        for i in np.flatnonzero(~plain).tolist():
            added[i], found = _general(new[i])
            sizes[i] = len(found)
            extra += found
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        lists.append(pa.array(extra, pa.string()))
        coded = pc.dictionary_encode(pa.concat_arrays(lists))
        parts = coded.dictionary
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1].astype(np.int64) if len(parts) else np.zeros(1, np.int64)
        raw = np.frombuffer(parts.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        _, at = self.merger.merge(raw, offsets)
        each = np.diff(at)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(sizes[order])
        total = np.empty(len(new), np.int64)
        total[order] = sums[ends] - sums[ends - sizes[order]]
        self.known.update(zip(new, (total + added).tolist(), strict=True))

    def counts(self, text: pa.Array) -> np.ndarray:
        flat, row_at, _ = self.pieces.cut(text)
        coded = pc.dictionary_encode(flat)
        words = coded.dictionary.to_pylist()
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        each = np.array([self.known[w] for w in words], np.int64)
        each = each[coded.indices.to_numpy()] if len(coded) else each
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[row_at[1:]] - sums[row_at[:-1]]


def _counts_of(path: str) -> PieceCounts:
    if path not in _workers:
        _workers[path] = PieceCounts(path)
    return _workers[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text), for a word-level byte-pair file.

    A null text counts as an empty one: no bytes, no tokens. Counts are those of the library on the whole text,
    without begin and end; the strings of added tokens count one each. Texts are cut at spaces and line ends, which
    the tokenizer drops; distinct pieces are normalised and cut into pre-tokens, whose merges run batch by batch on
    ragged arrays. Very long texts and words go the same way; repeated rows give repeated results; further columns
    are ignored; an empty table gives an empty result. No shuffle; a worker remembers a bounded number of pieces.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made = _counts_of(path)
        for batch in batches:
            for part in text_slices(batch, "text", 8_000_000):
                text = as_text(part.column("text"))
                n = made.counts(text)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

