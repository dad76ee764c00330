"""Byte-pair merges of many pre-tokens at once, in rank order, on ragged numpy arrays."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class RankMerger:
    """The merges of a tokenizer .json file with byte letters, held in a table of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        self.bits = 20
        self.key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.rank = np.full((1 << self.bits) + 64, _NONE, np.int32)
        self.probes = 1
        for rank, (k, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            step = 0
            while self.key[at + step] >= 0 and self.key[at + step] != k:
                step += 1
            if self.key[at + step] < 0:
                self.key[at + step], self.rank[at + step] = k, rank
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the largest number where there is no such merge."""
        keys = (left << 20) | right
        at = self._slot(keys)
        found = self.key[at]
        out = np.where(found == keys, self.rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            found = self.key[at[open_] + step]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[at[open_[hit]] + step]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens given as UTF-8 bytes and offsets.

        In each round every pre-token merges all places of its lowest-ranked pair at once (overlapping places from
        the left); a pre-token without a pair left is finished and leaves the arrays.
        """
        sizes = np.diff(offsets)
        symbols = self.inner[raw]
        filled = np.flatnonzero(sizes)
        symbols[offsets[1:][filled] - 1] = self.last[raw[offsets[1:][filled] - 1]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1][inside] = self.ranks(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            active = best != _NONE
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, best = symbols[active], owner[active], rank[active], best[active]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            near = np.flatnonzero(np.diff(at) == 1)
            if len(near):
                run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            symbols[at] = self.result[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
