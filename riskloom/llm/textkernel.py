"""Words of whole texts as 64-bit hashes, computed on UTF-8 bytes with numpy inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_MUL), -1, 1 << 64))
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_LETTERS = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but space and \t to \r; and letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_STEP = 1 << 19
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= _A
    h ^= h >> U(27)
    h *= _B
    h ^= h >> U(31)
    return h


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _STEP + 4096)
        out = []
        for base in (_MUL, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 8 * _STEP:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


class Words:
    """hash, start and end (bytes in the concatenated text) of each word; row_at[i] is the first word of row i."""

    def __init__(self, text: pa.Array, kind: np.ndarray):
        text = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
        n = len(text)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
        data = text.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.raw, self.offsets = raw, offsets - offsets[0]
        low = _LOWER[raw]
        word = kind[low]
        first, last = word.copy(), word.copy()
        if len(raw):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            edge = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
            first[edge] = word[edge]
            last[edge - 1] = word[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes(low)

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        out, k = np.empty(len(self.start), np.uint64), 0
        while k < len(self.start):
            at = self.start[k]
            end = max(int(np.searchsorted(self.end, at + _STEP, side="right")), k + 1)
            stop = self.end[end - 1]
            power, inverse = _powers_up_to(stop - at)
            sums = np.empty(stop - at + 1, np.uint64)
            sums[0] = 0
            np.add.accumulate(_LETTERS[low[at:stop]] * power[: stop - at], out=sums[1:])
            s, e = self.start[k:end] - at, self.end[k:end] - at
            out[k:end] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _A)
            k = end
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.counts())


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Order-aware hash of several equally long columns of hashes."""
    h = mix(parts[0] + U(len(parts)))
    for p in parts[1:]:
        h = mix(h * _MUL + p)
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n following words, at each place that has n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    return chain([h[i : len(h) - n + 1 + i] for i in range(n)])


def least_places(value: np.ndarray, reach: int) -> np.ndarray:
    """Of each `reach` following values the place of the least; of equal ones the first."""
    place, wide = np.arange(len(value)), 1
    while wide < reach:
        step = min(wide, reach - wide)
        a, b = value[:-step], value[step:]
        later = b < a
        value, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        wide += step
    return place


#: Low bits of a value that give way to its place, and values that are taken at once.
_PLACE_BITS = 22


def last_least_places(value: np.ndarray, reach: int) -> np.ndarray:
    """Of each `reach` following 64-bit values the place of the one with the least leading 42 bits; of equal ones the last."""
    most, out = np.int64((1 << _PLACE_BITS) - 1), [np.zeros(0, np.int64)]
    for at in range(0, len(value) - reach + 1, int(most) - reach):
        part = value[at : at + int(most)]
        least, wide = (part & ~U(most)) | np.arange(most, most - len(part), -1, np.int64).view(U), 1
        while wide < reach:
            step = min(wide, reach - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        out.append((most - (least[: int(most) - reach] & U(most)).view(np.int64)) + at)
    return np.concatenate(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words the whole sequence as one; none without words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, n if len(h) >= n else len(h)))
