"""Token ids of whole texts from cached pieces: a text is cut where a tokenizer never joins, and each piece is encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe_merge import byte_letters
from .shared import ragged

_loaded: dict[str, object] = {}
#: Pieces that one worker remembers at most; beyond it starts again.
MOST_PIECES = 1_200_000
#: The pre-token patterns of the files word_bpe and byte_bpe, the latter for pieces of Pieces.cut.
WORD_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Characters whose pieces are cut into pre-tokens here: printable ASCII and Latin letters that lower-case to one letter.
PLAIN = r"[\x{21}-\x{7E}\x{C0}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]"
#: White space in the sense of the libraries' patterns.
_SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def load(path: str):
    """The library's tokenizer of a .json file, once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def strings(text: pa.Array) -> list[str]:
    """The strings of an array without nulls, several times as fast as to_pylist."""
    return text.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """Cuts texts into pieces that the tokenizer treats each for itself.

    word_bpe drops white space, so a text is cut at spaces and line ends. byte_bpe keeps it: pieces are a line end, or
    a run without spaces with the one space before it; a text with two characters of white space side by side is
    encoded whole, as is one with the mark that parts pieces.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        self.path = path
        self.keeps_space = load(path).normalizer is None

    def cut(self, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces, row_at, whole): pieces[row_at[i]:row_at[i+1]] are row i's; whole[i]: row i is one piece."""
        if self.keeps_space:
            odd = pc.match_substring_regex(text, f"{_SPACE}{{2}}|{self.MARK}")
            plain = pc.replace_substring(pc.replace_substring(text, " ", f"{self.MARK} "), "\n", f"{self.MARK}\n{self.MARK}")
        else:
            odd = pc.match_substring(text, self.MARK)
            plain = pc.replace_substring(pc.replace_substring(text, " ", self.MARK), "\n", self.MARK)
        whole = odd.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(plain, self.MARK)
        if whole.any():
            lists = [[t] if o else p for t, p, o in zip(text.to_pylist(), cut.to_pylist(), whole, strict=True)]
            cut = pa.array(lists, pa.list_(text.type))
        row_at = cut.offsets.to_numpy().astype(np.int64)
        return cut.flatten(), row_at - row_at[0], whole


class TokenIds:
    """ids(texts): the ids of each text, by the library, as one array and the place where each text begins."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        self.pieces, self.path, self.letters, self.most = Pieces(path), path, byte_letters(), most
        self.pattern = BYTE_PRETOKENS if self.pieces.keeps_space else WORD_PRETOKENS
        self.plain = f"^ ?{PLAIN}*$|^\n$" if self.pieces.keeps_space else f"^{PLAIN}*$"
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces: plain ones as pre-tokens by the library's model, each pre-token once, the rest whole by the library."""
        words = pa.array(new, pa.string())
        plain = pc.and_(pc.match_substring_regex(words, self.plain), pc.invert(pc.match_substring(words, "<|")))
        easy = words.filter(plain)
        text = easy if self.pieces.keeps_space else pc.utf8_lower(easy)
        cut = pc.split_pattern(pc.replace_substring_regex(text, self.pattern, "\\0\x01"), "\x01")
        coded = pc.dictionary_encode(cut.flatten())
        parts, known = strings(coded.dictionary), self.known
        self._keep_parts([p for p in parts if p not in known])  # a pre-token has the ids of the piece of the same letters
        place = np.array([known[p] for p in parts], np.int64)
        rest = np.array([p not in known for p in strings(easy)], bool)
        sizes, starts = self.length[place], self.start[place]
        code = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        ids = self.flat[ragged(starts[code], sizes[code])]
        at = np.concatenate([[0], np.cumsum(sizes[code])])[cut.offsets.to_numpy()]
        self._keep(strings(easy.filter(pa.array(rest))), ids, at[:-1][rest], at[1:][rest])
        for p in strings(words.filter(pc.invert(plain))):
            found = np.array(load(self.path).encode(p, add_special_tokens=False).ids, np.uint32)
            self._keep([p], found, np.zeros(1, np.int64), np.array([len(found)]))

    def _keep_parts(self, parts: list[str]) -> None:
        """Encodes new pre-tokens by the library's model, which takes a letter for each byte."""
        tokens, letter, space, ids, sizes = load(self.path).model.tokenize, self.letters.__getitem__, self.letters[32], [], []
        for part in parts:
            if part.isascii() and part.isprintable():
                found = tokens(part.replace(" ", space)) if part else ()
            else:
                found = tokens("".join(map(letter, part.encode())))
            ids += [t.id for t in found]
            sizes.append(len(found))
        ends = np.cumsum(np.array(sizes, np.int64))
        self._keep(parts, np.array(ids, np.uint32), ends - np.array(sizes, np.int64), ends)

    def _keep(self, pieces: list[str], found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n0, n = len(self.known), len(self.known) + len(pieces)
        while n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(found)] = found
        self.start[n0:n], self.length[n0:n] = self.used + starts, ends - starts
        self.used += len(found)
        self.known.update(zip(pieces, range(n0, n), strict=True))

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, row_at, whole = self.pieces.cut(text)
        coded = pc.dictionary_encode(flat)
        words = strings(coded.dictionary)
        if len(self.known) > self.most:
            self._clear()
        get = self.known.get
        place = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(place < 0).tolist()
        if new:
            self._learn([words[k] for k in new])
            place[new] = [get(words[k]) for k in new]
        code = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        lengths = self.length[code]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged(self.start[code], lengths)], sums[row_at]


def ids_of(path: str) -> TokenIds:
    """One TokenIds a worker and file, with what it has learnt."""
    key = f"ids {path}"
    if key not in _loaded:
        _loaded[key] = TokenIds(path)
    return _loaded[key]


def with_end(ids: np.ndarray, at: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, at + np.arange(n + 1)
