"""Vector compression to one byte a part: codebooks by rounds of exact assignment, which a GNAT over the entries prunes."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import having, materialise, scratch

#: Entries of a leaf, split points of a node, and the relative slack of a distance that is held against a range.
LEAF, SPLITS, SLACK = 8, 16, 1e-9
#: Largest magnitude of a component for sums of squares that double precision holds exactly; beyond it integers of any size are used.
EXACT = 2.0**52
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class CodeRule:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries; exact for integers whose sums of squares are below 2^52, and for objects."""
    own = (points * points).sum(axis=1) if points.shape[1] else np.zeros(len(points), points.dtype)
    theirs = (entries * entries).sum(axis=1) if entries.shape[1] else np.zeros(len(entries), entries.dtype)
    return own[:, None] + theirs[None, :] - 2 * points.dot(entries.T)


class Gnat:
    """A tree over the entries of a codebook. A node has split points, each other entry belongs to the nearest one's child,
    and for every pair of a split point and a child it keeps the range of distances between them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.visited = 0
        self.root = self._build(np.arange(len(entries)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= max(LEAF, SPLITS):
            return ids
        between = squares(self.entries[ids], self.entries[ids])
        chosen = [0]
        while len(chosen) < SPLITS:
            gap = between[chosen].min(axis=0)
            if gap.max() <= 0:
                break
            chosen.append(int(gap.argmax()))
        if len(chosen) == 1:
            return ids
        away = np.sqrt(np.maximum(between[chosen], 0))
        rest = np.setdiff1d(np.arange(len(ids)), chosen)
        owner = away[:, rest].argmin(axis=0)
        children, low, high = [], [], []
        for j in range(len(chosen)):
            own = rest[owner == j]
            if len(own):
                children.append((j, self._build(ids[own])))
                low.append(away[:, own].min(axis=1) * (1 - SLACK))
                high.append(away[:, own].max(axis=1) * (1 + SLACK))
        return ids[chosen], children, np.array(low), np.array(high)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point; of entries at the same distance the lower number."""
        best, at = np.full(len(points), np.inf), np.full(len(points), len(self.entries))
        self._search(self.root, points, np.arange(len(points)), best, at)
        return at, best

    def _take(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = squares(points[rows], self.entries[ids])
        self.visited += found.size
        least = found.min(axis=1)
        first = np.where(found == least[:, None], ids[None, :], len(self.entries)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], first[better]
        return found

    def _search(self, node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self._take(node, points, rows, best, at)
            return
        splits, children, low, high = node
        away = np.sqrt(np.maximum(self._take(splits, points, rows, best, at), 0))
        nearest = away.argmin(axis=1)
        for first in (True, False):
            for k, (j, child) in enumerate(children):
                mine = np.flatnonzero((nearest == j) == first)
                reach = np.sqrt(best[rows[mine]])[:, None] * (1 + SLACK) + SLACK
                open_ = ((away[mine] - reach <= high[k]) & (away[mine] + reach >= low[k])).all(axis=1)
                self._search(child, points, rows[mine[open_]], best, at)


class Books:
    """The codebooks of all parts, with a tree each."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.most = max([0, *(abs(int(x)) for b in books for x in b.ravel())])
        self.trees = None

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error) of integer rows: the entry of each part, and the sum of their squared distances as Python integers or int64."""
        width = rows.shape[1] // len(self.books)
        most = max(self.most, int(np.abs(rows).max()) if rows.size else 0)
        small = 4 * max(1, width) * most**2 < EXACT
        codes, error = np.zeros((len(rows), len(self.books)), np.int64), np.zeros(len(rows), np.int64 if small else object)
        if small and self.trees is None:
            self.trees = [Gnat(b.astype(np.float64)) for b in self.books]
        for p, book in enumerate(self.books):
            part = rows[:, p * width : (p + 1) * width]
            if small:
                codes[:, p], least = self.trees[p].nearest(part.astype(np.float64))
                error += least.astype(np.int64)
            else:
                found = squares(part.astype(object), book.astype(object))
                codes[:, p] = [min(range(len(book)), key=r.__getitem__) for r in found]
                error += found[np.arange(len(rows)), codes[:, p]]
        return codes, error


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers: int64 where it fits, else Python integers."""
    scaled = flat.astype(np.float64)
    if not len(scaled) or np.abs(scaled).max() * scale < 2.0**62:
        return np.floor(scaled * scale).astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in scaled.tolist()], object)


def _padded(rows: np.ndarray, parts: int) -> np.ndarray:
    short = -rows.shape[1] % parts
    return np.concatenate([rows, np.zeros((len(rows), short), rows.dtype)], axis=1) if short else rows


def _rows(batch: pa.RecordBatch, width: int, rule: CodeRule) -> tuple[np.ndarray, np.ndarray]:
    """(integer rows, which rows of the batch they are): those of the width."""
    lists = batch.column("embedding")
    sizes = lists.value_lengths().fill_null(-1).to_numpy()
    own = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
    return _padded(integers(flat, rule.scale).reshape(len(own), width), rule.parts), own


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & finite)


def _sums(books: list[np.ndarray], width: int, rule: CodeRule):
    """The number and the componentwise sums of the parts that fall to each entry, one row an entry and task; sums are decimal texts of any length."""

    def run(batches):
        made = Books(books)
        step = books[0].shape[1]
        count = np.zeros((rule.parts, len(books[0])), np.int64)
        total = np.zeros((rule.parts, len(books[0]), step), object)
        for batch in batches:
            rows, _ = _rows(batch, width, rule)
            if not len(rows):
                continue
            codes, _ = made.assign(rows)
            for p in range(rule.parts):
                part, order = rows[:, p * step : (p + 1) * step], np.argsort(codes[:, p], kind="stable")
                entry, first = np.unique(codes[order, p], return_index=True)
                if part.dtype != object and step and np.abs(part).max() >= 2**40:
                    part = part.astype(object)
                count[p, entry] += np.diff(np.append(first, len(order)))
                total[p, entry] += np.add.reduceat(part[order], first, axis=0).astype(object)
        p, entry = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[p, entry]), "sums": pa.array([",".join(map(str, total[a, b])) for a, b in zip(p, entry, strict=True)], pa.string())})

    return run


def _added(table: pa.Table) -> pa.Table:
    """One row an entry: as many rows come in as tasks had the entry."""
    sums = [list(map(int, s.split(","))) if s else [] for s in table.column("sums").to_pylist()]
    total = ",".join(map(str, map(sum, zip(*sums, strict=True))))
    n = sum(table.column("n").to_pylist())
    return pa.table({"part": table.column("part")[:1].combine_chunks(), "entry": table.column("entry")[:1].combine_chunks(), "n": pa.array([n], pa.int64()), "sums": pa.array([total], pa.string())})


def train(vectors: DataFrame, rule: CodeRule = CodeRule()) -> tuple[int, list[np.ndarray]]:
    """(width, codebooks) of usable vectors(vec_id, embedding): integer matrices, one a part.

    The width is the length of the vector with the smallest vec_id. The codebooks start as the parts of the
    rule.entries smallest vec_ids; each round gives every part to its nearest entry and replaces an entry by the floor of
    the mean of its parts. A round is one pass over the vectors; the driver holds the entries and their sums only.
    Rows with a null vec_id never start an entry. Of rows with one vec_id the smaller vector comes first.
    Without rows the codebooks are empty.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding")
    first = rows.where("vec_id is not null").orderBy("vec_id", "embedding")
    head = first.limit(1).collect()
    if not head:
        return 0, [np.zeros((0, 0), np.int64) for _ in range(rule.parts)]
    width = len(head[0]["embedding"])
    start = [r["embedding"] for r in first.where(F.size("embedding") == width).limit(rule.entries).collect()]
    whole = _padded(integers(np.array(start, np.float64).reshape(-1), rule.scale).reshape(len(start), width), rule.parts)
    step = whole.shape[1] // rule.parts
    books = [whole[:, p * step : (p + 1) * step] for p in range(rule.parts)]
    shape = "part int, entry int, n bigint, sums string"
    for _ in range(rule.rounds):
        found = rows.mapInArrow(_sums(books, width, rule), shape).groupBy("part", "entry").applyInArrow(_added, shape)
        books = [b.copy() for b in books]
        for r in found.collect():
            mean = [s // r["n"] for s in map(int, r["sums"].split(","))] if r["sums"] else []
            if any(abs(x) >= 2**62 for x in mean):
                books[r["part"]] = books[r["part"]].astype(object)
            books[r["part"]][r["entry"]] = mean
    return width, books


def encode(vectors: DataFrame, width: int, books: list[np.ndarray], rule: CodeRule = CodeRule()) -> DataFrame:
    """(vec_id, label, code, error) of usable vectors(vec_id, embedding, label): two hex digits a part, and the squared distance to
    the entries, at most 2^63 - 1. A vector of another length than width has a null code and error."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches):
        made, pairs = Books(books), np.array([f"{k:02x}".encode() for k in range(256)])
        for batch in batches:
            rows, own = _rows(batch, width, rule)
            code, error = np.full(len(batch), None, object), np.full(len(batch), None, object)
            if len(rows) and len(books[0]):
                codes, found = made.assign(rows)
                text = pairs[codes].view(f"S{2 * rule.parts}").ravel().astype(str)
                code[own], error[own] = text, [min(int(e), LARGEST) for e in found]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(vectors: DataFrame, rule: CodeRule = CodeRule()) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, code, error, label_error), codebooks) of vectors(vec_id, embedding, label).

    Rows whose vector is null, or holds a null or non-finite component, are left out; all others have a row, repeated
    ones too. label_error adds the errors of equal labels, nulls together, up to 2^63 - 1. Vectors are cut into equal
    consecutive parts, after zeros at the end where the length needs them. Further columns are ignored; an empty table gives
    an empty result. Components of any finite size are exact. The nearest entry is found in a GNAT over the codebook: a
    child is left out only where the triangle inequality, with rounded distances on the safe side, puts all its entries
    strictly beyond the best one, so ties are always seen and decided on whole numbers.
    """
    kept = usable(vectors)
    width, books = train(kept, rule)
    with scratch() as keep:
        rows = materialise(encode(kept, width, books, rule), "codes")
        at = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0).cast(rows.schema["label"].dataType)).alias("of_label")]
        labels = materialise(rows.groupBy(*at).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("bigint").alias("label_error")), "label-errors")
        out = having(rows.select("vec_id", "code", "error", *at), labels, ["no_label", "of_label"], "left")
        return keep(out.select("vec_id", "code", "error", "label_error"), "vector-codes"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimal numbers by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
