"""Passages that repeat across documents: MinHash bands of paragraphs, exact Jaccard, components; and what to cut."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .minhash_links import NearRule, band_keys, low_bytes, near_groups
from .shared import as_text, binary_rows, binary_slices, drop_table, having, leave_tokenizers, ragged, runs_of, scratch, text_slices
from .shared import materialise_few as materialise
from .textkernel import NOT_SPACE, U, Words, grams, last_least_places, mix


@dataclass(frozen=True)
class PassageRule:
    """near: the rule for paragraphs. least_words: of a line that is a paragraph. window: words of the paragraphs that lie
    anywhere in a text; of every `reach` following places one begins such a window. beyond: words that a cut grows at most
    on either side, where the first occurrence goes on alike. A repeat of window + reach words always holds a window."""

    near: NearRule = NearRule(words=5, percent=80, bands=4, rows=2)
    least_words: int = 25
    window: int = 25
    reach: int = 25
    beyond: int = 50


_SALT = U(0x2545F4914F6CDD1D)


class Paragraphs:
    """Lines of at least least_words words, and windows that begin where the words themselves say, of a batch of texts.

    no (within the text) is twice the first word's number, and one more for a line; size is in words.
    """

    def __init__(self, text: pa.Array, rule: PassageRule, asked: list | None = None):
        self.w, self.rule = Words(text, NOT_SPACE), rule
        self.row = self.w.rows()
        line_start, line_size = self._lines()
        window_start = self._windows()
        start = np.concatenate([window_start, line_start])
        size = np.concatenate([np.full(len(window_start), rule.window, np.int64), line_size])
        kind = np.concatenate([np.zeros(len(window_start), np.int64), np.ones(len(line_start), np.int64)])
        row = self.row[start]
        no = 2 * (start - self.w.row_at[row]) + kind
        order = np.lexsort((no, row))
        self.start, self.size, self.of_row, self.no = start[order], size[order], row[order], no[order]
        if asked is not None:
            base = np.int64(2 * (int(self.w.counts().max()) if len(self.w.counts()) else 0) + 2)
            known = np.array([r * base + v for r, own in enumerate(asked) for v in own if v < base], np.int64)
            held = np.isin(self.of_row * base + self.no, known)
            self.start, self.size, self.of_row, self.no = self.start[held], self.size[held], self.of_row[held], self.no[held]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.w.raw == 10)
        line = np.searchsorted(breaks, self.w.start)
        new = np.ones(len(line), bool)
        if len(line):
            new[1:] = (self.row[1:] != self.row[:-1]) | (line[1:] != line[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(line)))
        long = size >= self.rule.least_words
        return start[long], size[long]

    def _windows(self) -> np.ndarray:
        """First words of windows: of every `reach` following places the last one with the least hash of three words.

        Which place it is depends on these words only, so equal passages begin windows at equal places.
        """
        reach, counts = self.rule.reach, self.w.counts()
        places = np.maximum(counts - self.rule.window + 1, 0)
        at = ragged(self.w.row_at[:-1], places)
        if not len(at):
            return at
        value = mix(grams(self.w.hash, 3) + _SALT)[at]
        first = np.concatenate([[0], np.cumsum(places)])
        chosen = [np.zeros(0, np.int64)]
        if len(value) >= reach:
            found = last_least_places(value, reach)[ragged(first[:-1], np.maximum(places - reach + 1, 0))]
            chosen.append(found[np.diff(found, prepend=-1) > 0])
        for wide in np.unique(places[(places > 0) & (places < reach)]).tolist():
            chosen.append(last_least_places(value, wide)[first[:-1][places == wide]])
        return np.sort(at[np.concatenate(chosen)])

    def signatures(self) -> np.ndarray:
        """The minima of each paragraph's shingles; where shingles repeat they change nothing."""
        a, b = self.rule.near.multipliers()
        out = np.zeros((len(self.start), len(a)), np.uint32)
        if len(self.start):
            x = np.append((mix((grams(self.w.hash, self.rule.near.words) >> U(20)) + _SALT) >> U(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
            ends = np.stack([self.start, np.minimum(self.start + self.size - self.rule.near.words + 1, len(x) - 1)], axis=1).ravel()
            for i in range(len(a)):
                out[:, i] = np.minimum.reduceat(x * a[i] + b[i], ends)[::2]
        return out

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(paragraphs, bands): each band of each paragraph, but once where paragraphs of a text that overlap share it."""
        bands = band_keys(self.signatures(), self.rule.near).ravel()
        own = np.repeat(np.arange(len(self.start)), self.rule.near.bands)
        mixed = bands.view(U) + self.of_row[own].view(U) * _SALT  # equal where text and band are
        order = np.argsort(mixed)
        same = np.zeros(len(own), bool)
        same[1:] = mixed[order[1:]] == mixed[order[:-1]]
        same[:-1] |= same[1:]
        again = np.sort(order[same])
        again = again[np.lexsort((self.start[own[again]], bands[again], self.of_row[own[again]]))]
        a, b = again[:-1], again[1:]
        twice = (self.of_row[own[a]] == self.of_row[own[b]]) & (bands[a] == bands[b]) & (self.start[own[b]] < self.start[own[a]] + self.size[own[a]])
        first = np.ones(len(own), bool)
        first[b[twice]] = False
        return own[first], bands[first]

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, offsets): the sorted distinct shingles (44 bits) of each paragraph."""
        g = grams(self.w.hash, self.rule.near.words) >> U(20)
        counts = self.size - self.rule.near.words + 1
        out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(counts), 1 << 16):
            n = counts[at : at + (1 << 16)]
            own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            both = np.sort((own << U(44)) | g[ragged(self.start[at : at + (1 << 16)], n)])
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            out.append(both & U((1 << 44) - 1))
            sizes.append(np.bincount((both >> U(44)).astype(np.int64), minlength=len(n)))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def keys(self, values: np.ndarray, at: np.ndarray) -> pa.Array:
        """A 16-byte digest of each set."""
        key = np.zeros((len(at) - 1, 2), np.uint64)
        if len(key):
            n, mixed = np.diff(at).astype(np.uint64), mix(values + _SALT)
            key[:, 0] = mix(np.add.reduceat(mixed, at[:-1]) + n)
            key[:, 1] = mix(np.add.reduceat(mix(mixed ^ _SALT), at[:-1]) ^ n)
        return binary_rows(key)


#: Cells that bands are dealt to by their leading bits; bands that a worker deals at once; bytes of bands in which repeats are sought at once.
CELLS, BLOCK, TABLE = 2048, 1 << 17, 4 << 20


def _dealt(bands: np.ndarray, row: np.ndarray, no: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """(cell, bands, ids, nos): the bands of a block by cell, with the doc_id and no of their paragraphs.

    A band that the block holds several times is one entry of its own cell, however many they are; all of them go to another
    cell as well, which changes from block to block, where they find each other.
    """
    order = np.argsort(bands.view(U))
    bands, row, no = bands[order], row[order], no[order]
    fresh = np.concatenate([[True], bands[1:] != bands[:-1]])
    once, again = np.flatnonzero(fresh), np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    cell = (((bands.view(U) >> U(32)) * U(CELLS)) >> U(32)).astype(np.int64)
    cell = np.concatenate([cell[once], (cell[again] + 1 + int(bands[0]) % CELLS) % CELLS]).astype(np.uint16)
    order = np.argsort(cell, kind="stable")
    cell, pick = cell[order], np.concatenate([once, again])[order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    until = np.append(begin, len(pick))
    return pa.RecordBatch.from_pydict({
        "cell": cell[begin].astype(np.int32), "bands": binary_slices(bands[pick], until),
        "ids": pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), ids.take(pa.array(row[pick]))), "nos": binary_slices(no[pick].astype(np.uint32), until),
    })


def _band_rows(rule: PassageRule):
    """The bands of all paragraphs, dealt to cells."""

    def run(batches):
        leave_tokenizers()
        for batch in batches:
            held, size, at = [], 0, 0
            for part in text_slices(batch, "text"):
                p = Paragraphs(as_text(part.column("text")), rule)
                own, bands = p.bands()
                held.append((bands, at + p.of_row[own], p.no[own]))
                at, size = at + len(part), size + len(bands)
                if size and (size >= BLOCK or at == len(batch)):
                    yield _dealt(*(np.concatenate(c) for c in zip(*held, strict=True)), batch.column("doc_id"))
                    held, size = [], 0

    return run


def _shared_rows(batches):
    """(doc_id, no) of the paragraphs with a band that its cell holds more than once, from rows in the order of cells."""

    def found(tables: list[pa.Table]):
        table = pa.concat_tables(tables).combine_chunks()
        (bands, nos), ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("bands", np.uint64), ("nos", np.uint32))), table.column("ids").combine_chunks().flatten()
        order = np.argsort(bands)
        same = bands[order[1:]] == bands[order[:-1]]
        shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        return pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(shared)), "no": nos[shared].astype(np.int64)})

    held, size = [], 0
    for table in runs_of(batches, ["cell"]):
        held.append(table)
        size += table.column("bands").nbytes
        if size >= TABLE:
            yield found(held)
            held, size = [], 0
    if held:
        yield found(held)


def _paragraph_rows(rule: PassageRule):
    """The asked paragraphs of each text: key, number of shingles, bands, signature and shingles."""

    def run(batches):
        leave_tokenizers()
        for batch in batches:
            for part in text_slices(batch, "text"):
                p = Paragraphs(as_text(part.column("text")), rule, part.column("asked").to_pylist())
                values, at = p.sets()
                sig = p.signatures()
                bands = band_keys(sig, rule.near)
                of = pa.array(p.of_row)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(of), "text_key": part.column("text_key").take(of), "no": p.no, "size": p.size, "key": p.keys(values, at), "n": np.diff(at).astype(np.int32),
                    "bands": pa.ListArray.from_arrays(pa.array((np.arange(len(bands) + 1) * rule.near.bands).astype(np.int32)), pa.array(bands.ravel())),
                    "sig": binary_rows(low_bytes(sig)), "shingles": binary_slices(values, at),
                })

    return run


#: Words inside a paragraph that show how it lies beside its first occurrence, and by how many words the two may be shifted.
INNER, SHIFT = 16, 8


def _side_rows(rule: PassageRule):
    """The words before (side 0) or from (side 1) each asked place on, as 32-bit hashes from the near one to the far one;
    INNER words on the other side of the place come first, and SHIFT words more on either end."""

    def run(batches):
        far = np.arange(-INNER - SHIFT, rule.beyond + SHIFT)
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(as_text(part.column("text")), NOT_SPACE)
                asked = part.column("asked")
                row = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
                flat = asked.flatten()
                place, side = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                at = (w.row_at[row] + place)[:, None] + np.where(side[:, None] == 0, -1 - far, far)
                inside = (at >= w.row_at[row][:, None]) & (at < w.row_at[row + 1][:, None])
                words = np.zeros(at.shape, np.uint32)
                words[inside] = (w.hash[at[inside]] >> U(33)).astype(np.uint32) + np.uint32(1)
                of = pa.array(row)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(of), "text_key": part.column("text_key").take(of), "place": place, "side": side.astype(np.int32), "words": binary_rows(words)})

    return run


def _grown(beyond: int):
    """How many words on a cut goes: as far as both sides are alike, shifted so that the most inner words agree."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(len(batch), beyond + INNER + 2 * SHIFT) for c in ("words", "first_words"))
            own = a[:, SHIFT : SHIFT + INNER + beyond]
            alike, most = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for shift in sorted(range(-SHIFT, SHIFT + 1), key=abs):
                same = (own == b[:, SHIFT + shift : SHIFT + shift + INNER + beyond]) & (own != 0)
                agree = same[:, :INNER].sum(axis=1)
                better = agree > most
                alike = np.where(better, np.cumprod(same[:, INNER:], axis=1).sum(axis=1), alike)
                most = np.where(better, agree, most)
            start, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            left = batch.column("side").to_numpy(zero_copy_only=False) == 0
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "start": np.where(left, start - alike, start).astype(np.int64), "end": np.where(left, end, end + alike).astype(np.int64)})

    return run


def _merged(ranges: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_rows(columns: list[str]):
    """Rows with these columns, the text that stays (null where nothing goes), and the spans that go, in characters of the text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(as_text(part.column("text")), NOT_SPACE)
                raw, kept, found = w.raw.tobytes(), [], []
                for r, ranges in enumerate(part.column("ranges").to_pylist()):
                    first, own = int(w.row_at[r]), int(w.offsets[r + 1])
                    at, chars, pieces, rows = int(w.offsets[r]), 0, [], []
                    for a, b in _merged(ranges or []):
                        s, e = int(w.start[first + a]), int(w.end[first + b - 1])
                        pieces.append(raw[at:s])
                        chars += len(raw[at:s].decode("utf-8", "replace"))
                        length = len(raw[s:e].decode("utf-8", "replace"))
                        rows.append({"start": chars, "end": chars + length, "n_words": b - a})
                        chars, at = chars + length, e
                    pieces.append(raw[at:own])
                    kept.append(b"".join(pieces).decode("utf-8", "replace") if rows else None)
                    found.append(rows)
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in columns}, "kept_text": pa.array(kept, pa.string()), "spans": pa.array(found, kind)})

    return run


def _flags(rows: DataFrame, rule: PassageRule) -> DataFrame:
    """(doc_id, text_key, no, size, first) of the paragraphs that are not the first occurrence of their cluster."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select("doc_id", "text").mapInArrow(_band_rows(rule), f"cell int, bands binary, ids array<{kind}>, nos binary").repartition("cell").sortWithinPartitions("cell")
    shared = dealt.mapInArrow(_shared_rows, f"doc_id {kind}, no bigint").repartition("doc_id").distinct()
    lists = materialise(shared.groupBy("doc_id").agg(F.collect_list("no").alias("asked")), "asked-lists")
    texts = having(rows, materialise(lists.select("doc_id"), "asked-ids"), "doc_id").join(lists, "doc_id")
    made = texts.select("doc_id", "text_key", "text", "asked").mapInArrow(_paragraph_rows(rule), f"doc_id {kind}, text_key bigint, no bigint, size bigint, key binary, n int, bands array<bigint>, sig binary, shingles binary")
    units = materialise(made, "paragraphs", "zstd")
    drop_table(lists)
    places = materialise(units.select("doc_id", "text_key", "no", "size", "key"), "places")
    here = F.struct("doc_id", "text_key", "no", "size")
    classes = materialise(units.groupBy("key", "n").agg(F.min(here).alias("first"), F.count("*").alias("times"), F.first("bands").alias("bands")), "classes")

    def fetch(keys: DataFrame) -> DataFrame:
        return units.select("key", "sig", "shingles").join(keys, "key", "left_semi")

    # beyond their sets, paragraphs are needed by place and key only
    groups = near_groups(classes.select("key", "n", "bands"), fetch, rule.near, lambda: drop_table(units))
    named = classes.select("key", "first", "times").join(groups, "key", "left").where("component is not null or times > 1")
    named = materialise(named.select("key", "first", F.coalesce("component", "key").alias("component")), "named")
    firsts = materialise(named.groupBy("component").agg(F.min("first").alias("first")), "firsts")
    clusters = materialise(named.select("key", "component").join(firsts, "component"), "clusters")
    found = places.join(clusters, "key").drop("key").repartition("doc_id", "text_key", "component").distinct().withColumn("start", F.floor(F.col("no") / 2).cast("bigint"))
    in_text = Window.partitionBy("doc_id", "text_key", "component").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("apart", F.coalesce((F.col("start") >= F.max(F.col("start") + F.col("size")).over(in_text)).cast("int"), F.lit(0)))
    place = F.sum("apart").over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    flags = found.withColumn("place", place).where(~own | (F.col("place") > 0))
    return materialise(flags.select("doc_id", "text_key", "no", "size", "first"), "flags")


def _ranges(rows: DataFrame, flags: DataFrame, rule: PassageRule) -> DataFrame:
    """(doc_id, text_key, start, end): words to cut. The ends of a run of flagged paragraphs go on while its first occurrence does."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    start, first = F.floor(F.col("no") / 2).cast("bigint"), F.floor(F.col("first.no") / 2).cast("bigint")
    own = flags.select("doc_id", "text_key", start.alias("start"), (start + F.col("size")).alias("end"), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), first.alias("start"), (first + F.col("first.size")).alias("end")).alias("first"))
    text = Window.partitionBy("doc_id", "text_key")
    before = F.max("end").over(text.orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start").over(text.orderBy(F.desc("end"), "start").rowsBetween(Window.unboundedPreceding, -1))
    ends = own.withColumns({"before": before, "after": after})
    left = ends.where("before is null or start > before").select("doc_id", "text_key", "start", "end", F.lit(0).alias("side"), F.col("start").alias("place"), "first", F.col("first.start").alias("first_place"))
    right = ends.where("after is null or end < after").select("doc_id", "text_key", "start", "end", F.lit(1).alias("side"), F.col("end").alias("place"), "first", F.col("first.end").alias("first_place"))
    ends = left.unionByName(right).select("doc_id", "text_key", "start", "end", "side", "place", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"), "first_place")
    ends = materialise(ends, "ends")
    asked = ends.select("doc_id", "text_key", "place", "side").unionByName(ends.select(F.col("first_doc").alias("doc_id"), F.col("first_key").alias("text_key"), F.col("first_place").alias("place"), "side"))
    asked = materialise(asked.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "side")).alias("asked")), "asked-sides")
    texts = having(rows, materialise(asked.select("doc_id").distinct(), "asked-ids"), "doc_id").dropDuplicates(["doc_id", "text_key"]).join(asked, ["doc_id", "text_key"])
    sides = materialise(texts.select("doc_id", "text_key", "text", "asked").mapInArrow(_side_rows(rule), f"doc_id {kind}, text_key bigint, place bigint, side int, words binary"), "sides")
    both = ends.join(sides, ["doc_id", "text_key", "place", "side"]).join(sides.toDF("first_doc", "first_key", "first_place", "side", "first_words"), ["first_doc", "first_key", "first_place", "side"])
    grown = both.select("doc_id", "text_key", "start", "end", "side", "words", "first_words").mapInArrow(_grown(rule.beyond), f"doc_id {kind}, text_key bigint, start bigint, end bigint")
    return own.select("doc_id", "text_key", "start", "end").unionByName(grown)


def _cuts(docs: DataFrame, rule: PassageRule) -> DataFrame:
    """(doc_id, text_key, ranges, first_ids) of the texts with a passage to cut, written."""
    with scratch() as keep:
        rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        flags = _flags(rows, rule)
        ranges = _ranges(rows, flags, rule).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
        firsts = flags.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("first.doc_id")).alias("first_ids"))
        return keep(ranges.join(firsts, ["doc_id", "text_key"]), "cuts")


def repeated_passages(docs: DataFrame, rule: PassageRule = PassageRule()) -> DataFrame:
    """(doc_id, text_key, kept_text, spans, first_ids) of each text of docs(doc_id, text) that has a passage to cut.

    A paragraph is a line of at least least_words words, or a window of `window` words that begins, anywhere in a text
    and whatever the lines, where the words themselves say: of every `reach` places one begins a window, the same in all
    texts that hold the passage. Paragraphs that share a band of minima are compared by the exact Jaccard coefficient of
    their five-word shingles; those that reach the near rule are linked, components of links are clusters, and all of a
    cluster but its first occurrence (the smallest doc_id, then place) is cut; those of one text that overlap, as in a row
    of equal words, are one occurrence. A cut grows, word by word, as far as the
    first occurrence goes on alike, so that a passage goes with its first and last words. Every repeat of
    window + reach words or more is found; one of fewer words is found if a window, or a whole line, lies in it; repeats
    of less than `window` words are left alone. A pair at exactly 80 % is missed with a chance of
    (1 - 0.8 ** rows) ** bands, 0.017 by default, one of equal words never.

    spans are the cuts (start, end in characters, words), kept_text what is left, first_ids the documents with the first
    occurrences. text_key is xxhash64 of the text, as a doc_id may have several. Null and empty texts and rows with a null
    doc_id have no result; repeated rows keep and cut the same; further columns are ignored; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    cuts, kind = _cuts(docs, rule), docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = having(rows, materialise(cuts.select("doc_id").distinct(), "cut-ids"), "doc_id").join(cuts, ["doc_id", "text_key"])
    found = rows.select("doc_id", "text_key", "text", "ranges", "first_ids").mapInArrow(_cut_rows(["doc_id", "text_key", "first_ids"]), f"doc_id {kind}, text_key bigint, first_ids array<{kind}>, kept_text string, spans array<struct<start:bigint,end:bigint,n_words:bigint>>")
    return found.where(F.size("spans") > 0)


def without_repeats(docs: DataFrame, rule: PassageRule = PassageRule()) -> tuple[DataFrame, Column]:
    """(frame, cut): docs with the passages of repeated_passages cut out of column text; cut says whether a row lost any.

    All rows and columns stay, whatever their names; rows with a null doc_id or text are as they were; an empty table
    stays empty. cut is a column of the frame that is not among those of docs.
    """
    ship(docs.sparkSession)
    cuts = _cuts(docs, rule).select("doc_id", "text_key", "ranges")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_key")).join(cuts, ["doc_id", "text_key"], "left")
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    made = rows.select("row", "text", "ranges").mapInArrow(_cut_rows(["row", "text"]), f"row struct<{fields}>, text string, kept_text string, spans array<struct<start:bigint,end:bigint,n_words:bigint>>")
    name = "cut"
    while name in docs.columns:
        name += "_"
    columns = [F.coalesce("kept_text", "text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return made.select(*columns, F.col("kept_text").isNotNull().alias(name)), F.col(name)


def spans_table(found: DataFrame) -> DataFrame:
    """One row for each cut: (doc_id, span, start, end, n_words, first_ids)."""
    return found.select("doc_id", F.posexplode("spans").alias("span", "s"), "first_ids").select("doc_id", "span", "s.start", "s.end", "s.n_words", F.array_join("first_ids", ",").alias("first_ids"))
