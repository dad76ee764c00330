"""Collocations from a weighted de Bruijn graph of words: edges are the longest phrases, nodes the phrases that follow each other in them."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import as_text, binary_slices, materialise, scratch, text_bytes, text_slices, texts_of

#: The bytes that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)], _CLASS[list(PIECE_ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Cells of a hot word, the inverse of the share that makes it hot, and groups that a language's candidates are dealt to before its
#: first ones are chosen. Bytes of text that are sampled for hot words.
CELLS, SAMPLE = 512, 32 << 20
#: Bytes of text whose runs are counted at once, and of lists that are added up at once: a worker holds some 40 times as much beside a batch.
BLOCK, TABLE = 2_000_000, 3_000_000
#: The score of a cut in decimals of up to 38 digits.
SCORE = "(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


@dataclass(frozen=True)
class PhraseRule:
    """Phrases of 2 to longest words that occur least times or more; inside percent: a phrase within a longer one goes if
    the longer one has that share of its occurrences; top: rows a language."""

    longest: int = 3
    least: int = 10
    inside_percent: int = 50
    top: int = 2000


def _starts_of(text: pa.Array, lang: pa.Array, longest: int):
    """(words, spoken, parts, first, count): the distinct runs of `longest` words that start at a word, as numbers in parts, with the end of a piece as 0;
    first is the row of the run's language, count its occurrences. Runs are in the order of language, first word, second word and so on."""
    raw, row_at = text_bytes(text)
    raw = _LOWER[raw]
    kind = _CLASS[raw]
    word = kind == 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[row_at] = True
    none = np.zeros(0, np.int64)
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]]))) if len(raw) else none
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1 if len(raw) else none
    row = np.searchsorted(row_at, starts, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + row if len(starts) else starts
    coded = texts_of(raw, starts, ends).dictionary_encode()
    spoken = lang.dictionary_encode()
    del raw, kind, word, edge, starts, ends
    code = coded.indices.to_numpy().astype(np.int64) + 1 if len(coded) else none
    key = spoken.indices.to_numpy().astype(np.int64)[row] if len(row) else none
    parts, inside = [code], np.ones(len(code), bool)
    for k in range(1, longest):
        inside[len(code) - k :] = False
        inside[: len(code) - k] &= piece[k:] == piece[: len(code) - k]
        parts.append(np.where(inside, np.roll(code, -k), 0))
    n, room = len(coded.dictionary) + 1, len(spoken.dictionary)
    speech = key
    for part in parts:
        if room * n >= 2**62:
            known, key = np.unique(key, return_inverse=True)
            room = len(known)
        key, room = key * n + part, room * n
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return coded.dictionary, spoken.dictionary, [p[first] for p in parts], speech[first], count


def adjacency(text: pa.Array, lang: pa.Array, longest: int, hot: "Hot") -> pa.RecordBatch:
    """(lang, word, cell, rest, counts): of every first word of a block what follows it, each continuation once with its number."""
    words, spoken, parts, speech, count = _starts_of(text, lang, longest)
    cell = hot.cells(words, spoken, parts, speech)
    group = speech * (len(words) + 1) + parts[0]
    if cell.any():
        order = np.lexsort((cell, group))
        parts, speech, count, cell, group = [p[order] for p in parts], speech[order], count[order], cell[order], group[order]
    after = [words.take(pa.array(p - 1, mask=p == 0)) for p in parts[1:]]
    rest = pc.binary_join_element_wise(after[0].fill_null(""), *after[1:], pa.scalar(" ", pa.large_string()), null_handling="skip")  # rows of nulls only would be left out
    raw, at = text_bytes(pc.binary_join_element_wise(rest, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    begin = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])) if len(group) else np.zeros(0, np.int64)
    until = np.append(begin, len(group))
    return pa.RecordBatch.from_pydict({
        "lang": spoken.take(pa.array(speech[begin])), "word": words.take(pa.array(parts[0][begin] - 1)).cast(pa.string()), "cell": pa.array(cell[begin].astype(np.int32)),
        "rest": texts_of(raw, at[until[:-1]], at[until[1:]]).cast(pa.string()), "counts": binary_slices(count.astype(np.uint32), until),
    })


class Hot:
    """Words, and pairs of words, that hold a large share of a language's runs: their runs are dealt to cells, by the second word, or by all words for a pair.

    Which ones are hot only decides where a run is counted.
    """

    def __init__(self, words: set[tuple[str, str]], pairs: set[tuple[str, str]]):
        self.words, self.pairs = words, pairs

    def _codes(self, words: pa.Array, spoken: pa.Array, pick: set[tuple[str, str]]) -> np.ndarray:
        """language * (number of words + 1) + word, for those of pick that the block has."""
        place = {w: k for k, w in enumerate(words.to_pylist())} if pick else {}
        speech = {s: k for k, s in enumerate(spoken.to_pylist())}
        return np.array(sorted(speech[s] * (len(words) + 1) + place[w] + 1 for s, w in pick if s in speech and w in place), np.int64)

    def cells(self, words: pa.Array, spoken: pa.Array, parts: list[np.ndarray], speech: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(speech), np.int64)
        n = len(words) + 1
        codes = self._codes(words, spoken, self.words)
        own = np.flatnonzero(np.isin(speech * n + parts[0], codes)) if len(codes) else codes
        if not len(own):
            return cell
        mark = np.array([0, *(zlib.crc32(w.encode()) for w in words.to_pylist())], np.int64)
        cell[own] = mark[parts[1][own]]
        place, speaks = {w: k + 1 for k, w in enumerate(words.to_pylist())}, {s: k for k, s in enumerate(spoken.to_pylist())}
        for s, pair in sorted(self.pairs):
            a, b = pair.split(" ")
            if s in speaks and a in place and b in place:
                same = own[(speech[own] == speaks[s]) & (parts[0][own] == place[a]) & (parts[1][own] == place[b])]
                for p in parts[2:]:
                    cell[same] = cell[same] * 31 + mark[p[same]]
        cell[own] = 1 + cell[own] % CELLS
        return cell


def _whole_keys(batches, most_bytes: int):
    """Tables of about most_bytes of rest that end where lang, word and cell change, or one key's rows if they are more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.column("rest").nbytes
        if size < most_bytes:
            continue
        table = pa.Table.from_batches(held)
        last = len(table) - 1
        key = [table.column(c)[last].as_py() for c in ("lang", "word", "cell")]
        same = pc.and_(pc.and_(pc.equal(table.column("lang"), key[0]), pc.equal(table.column("word"), key[1])), pc.equal(table.column("cell"), key[2]))
        first = pc.index(same, True).as_py()
        if first:
            yield table.slice(0, first)
            rest = table.slice(first).combine_chunks()
            held, size = rest.to_batches(), rest.column("rest").nbytes
    if held:
        yield pa.Table.from_batches(held)


def _flows_of(table: pa.Table, rule: PhraseRule, hot: Hot):
    table = table.combine_chunks()
    lang, word, cell = (table.column(c).combine_chunks() for c in ("lang", "word", "cell"))
    spoken, coded = lang.dictionary_encode(), word.dictionary_encode()
    key = (spoken.indices.to_numpy().astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()) * (CELLS + 1) + cell.to_numpy()
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(fresh) - 1
    row_of = np.flatnonzero(fresh)
    raw, _ = text_bytes(table.column("rest").combine_chunks())
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    entry = texts_of(raw, starts, ends).dictionary_encode()
    counts = table.column("counts").combine_chunks()
    flat, at = text_bytes(counts.cast(pa.large_binary()).view(pa.large_string()))
    number = np.ascontiguousarray(flat).view(np.uint32).astype(np.int64)
    of = np.repeat(group, np.diff(at) // 4)
    pair = of * len(entry.dictionary) + entry.indices.to_numpy()
    order = np.argsort(pair, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
    n = np.add.reduceat(number[order], first)
    of, code = pair[order][first] // len(entry.dictionary), pair[order][first] % len(entry.dictionary)
    is_hot = cell.to_numpy()[row_of] > 0
    lang_of, word_of = lang.take(pa.array(row_of)), word.take(pa.array(row_of))

    def rows(size: int, groups: np.ndarray, tail: pa.Array | None, n: np.ndarray):
        gram = word_of.take(pa.array(groups))
        if tail is not None:
            gram = pc.binary_join_element_wise(gram, tail.cast(pa.string()), " ")
        return pa.RecordBatch.from_pydict({"lang": lang_of.take(pa.array(groups)), "words": pa.array(np.full(len(groups), size, np.int32)), "gram": gram, "n": pa.array(n)})

    total = np.zeros(len(row_of), np.int64)
    np.add.at(total, of, n)
    word_rows = np.flatnonzero((total >= rule.least) | is_hot)
    yield rows(1, word_rows, None, total[word_rows])
    speech = spoken.indices.to_numpy()[row_of]
    every = np.zeros(len(spoken.dictionary), np.int64)
    np.add.at(every, speech, total)
    yield pa.RecordBatch.from_pydict({"lang": spoken.dictionary, "words": pa.array(np.zeros(len(every), np.int32)), "gram": pa.array([""] * len(every), pa.string()), "n": pa.array(every)})
    text, text_at = text_bytes(entry.dictionary)
    blank = np.flatnonzero(text == 32)
    low, high = np.searchsorted(blank, text_at[:-1]), np.searchsorted(blank, text_at[1:])
    size = np.where(text_at[1:] > text_at[:-1], high - low + 1, 0)
    for k in range(1, rule.longest):
        deep = np.flatnonzero(size[code] >= k)
        if not len(deep):
            break
        if k == rule.longest - 1:
            often = deep[n[deep] >= rule.least]
            yield rows(k + 1, of[often], entry.dictionary.take(pa.array(code[often])), n[often])
            break
        cut = np.where(size > k, blank[np.minimum(low + k - 1, max(0, len(blank) - 1))] if len(blank) else 0, text_at[1:])
        start = texts_of(text, text_at[:-1], np.where(size >= k, cut, text_at[:-1])).dictionary_encode()
        node = of[deep] * len(start.dictionary) + start.indices.to_numpy()[code[deep]]
        order = np.argsort(node, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
        flow = np.add.reduceat(n[deep][order], begin)
        groups, tail = node[order][begin] // len(start.dictionary), node[order][begin] % len(start.dictionary)
        open_ = np.zeros(len(groups), bool)
        if is_hot.any() and hot.pairs:
            mine = np.flatnonzero(is_hot[groups])
            said = zip(lang_of.take(pa.array(groups[mine])).to_pylist(), word_of.take(pa.array(groups[mine])).to_pylist(), start.dictionary.take(pa.array(tail[mine])).to_pylist(), strict=True)
            open_[mine] = [(s, " ".join([w, *t.split(" ")[:1]])) in hot.pairs for s, w, t in said]
        keep = np.flatnonzero((flow >= rule.least) | open_)
        yield rows(k + 1, groups[keep], start.dictionary.take(pa.array(tail[keep])), flow[keep])


def _hot(docs: DataFrame, rule: PhraseRule) -> Hot:
    """Words and pairs that hold 1 of CELLS or more of the runs of a bounded sample of about SAMPLE bytes: at most CELLS of each a language."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                words, spoken, parts, speech, count = _starts_of(as_text(part.column("text")), part.column("lang").fill_null("und"), 2)
                total = np.bincount(speech, weights=count, minlength=len(spoken))
                for k, key in ((1, speech * (len(words) + 1) + parts[0]), (2, np.arange(len(speech)))):
                    known, at = np.unique(key, return_inverse=True)
                    n, first = np.bincount(at, weights=count), np.zeros(len(known), np.int64)
                    first[at] = np.arange(len(at))
                    much = first[(n * 2 * CELLS >= total[speech[first]]) & ((k == 1) | (parts[1][first] > 0))]
                    mine = n[at[much]].astype(np.int64)
                    gram = words.take(pa.array(parts[0][much] - 1))
                    gram = gram if k == 1 else pc.binary_join_element_wise(gram, words.take(pa.array(parts[1][much] - 1)), pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_pydict({"lang": spoken.take(pa.array(speech[much])), "words": pa.array(np.full(len(much), k, np.int32)), "gram": gram.cast(pa.string()), "n": pa.array(mine)})
                yield pa.RecordBatch.from_pydict({"lang": spoken, "words": pa.array(np.zeros(len(spoken), np.int32)), "gram": pa.array([""] * len(spoken), pa.string()), "n": pa.array(total.astype(np.int64))})

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, size // SAMPLE))) == 0)
    rows = part.mapInArrow(run, "lang string, words int, gram string, n bigint").groupBy("lang", "words", "gram").agg(F.sum("n").alias("n"))
    total = rows.where("words = 0").select("lang", F.col("n").alias("total"))
    found = rows.where("words > 0").join(total, "lang").where(F.col("n") * CELLS >= F.col("total")).collect()
    pick = lambda k: {(r["lang"], r["gram"]) for r in found if r["words"] == k}
    return Hot(pick(1), pick(2))


def _list_rows(rule: PhraseRule, hot: Hot):
    """The lists of what follows each word, block by block."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                yield adjacency(as_text(part.column("text")), part.column("lang").fill_null("und"), rule.longest, hot)

    return run


def _count_rows(rule: PhraseRule, hot: Hot):
    """The numbers of phrases from sorted lists, some keys at a time."""

    def run(batches):
        for table in _whole_keys(batches, TABLE):
            yield from _flows_of(table, rule, hot)

    return run


def _flows(docs: DataFrame, rule: PhraseRule) -> DataFrame:
    """(lang, words, gram, n): the number of occurrences of all phrases of up to rule.longest words that reach rule.least, and at words 0 all words.

    Only the longest phrases are counted in the texts, and at the ends of pieces the shorter ones that stand there. The occurrences of
    a shorter phrase are the flow through its node: the sum over the edges that start with it, and its own stands at ends. Edges travel as lists of what follows
    a word, once, to where that word is counted, so nodes are whole there; hot words and pairs are dealt to cells and added up after.
    """
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    hot = _hot(docs, rule)
    rows = docs.mapInArrow(_list_rows(rule, hot), "lang string, word string, cell int, rest string, counts binary").repartition("lang", "word", "cell").sortWithinPartitions("lang", "word", "cell")
    rows = rows.mapInArrow(_count_rows(rule, hot), "lang string, words int, gram string, n bigint").groupBy("lang", "words", "gram").agg(F.sum("n").alias("n"))
    return rows.where((F.col("words") == 0) | (F.col("n") >= rule.least))


def _last(size: int):
    return F.substring_index("gram", " ", -size)


def paths(edges: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n): edges(lang, gram, n) of a graph, compacted. Where a node has one edge in and one out, of equal n, the two belong to
    one phrase; a cycle of such nodes stays as single edges.

    Every edge points to the one before it in its path; pointers double in each round, which is written, so a path of 2^k edges takes k rounds.
    """
    rows = edges.select("lang", "gram", "n", F.substring_index("gram", " ", longest - 1).alias("head"), _last(longest - 1).alias("tail"))
    into = rows.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("n_in"), F.min("gram").alias("before"), F.min("n").alias("w_in"))
    out = rows.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("n_out"), F.min("gram").alias("gram"), F.min("n").alias("w_out"))
    unary = into.join(out, ["lang", "node"]).where("n_in = 1 and n_out = 1 and w_in = w_out and before <> gram").select("lang", "gram", "before")
    state = materialise(rows.select("lang", "gram", "n").join(unary, ["lang", "gram"], "left").withColumn("place", F.when(F.col("before").isNotNull(), 1).otherwise(0)), "pointers")
    left = None
    while True:
        back = state.select("lang", F.col("gram").alias("before"), F.col("before").alias("earlier"), F.col("place").alias("more"))
        moved = state.join(back, ["lang", "before"], "left")
        open_ = moved.where("earlier is not null").count()
        if open_ in (0, left):
            break
        left = open_
        state = materialise(moved.select("lang", "gram", "n", F.coalesce("earlier", "before").alias("before"), (F.col("place") + F.when(F.col("earlier").isNotNull(), F.col("more")).otherwise(0)).alias("place")), "pointers")
    cycle = F.col("earlier").isNotNull()
    head = F.when(cycle | F.col("before").isNull(), F.col("gram")).otherwise(F.col("before"))
    placed = moved.select("lang", "n", head.alias("head"), F.when(cycle, 0).otherwise(F.col("place")).alias("place"), _last(1).alias("word"))
    of_path = placed.groupBy("lang", "head").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "word")))).alias("rest"))
    return of_path.select("lang", F.concat_ws(" ", F.col("head"), F.col("rest.word")).alias("phrase"), "n")


def _grams(words, size: int):
    """The phrases of `size` words in an array of words."""
    n = F.size(words) - size
    return F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def phrase_paths(docs: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """(lang, phrase, n): the compacted graph of frequent phrases of docs(text, lang): repeated runs of words of any length with their number."""
    ship(docs.sparkSession)
    with scratch() as keep:
        flows = materialise(_flows(docs, rule), "flows")
        return keep(paths(flows.where(F.col("words") == rule.longest), rule.longest), "paths")


def collocations(docs: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(text, lang), the first rule.top of each language.

    A-Z are lower-cased, texts are parted at . , ; : ! ? and \\n to \\r, pieces at spaces and tabs. n are all words of the language, a the
    occurrences of the phrase, overlapping ones included, l and r those of its two parts at the lowest-scoring cut, of equal ones the first; score is
    floor(1000000 a a / (l r)), exact up to 38 digits. A phrase of which a longer frequent one holds rule.inside_percent or more goes.
    Order: score, then a, both falling, then the phrase's bytes.
    A null text is an empty one, a null lang is und; an empty table, or one without a frequent phrase, gives no rows; repeated rows count each;
    texts of any length are read whole; further columns are ignored.
    Edges are counted once for each task and block before they are shuffled, by the whole phrase, so a frequent word or pair isn't one group.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        flows = materialise(_flows(docs, rule), "flows")
        compact = paths(flows.where(F.col("words") == rule.longest), rule.longest)
        longest = compact.select("lang", F.explode(_grams(F.split("phrase", " "), rule.longest)).alias("phrase"), F.col("n").alias("a"))
        shorter = flows.where(F.col("words").between(2, rule.longest - 1)).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
        found = materialise(longest.unionByName(shorter).withColumn("list", F.split("phrase", " ")), "candidates")
        none = F.array().cast("array<string>")
        held = found.where(F.size("list") > 2).select("lang", "a", F.explode(F.concat(*[F.when(F.size("list") > k, _grams(F.col("list"), k)).otherwise(none) for k in range(2, max(3, rule.longest))])).alias("phrase"))
        held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        free = found.join(held, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * rule.inside_percent, F.lit(True)))
        cut = free.select("lang", "phrase", "a", "list", F.explode(F.sequence(F.lit(1), F.size("list") - 1)).alias("k"))
        cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("list", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("list", F.col("k") + 1, F.size("list")), " ").alias("right"))
        count = flows.where("words > 0").select("lang", "gram", "n")
        cut = cut.join(count.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(count.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        least = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        for part in ([F.pmod(F.xxhash64("phrase"), F.lit(CELLS))], []):
            least = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *part).orderBy(*order)).cast("bigint")).where(F.col("rank") <= rule.top)
        total = flows.where("words = 0").select("lang", F.col("n"))
        return keep(least.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def _sql(rule: PhraseRule) -> str:
    counts = " union all ".join(f"select lang, array_to_string(g, ' ') as gram, {k} as words, count(*) as f from (select lang, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: ws[i:i + {k - 1}])) as g from pieces) group by 1, 2" for k in range(1, rule.longest + 1))
    return f"""with cut as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
pieces as materialized (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from cut),
grams as materialized ({counts}), totals as (select lang, sum(len(ws))::bigint as n from pieces group by lang),
candidates as materialized (select lang, gram as phrase, words, f as a, string_split(gram, ' ') as ws from grams where words >= 2 and f >= {rule.least}),
subs as (select lang, array_to_string(s, ' ') as phrase, max(a) as longer from (select lang, a, unnest(list_concat({', '.join(f"case when words > {k} then list_transform(range(1, words - {k} + 2), lambda i: ws[i:i + {k - 1}]) else [] end" for k in range(2, rule.longest))})) as s from candidates where words > 2) group by 1, 2),
free as (select c.* from candidates c left join subs s using (lang, phrase) where longer is null or 100 * longer < {rule.inside_percent} * a),
cuts as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as lp, array_to_string(ws[k + 1:], ' ') as rp from (select *, unnest(range(1, words)) as k from free)),
scored as (select c.lang, phrase, a, k, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score from cuts c join grams x on x.lang = c.lang and x.gram = lp join grams y on y.lang = c.lang and y.gram = rp),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as o from scored),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where o = 1)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {rule.top}"""


OP11_SQL = _sql(PhraseRule())
