"""Phrases, chunked encoding and vector codes against brute force and the library; languages that no row names."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chunk_bpe, language_id, phrase_graph, queries, vector_codes
from riskloom.llm.tokenpieces import load

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "x\n\ny", "tab\tx \t y", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "e\u0301 \u00e9 x " * 900, "don't  we'll 'S I'M", "\x01 a", "日本語 テキスト" * 900, "😀😀 !!" * 2000, "x" * 50000, "ΣΑΣ ς İ ﬁ", "a\x00b", " " * 9000, "don't" * 9000, "a \u0301b " * 4000, "word  two " * 9000]


def _phrases(rows, rule):
    """Counts of all runs by language, and what the rules make of them."""
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for size in range(1, rule.longest + 1):
                count[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in count.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= rule.least}
        made = []
        for p, a in found.items():
            longer = [f for q, f in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f >= rule.inside_percent * a for f in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), l, r))
        made.sort()
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(made[: rule.top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = np.random.default_rng(4)
    words = ["the", "of", "a", "new", "york", "City", "é", "日本", "x1", "ßz", "in"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 60), p=[0.4] + [0.06] * 10)) + rng.choice([".", ",  new york city\tin the", "\n"]), str(rng.choice(["en", "de"]))) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("  .. ,", "xx"), ("one two three four five six seven eight. " * 12, None), ("b b b b b b b b b b b b b b", "loop"), (" ".join(["p q r"] * 30), "loop")]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("longest,least,cells", [(3, 10, 512), (2, 5, 4), (4, 6, 512), (3, 3, 3)])
def test_phrases_like_brute_force(spark, phrase_rows, monkeypatch, longest, least, cells):
    monkeypatch.setattr(phrase_graph, "CELLS", cells)  # few cells make many words and pairs hot
    rule = phrase_graph.PhraseRule(longest=longest, least=least, top=40)
    frame = spark.createDataFrame([(t, lang, 5, 1) for t, lang in phrase_rows], "text string, lang string, n long, rank int").repartition(5)
    made = sorted(tuple(r) for r in phrase_graph.collocations(frame, rule).collect())
    assert made == _phrases(phrase_rows, rule)


def test_phrases_are_counted_in_blocks_of_bounded_memory():
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(20000)])
    text = [" ".join(words[(rng.random(1500) ** 3 * 20000).astype(int)]) for _ in range(1200)]
    batch = pa.RecordBatch.from_pydict({"text": text, "lang": ["en"] * len(text)})
    rule, hot = phrase_graph.PhraseRule(), phrase_graph.Hot(set(), set())
    tracemalloc.start()
    lists = pa.Table.from_batches(list(phrase_graph._list_rows(rule, hot)([batch])))
    most = [tracemalloc.get_traced_memory()[1]]
    lists = lists.sort_by([(c, "ascending") for c in ("lang", "word", "cell")])
    tracemalloc.reset_peak()
    found = pa.Table.from_batches(list(phrase_graph._count_rows(rule, hot)(lists.to_batches(max_chunksize=2000))))
    most.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert max(most) < 150 << 20  # blocks of 6 MB of text and 12 MB of lists took some 250 MB each
    number = collections.Counter()
    for size, gram, n in zip(*(found.column(c).to_pylist() for c in ("words", "gram", "n")), strict=True):
        number[size, gram] += n
    runs = collections.Counter((size, " ".join(w[i : i + size])) for w in map(str.split, text) for size in (1, 2, 3) for i in range(len(w) - size + 1))
    assert number == {(0, ""): 1500 * 1200} | {k: n for k, n in runs.items() if n >= rule.least}


def test_phrases_of_nothing(spark):
    frame = spark.createDataFrame([(None, None), ("a b c", "en")], "text string, lang string")
    assert phrase_graph.collocations(frame).count() == 0 and phrase_graph.collocations(frame.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(f"w{k}", 1, 10**12) for k in range(3)]
    a, l, r = 10**12, 3 * 10**12, 2 * 10**12
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(phrase_graph.SCORE).alias("s")).first()
    assert row["s"] == 1000000 * a * a // (l * r) and rows


def test_paths_are_compacted(spark):
    text = "one two three four five six. nine ten eleven."
    frame = spark.createDataFrame([(text, "en")] * 12 + [("six seven. zero nine ten", "en"), (" ".join(["p q r"] * 30), "loop")], "text string, lang string")
    made = {(r["lang"], r["phrase"]): r["n"] for r in phrase_graph.phrase_paths(frame).collect()}
    assert made["en", "one two three four five six"] == 12 and made["en", "nine ten eleven"] == 12
    assert {p: n for (lang, p), n in made.items() if lang == "loop"} == {"p q r": 30, "q r p q": 29}
    edges = [("x", g, 12) for g in ("a b c", "b c a", "c a b", "m n o", "n o p", "o p q", "p q r", "q r s", "k k k")]
    made = {r["phrase"] for r in phrase_graph.paths(spark.createDataFrame(edges, "lang string, gram string, n long"), 3).collect()}
    assert made == {"a b c", "b c a", "c a b", "m n o p q r s", "k k k"}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_give_the_library_s_ids(spark, sf_dir, path):
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(150).collect()]
    shifted = [(docs[0] or "")[37:90] + (t or "") for t in docs[:40]]
    texts = [*ODD, *docs, *shifted, None, docs[1]]
    frame = spark.createDataFrame([(k if k else None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    made = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in chunk_bpe.encoded(frame, path).collect())
    library, want = load(path), collections.Counter()
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k if k else None, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert made == want
    assert chunk_bpe.encoded(frame.where("false"), path).count() == 0


def test_equal_passages_have_equal_chunks():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 120, 400_000).astype(np.uint8)
    moved = np.concatenate([raw[5000:5333], raw])
    cut = lambda r: chunk_bpe.RollingHash().cuts(r)
    assert len(cut(raw)) > 100 and set(cut(raw)) <= set(cut(moved) - 333)
    text = [raw[a : a + 40_000].tobytes().decode() for a in range(0, 400_000, 40_000)]
    made = chunk_bpe.ChunkIds(WORD)
    made.ids(pa.array(text))
    before = len(made.known)
    made.ids(pa.array(["zz " + t for t in text]))
    assert len(made.known) - before <= 2 * len(text)  # only the first chunk of a text is new


def test_a_join_that_doesn_t_agree_grows(monkeypatch):
    """With wrong ids remembered for a chunk's spans, the joins take the chunk's text, and the result is the library's."""
    text = pa.array([" ".join(f"word{k} stone{k % 7}" for k in range(3000))])
    made = chunk_bpe.ChunkIds(WORD)
    good, _ = made.ids(text)
    wrong = made.rows[made.rows[:, 0] == 1][::2]
    for row in wrong:
        made.ids_flat[row[1] : row[2]] += 1
        made.ids_flat[row[3] : row[4]] += 1
    again, _ = made.ids(text)
    assert len(wrong) > 2 and np.array_equal(good, again)
    assert again.tolist() == load(WORD).encode(text[0].as_py(), add_special_tokens=False).ids


def test_digests_of_the_codec(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op12_bpe_codec(spark, sf_dir).collect()}
    library = load(WORD)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(20).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        own = rows[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _codes(rows, rule):
    """(vec_id -> (code, error)), codebooks, by comparing every part with every entry in Python integers."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, [floor(Fraction(x) * rule.scale) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    step = len(kept[0][1]) // rule.parts
    first = sorted(r for r in kept if r[0] is not None)[: rule.entries]
    books = [[v[p * step : (p + 1) * step] for _, v in first] for p in range(rule.parts)]

    def nearest(v, p):
        own = v[p * step : (p + 1) * step]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rule.rounds):
        held = [[[] for _ in first] for _ in range(rule.parts)]
        for _, v in kept:
            for p in range(rule.parts):
                held[p][nearest(v, p)[1]].append(v[p * step : (p + 1) * step])
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(held[p], books[p], strict=True)] for p in range(rule.parts)]
    out = []
    for i, v in kept:
        each = [nearest(v, p) for p in range(rule.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
    return out, books


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_vector_codes_like_brute_force(spark, scale):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * scale
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 6] + rng.normal(size=8) * scale / 20], int(k % 3) if k % 5 else None) for k in range(120)]
    rows += [(200 + k, rows[k][1], 1) for k in range(8)] + [(3, rows[4][1], 2), (None, rows[5][1], None)]
    odd = [(300, None, 1), (301, [None] + [1.0] * 7, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, None)]
    rule = vector_codes.CodeRule(parts=4, entries=40, rounds=3)
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    found, books = vector_codes.compressed(frame, rule)
    want, book = _codes(rows, rule)
    made = found.collect()
    top = lambda e: min(e, 2**63 - 1)
    key = lambda t: (t[0] is None, t)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in made), key=key) == sorted(((i, c, top(e)) for i, c, e in want), key=key)
    assert [[list(map(int, e)) for e in b] for b in books] == book
    total = collections.Counter()
    for (_, _, label), (_, _, e) in zip(rows, want, strict=True):
        total[label] += top(e)
    label_of = {(r[0], tuple(r[1])): r[2] for r in rows}
    assert {r["label_error"] for r in made} == {top(t) for t in total.values()} and label_of


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    empty = spark.createDataFrame([], schema)
    assert vector_codes.compressed(empty)[0].count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0], 1), (3, [1.0, 2.0, 3.0, 4.0, 5.0], None)]
    made = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compressed(spark.createDataFrame(rows, schema))[0].collect()}
    assert made == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: ("00000000", 0, 0)}


def test_gnat_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    entries = np.repeat(rng.integers(-3000, 3000, (64, 4)), 4, axis=0).astype(float)[rng.permutation(256)] + rng.integers(0, 9, (256, 4))
    entries[7], entries[200] = entries[90], entries[90]
    points = np.concatenate([entries, entries[rng.integers(0, 256, 900)] + rng.integers(-40, 40, (900, 4))]).astype(float)
    tree = vector_codes.Gnat(entries)
    at, best = tree.nearest(points)
    full = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(at, full.argmin(axis=1)) and np.array_equal(best, full.min(axis=1))
    assert tree.visited < 0.5 * full.size
    same = vector_codes.Gnat(np.zeros((60, 3)))
    assert same.nearest(np.ones((2, 3)))[0].tolist() == [0, 0]


def test_texts_of_languages_that_no_row_names_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strange = ["日本語の文章はここにあります。" * 5, "это русский текст, который никто не учил " * 5, "αυτό είναι ένα ελληνικό κείμενο " * 5, "ᚠᚢᚦᚨᚱᚲ", "12 -- 345"]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**7 + k, t, None) for k, t in enumerate(strange)], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language_id.in_known_languages(rows).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**7}
    own = {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert len(own - kept) <= 0.01 * len(own)


def test_language_values_like_the_kernel(spark, sf_dir):
    """A prediction's score is the sum of the weights of the distinct held n-grams over the root of their number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    model = language_id.fit(docs)
    some = docs.limit(30)
    for r in language_id.predict(some, model).join(some, "doc_id").collect():
        slots = np.unique(np.concatenate([s for s, _ in language_id._slots(pa.array([r["text"]]))]))
        column = model.columns[slots]
        value = model.weights[column[column >= 0]].astype(float).sum(axis=0) / np.sqrt(max(1, (column >= 0).sum()))
        if r["lang_pred"] != "und":
            assert r["lang_pred"] == model.languages[int(value.argmax())] and abs(r["score"] - min(1, max(0, (value.max() + 1) / 2))) < 1e-6
