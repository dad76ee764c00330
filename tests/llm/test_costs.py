"""What is done once only, and how much is written, beside results that stay the same."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from riskloom.llm import minhash_dedup, minhash_links, shared, substring_dedup, textkernel, tokenpieces

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Ein Wort, zwei Worte; ein Wort!", "Wort ein. Worte, über Größe\nein Wort,", "", " ", "a  b Wort", "日本 Wort, über!", "x<|endoftext|> Wort\tein", "Wort\n\nein,"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pre_token_is_encoded_once_however_pieces_hold_it(path, monkeypatch):
    whole, asked = tokenpieces.load(path), []

    def tokenize(letters):
        asked.append(letters)
        return whole.model.tokenize(letters)

    monkeypatch.setitem(tokenpieces._loaded, path, SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), normalizer=whole.normalizer, encode=whole.encode))
    maker = tokenpieces.TokenIds(path)
    for _ in range(2):
        for text in TEXTS:  # a slice each, so that pieces of later ones hold pre-tokens of earlier ones
            ids, at = maker.ids(pa.array([text]))
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
            assert at.tolist() == [0, len(ids)]
    assert len(asked) == len(set(asked)) > 5


def test_least_places_are_those_of_a_plain_search(monkeypatch):
    monkeypatch.setattr(textkernel, "_PLACE_BITS", 6)  # so that values are taken in several parts
    values = np.random.default_rng(3).integers(0, 6, 500).astype(np.uint64) << np.uint64(50)
    for reach in (1, 2, 7, 25):
        found = textkernel.last_least_places(values, reach)
        windows = [values[k : k + reach].tolist() for k in range(len(values) - reach + 1)]
        assert found.tolist() == [k + max(i for i, v in enumerate(w) if v == min(w)) for k, w in enumerate(windows)]


def test_a_band_counts_once_where_paragraphs_of_a_text_overlap():
    texts = ["one two three " * 40, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)) + "\n" + "a b c d " * 30] * 2
    p = substring_dedup.Paragraphs(pa.array(texts), substring_dedup.PassageRule())
    bands = minhash_links.band_keys(p.signatures(), p.rule.near)
    seen, expected = {}, []
    for k in range(len(p.start)):
        for band in bands[k].tolist():
            last = seen.get((p.of_row[k], band))
            if last is None or p.start[k] >= p.start[last] + p.size[last]:
                expected.append((k, band))
            seen[p.of_row[k], band] = k
    own, found = p.bands()
    assert sorted(zip(own.tolist(), found.tolist(), strict=True)) == sorted(expected)
    assert len(expected) < bands.size


def test_texts_without_paragraphs_have_no_bands():
    for texts in ([], [""], ["", "a few words"]):
        own, found = substring_dedup.Paragraphs(pa.array(texts, pa.string()), substring_dedup.PassageRule()).bands()
        assert len(own) == len(found) == 0


def test_runs_hold_the_rows_of_one_key_each():
    rows = [(1, b"a"), (1, b"a"), (1, b"b"), (2, b"b"), (2, None), (2, None), (None, b"b"), (3, b"b"), (3, b"b")]
    make = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], ["x", "y"])
    expected = [[r for r in rows if r == key] for key in dict.fromkeys(rows)]
    for step in (1, 2, 4, 9):
        batches = [make(rows[k : k + step]) for k in range(0, len(rows), step)] + [make([])]
        assert [list(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True)) for t in shared.runs_of(batches, ["x", "y"])] == expected


def test_paragraphs_with_their_shingles_go_when_the_sets_are_written(spark, monkeypatch):
    words = [f"w{k}" for k in range(4000)]
    passage = " ".join(words[:80])
    docs = spark.createDataFrame([(k, " ".join(words[100 + 60 * k : 160 + 60 * k]) + " " + passage) for k in range(12)], "doc_id long, text string")
    tables, written = [], minhash_links._groups

    def groups(links):
        tables.append({f.name.rsplit("-", 1)[0] for f in Path(shared.work_folder(spark).removeprefix("file:")).iterdir()})
        return written(links)

    before = {f.name.rsplit("-", 1)[0] for f in Path(shared.work_folder(spark).removeprefix("file:")).iterdir()}
    assert "paragraphs" not in before
    monkeypatch.setattr(minhash_links, "_groups", groups)
    found = {r["doc_id"]: r["kept_text"].split() for r in substring_dedup.repeated_passages(docs).collect()}
    assert sorted(found) == list(range(1, 12))
    for k, kept in found.items():  # a window that is near alike may take a few words beside the passage
        assert kept == words[100 + 60 * k : 160 + 60 * k][: len(kept)] and len(kept) > 55
    assert tables and all("sets" in t and not t & {"paragraphs", "shared-bands", "asked-lists"} for t in tables)


def _times(texts):
    """doc_id and no of all paragraphs with a band that occurs more than once."""
    seen = {}
    for k, text in enumerate(texts):
        p = substring_dedup.Paragraphs(pa.array([text]), substring_dedup.PassageRule())
        own, bands = p.bands()
        for o, band in zip(own.tolist(), bands.tolist(), strict=True):
            seen.setdefault(band, []).append((k, int(p.no[o])))
    return {place for places in seen.values() if len(places) > 1 for place in places}


@pytest.mark.parametrize("block,table", [(1, 1), (300, 2000), (1 << 18, 4 << 20)])
def test_texts_are_read_once_for_shared_bands(monkeypatch, block, table):
    rng = np.random.default_rng(6)
    common, made = " ".join(f"c{k}" for k in range(30)), []
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 90)) + ("\n" + common if k % 2 else "") for k in range(60)] + ["", "few words"]
    texts += texts[:5] + [texts[0] + "\n" + texts[0]]
    expected = _times(texts)
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "TABLE", table)
    whole = substring_dedup.Paragraphs
    monkeypatch.setattr(substring_dedup, "Paragraphs", lambda text, rule: made.append(len(text)) or whole(text, rule))
    frame = pa.RecordBatch.from_pydict({"doc_id": [f"d{k}" for k in range(len(texts))], "text": texts})
    dealt = pa.Table.from_batches(list(substring_dedup._band_rows(substring_dedup.PassageRule())([frame.slice(0, 40), frame.slice(40)])))
    assert sum(made) == len(texts)  # they were read a second time for the members of bands
    dealt = dealt.sort_by("cell").combine_chunks()
    found = pa.Table.from_batches(list(substring_dedup._shared_rows(dealt.to_batches(max_chunksize=7))))
    assert {(int(d[1:]), n) for d, n in zip(found["doc_id"].to_pylist(), found["no"].to_pylist(), strict=True)} == expected
    assert len(expected) > 60


def test_a_frequent_band_is_one_entry_of_its_cell_for_each_block():
    bands, n = np.full(5000, 77 << 40, np.int64), np.arange(5000)
    block = substring_dedup._dealt(bands, n, n, pa.array(n))
    assert sorted(len(ids) for ids in block["ids"].to_pylist()) == [1, 5000]
    found = pa.Table.from_batches(list(substring_dedup._shared_rows([block])))
    assert set(found["doc_id"].to_pylist()) == set(n.tolist())


@pytest.mark.parametrize("bits,most,compared", [(44, 30, 1 << 18), (64, 30, 100), (44, 600, 700), (64, 600, 1 << 18)])
def test_sets_are_compared_like_sets_of_python(monkeypatch, bits, most, compared):
    monkeypatch.setattr(minhash_links, "COMPARED", compared)
    rng = np.random.default_rng(bits + most)
    pairs = []
    for _ in range(300):
        whole = rng.integers(0, 2**63, int(rng.integers(1, most))).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - bits)
        pairs.append([np.unique(whole[rng.random(len(whole)) < rng.choice([0.85, 0.95, 1])]) for _ in range(2)])
    batch = pa.RecordBatch.from_pydict({"a": pa.array([b"%d" % k for k in range(300)], pa.binary()), "b": pa.array([b"x"] * 300, pa.binary()), **{f"set_{c}": pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k, c in enumerate("ab")}})
    rule = minhash_links.NearRule()
    sets = [(set(x.tolist()), set(y.tolist())) for x, y in pairs]
    expected = [b"%d" % k for k, (x, y) in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)]
    assert [k for out in minhash_links._set_check(rule)([batch.slice(0, 120), batch.slice(120)]) for k in out["a"].to_pylist()] == expected
    assert 20 < len(expected) < 280


def test_stages_of_the_pipeline_take_texts_in_small_batches(spark):
    import corpus_pipeline

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long")

    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for own, most in (("10000", 2000), ("0", 2000), ("700", 700)):
            spark.conf.set(corpus_pipeline.BATCH, own)
            found = corpus_pipeline._in_batches(sizes)(spark, spark.range(0, 5000, 1, 1), "").collect()
            assert sum(r["n"] for r in found) == 5000 and max(r["n"] for r in found) == most
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


@pytest.mark.parametrize("partitions", ["4", "400"])
def test_a_scratch_table_of_many_partitions_is_few_files_without_checksums(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        with shared.scratch():
            table = shared.materialise_few(spark.range(0, 3000, 1, 300), "many")
            folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
            names = [f.name for f in folder.iterdir()]
            assert [n for n in names if not n.startswith("part-")] == []  # each would be a process more
            assert len(names) == max(16 * spark.sparkContext.defaultParallelism, int(partitions) // 8)
            assert sorted(r["id"] for r in table.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not folder.exists()


def test_tokenizers_go_from_a_worker_that_reads_sets(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_key": [1], "text": ["a few words that make a set"]})
    for run in (minhash_dedup._document_sets(minhash_dedup.DEFAULT, True), substring_dedup._band_rows(substring_dedup.PassageRule())):
        held = {WORD: tokenpieces.load(WORD)}
        monkeypatch.setattr(tokenpieces, "_loaded", held)
        list(run([batch]))
        assert not held
