"""Language of whole texts by a blended-spectrum kernel, Nystroem landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import as_text, having, materialise, text_slices

UNKNOWN = "und"
#: n-grams of 1 to 4 bytes of the lower-cased text, in a table of 2**20 places.
LONGEST, TABLE_BITS = 4, 20


@dataclass(frozen=True)
class FitRule:
    """Bounds of the fit for each language, all of which are learnt: sampled texts, landmarks, n-grams, preferred length; the most landmarks
    of all languages together; ridge; what a text must reach, to be of a learnt language, of the share
    of n-grams known that all but 2 % of the sampled texts reach; the sampled texts besides landmarks without which nothing is said of that."""

    texts: int = 200
    landmarks: int = 40
    grams: int = 8000
    chars: int = 8000
    all_landmarks: int = 2000
    ridge: float = 0.01
    seed: int = 11
    evidence: float = 0.35
    aside: int = 20


@dataclass
class Model:
    """columns: the place of each n-gram slot among the n-grams held, or -1. weights: n-gram by language, the landmarks' weights added up over
    those that hold the n-gram. known: the least share of a text's longer n-grams that are held, for one of a learnt language."""

    languages: list[str]
    columns: np.ndarray
    weights: np.ndarray
    known: float


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _slots(text: pa.Array):
    """Of each n: the slot of every n-gram that lies in one row, and its row. A blank goes before and three go behind each text."""
    joined = pc.binary_join_element_wise(" ", pc.utf8_lower(text), " " * (LONGEST - 1), "").cast(pa.large_string())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    low = _FOLD[np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    code = np.zeros(len(low), np.uint32)
    for n in range(1, LONGEST + 1):
        code = (code[: len(low) - n + 1] << np.uint32(8)) | low[n - 1 :]
        mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        inside = row[: len(code)] == row[n - 1 :]
        yield (mixed[inside] >> np.uint32(32 - TABLE_BITS)).astype(np.int64), row[: len(code)][inside]


def held_grams(text: pa.Array, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, share): each held n-gram of each text once, by row; and the share of a text's n-grams of 3 and 4 bytes that are held."""
    n = len(text)
    keys, seen, held = [], np.zeros(n), np.zeros(n)
    for length, (slot, row) in enumerate(_slots(text), 1):
        key = np.sort(row * (1 << TABLE_BITS) + slot)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        own = columns[key & ((1 << TABLE_BITS) - 1)] >= 0
        if length >= 3:
            seen += np.bincount(key >> TABLE_BITS, minlength=n)
            held += np.bincount(key[own] >> TABLE_BITS, minlength=n)
        keys.append(key[own])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> TABLE_BITS, columns[key & ((1 << TABLE_BITS) - 1)], held / np.maximum(seen, 1)


def _common(column: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """The number of n-grams that a text has in common with each of n landmarks; bits holds the landmarks of an n-gram."""
    return np.unpackbits(bits[column], axis=1, count=n).sum(axis=0, dtype=np.float64) if n else np.zeros(0)


def _kernels(text: pa.Array, columns: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kernel, share): common n-grams over the geometric mean of both numbers of n-grams, text by landmark, a text at a time; and held_grams' share."""
    out, share = np.zeros((len(text), len(sizes))), np.zeros(len(text))
    for k in range(len(text)):
        _, column, share[k : k + 1] = held_grams(text.slice(k, 1), columns)
        out[k] = _common(column, bits, len(sizes)) / np.sqrt(max(1, len(column))) / sizes
    return out, share


def fit(docs: DataFrame, rule: FitRule = FitRule()) -> Model:
    """Learns from docs(doc_id, text, lang), all of them training rows, on a sample bounded by rule.

    The sample takes at most rule.texts rows of each language, those of at most rule.chars characters first, by the least
    hash of doc_id and text, so it is the same for the same rows; every language is learnt, whatever its number of rows.
    Null or blank languages and null or empty texts aren't sampled. Without any row the model has no language.
    """
    rows = docs.where("lang is not null and lang <> '' and text is not null and text <> ''")
    at = F.xxhash64("doc_id", "text", F.lit(rule.seed)) / F.lit(2.0**64) + 0.5
    rows = rows.select("lang", "text", (at + (F.length("text") > rule.chars).cast("int")).alias("at"))
    sizes = rows.groupBy("lang").agg(F.count_if(F.col("at") <= 1).alias("short"), F.count_if(F.col("at") > 1).alias("long"))
    few = 2 * rule.texts + 20
    share = F.when(F.col("short") > few, few / F.col("short")).when(F.col("short") == few, 1.0).otherwise(F.when(F.col("long") > few, 1 + few / F.col("long")).otherwise(2.0))
    shares = materialise(sizes.select("lang", share.alias("share")), "languages")
    near = having(rows, shares, "lang", "inner").where("at <= share").groupBy("lang", "text").agg(F.min("at").alias("at"))
    sample = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("n") <= rule.texts)
    sample = sample.select("lang", "text", "n").toPandas().sort_values(["lang", "n"])
    if not len(sample):
        return Model([], np.full(1 << TABLE_BITS, -1), np.zeros((0, 0)), 0.0)
    languages = sorted(set(sample["lang"]))
    texts, label, landmark = [], [], []
    marks_each = max(1, min(rule.landmarks, rule.all_landmarks // len(languages)))
    for k, name in enumerate(languages):
        own = sample.loc[sample["lang"] == name, "text"].tolist()[: rule.texts]
        landmark += range(len(texts), len(texts) + min(marks_each, len(own)))
        texts += own
        label += [k] * len(own)
    text = pa.array(texts, pa.string())
    columns = np.full(1 << TABLE_BITS, -1, np.int32)
    for k in range(len(languages)):
        count = np.zeros(1 << TABLE_BITS, np.int32)
        for at in [i for i in landmark if label[i] == k]:
            for slot, _ in _slots(text.slice(at, 1)):
                count[np.unique(slot)] += 1
        most = np.flatnonzero(count)
        columns[most[np.lexsort((most, -count[most]))][: rule.grams]] = 0
    held = np.flatnonzero(columns == 0)
    columns[held] = np.arange(len(held))
    bits, sizes = np.zeros((len(held), (len(landmark) + 7) // 8), np.uint8), np.zeros(len(landmark))
    for k, at in enumerate(landmark):
        _, column, _ = held_grams(text.slice(at, 1), columns)
        bits[column, k // 8] |= np.uint8(128 >> (k % 8))
        sizes[k] = np.sqrt(max(1, len(column)))
    found, share = _kernels(text, columns, bits, sizes)
    marks = found[landmark]
    values, vectors = np.linalg.eigh((marks + marks.T) / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    mapped = found @ root
    target = np.where(np.array(label)[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    balance = 1 / np.bincount(label)[label]
    gram = (mapped * balance[:, None]).T @ mapped + rule.ridge * np.eye(mapped.shape[1])
    each = (root @ np.linalg.solve(gram, (mapped * balance[:, None]).T @ target)) / sizes[:, None]
    weights = np.zeros((len(held), len(languages)), np.float32)
    for at in range(0, len(held), 4096):
        weights[at : at + 4096] = np.unpackbits(bits[at : at + 4096], axis=1, count=len(landmark)) @ each
    others = np.setdiff1d(np.arange(len(texts)), landmark)
    known = rule.evidence * float(np.quantile(share[others], 0.02)) if len(others) >= rule.aside else 0.0
    return Model(languages, columns, weights, known)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, evidence) of every row of docs(doc_id, text), from the whole text alone.

    score, 0 to 1, is the ridge value of the language scaled from -1..1; of equally likely languages the first in
    order is taken. evidence is the share of the text's n-grams of 3 and 4 bytes that the model holds. A text that is null or has no letter, and every text when nothing was learned, is `und` with
    score 0. Repeated rows get equal results; further columns are ignored; an empty table gives an empty result.
    """
    return annotated(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score", "evidence")


def annotated(docs: DataFrame, model: Model) -> DataFrame:
    """(row, text, letters, lang_pred, score, evidence): row holds the other columns of docs, letters says whether the text has one."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    others = docs.select(*[c for c in docs.columns if c != "text"])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others.schema)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part in text_slices(batch, "text", 600_000):
                text = as_text(part.column("text"))
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                row, column, share = held_grams(text, m.columns)
                if m.languages:
                    many = np.bincount(row, minlength=len(part))
                    value = np.stack([np.bincount(row, weights=m.weights[column, k], minlength=len(part)) for k in range(len(m.languages))], axis=1) / np.sqrt(np.maximum(many, 1))[:, None]
                    best = np.where(letters, value.argmax(axis=1), len(m.languages))
                    score = np.where(letters, np.clip((value.max(axis=1) + 1) / 2, 0, 1), 0.0)
                else:
                    best, score = np.zeros(len(part), int), np.zeros(len(part))
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "text": part.column("text"), "letters": pa.array(letters), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score.astype(np.float64)), "evidence": pa.array(share)})

    rows = docs.select(F.struct(*others.columns).alias("row"), "text")
    return rows.mapInArrow(run, f"row struct<{fields}>, text string, letters boolean, lang_pred string, score double, evidence double")


def held_out(doc_id):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, rule: FitRule = FitRule()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang), learnt from those not held out."""
    return predict(docs, _learnt(docs, rule)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _learnt(docs: DataFrame, rule: FitRule) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))), rule)


def in_known_languages(docs: DataFrame, rule: FitRule = FitRule()) -> DataFrame:
    """The rows of docs, with all their columns, whose text the learnt languages account for.

    A row goes if its text is null or has no letter, or if the model holds too few of its n-grams: fewer than rule.evidence of the share
    that it holds of all but 2 % of the sampled texts, landmarks aside. So a text of a script or language that no row names goes, whatever
    its ridge values. Where nothing can be learnt, or fewer than rule.aside sampled texts
    are no landmarks, every text with a letter stays. Rows are judged each for itself,
    whatever ids they share; null ids and repeated rows stay as they are; an empty table stays empty.
    """
    model = _learnt(docs, rule)
    judged = annotated(docs, model).where("letters and text is not null")
    judged = judged.where(F.col("evidence") >= model.known) if model.languages else judged
    return judged.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
