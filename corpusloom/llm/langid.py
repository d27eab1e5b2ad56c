"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, each permuted by its place; a text's vector bundles (adds) those of its
trigrams. A language's prototype bundles its texts' unit vectors; a text goes to the prototype
with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import slices
from corpusloom.operators.ordering import percentiles

DIM = 1024
#: Labelled documents of each language that the prototypes are made of, at most (about), by a hash of doc_id.
FIT_ROWS = 10_000
#: Prototypes that a text is compared with at once. A prototype takes 4 KB in every task; there is one for each label.
LANGUAGES = 512
#: Texts whose trigrams are bundled by one matrix product.
GROUP = 32

_letters: dict[int, np.ndarray] = {}
_classes: np.ndarray | None = None


def _letter(code: int) -> np.ndarray:
    v = _letters.get(code)
    if v is None:
        if len(_letters) > 20_000:
            _letters.clear()
        v = _letters[code] = np.random.default_rng([11, code]).integers(0, 2, DIM, np.int8) * 2 - 1
    return v


def _alphabet() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or a space for what is no letter."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _classes = table
    return _classes


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the letters, runs of other characters being one space, and their counts."""
    codes = _alphabet()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


_grams: dict[int, int] = {}
_vectors = np.zeros((0, DIM), np.int8)
#: Trigram vectors that a worker keeps (1 KB each), and how many it takes at once (4 KB each); when full it starts afresh.
KEPT, STEP = 40_000, 4096


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of up to KEPT trigrams, made where they aren't kept."""
    global _vectors
    if not len(_vectors):
        _vectors = np.zeros((KEPT, DIM), np.int8)
    if len(_grams) + sum(g not in _grams for g in grams.tolist()) > KEPT:
        _grams.clear()
    mask = (1 << 21) - 1
    for g in grams.tolist():
        if g not in _grams:
            _vectors[len(_grams)] = np.roll(_letter(g >> 42), 2) * np.roll(_letter((g >> 21) & mask), 1) * _letter(g & mask)
            _grams[g] = len(_grams)
    return _vectors[[_grams[g] for g in grams.tolist()]].astype(np.float32)


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of texts; zeros for null texts and texts without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    for start in range(0, len(texts), GROUP):
        found = [_trigrams(t or "") for t in texts[start : start + GROUP]]
        grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        if not len(grams):
            continue
        counts = np.zeros((len(found), len(grams)), np.float32)
        at = 0
        for i, (g, c) in enumerate(found):
            counts[i, where[at : at + len(g)]] = c
            at += len(g)
        for a in range(0, len(grams), STEP):
            out[start : start + GROUP] += counts[:, a : a + STEP] @ _gram_vectors(grams[a : a + STEP])
    norms = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def prototypes(labelled: DataFrame, rows: int | None = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototype per language) from labelled(doc_id, text, lang), of all its rows if rows is None. Null texts and labels are left out."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    if rows is not None:
        counts = labelled.groupBy("lang").count().orderBy("lang").collect()
        if not counts:
            return [], np.zeros((0, DIM), np.float32)
        share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows / r["count"])))])
        labelled = labelled.where(F.abs(F.xxhash64("doc_id", F.lit(3)) % 1_000_000) < share[F.col("lang")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, v in zip(b.column("lang").to_pylist(), text_vectors(b.column("text").to_pylist()), strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        langs = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([x for x in langs for _ in range(DIM)], pa.string()), pa.array(list(range(DIM)) * len(langs), pa.int32()), pa.array(np.concatenate([np.zeros(0), *sums.values()]))], ["lang", "i", "x"])

    # Rounded before they are added, so that the sums don't depend on the order of tasks.
    parts = labelled.mapInArrow(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1_000_000).cast("long")).alias("x"))
    table = parts.toPandas()
    langs = sorted(table["lang"].unique())
    out = np.zeros((len(langs), DIM))
    out[table["lang"].map({x: k for k, x in enumerate(langs)}), table["i"]] = table["x"]
    norms = np.sqrt((out**2).sum(1, keepdims=True))
    return langs, (out / np.where(norms > 0, norms, 1)).astype(np.float32)


def nearest(v: np.ndarray, protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, cosine) of each vector's nearest prototype, the first of equals; LANGUAGES prototypes at a time."""
    best, top = np.zeros(len(v), np.int64), np.full(len(v), -np.inf, np.float32)
    for a in range(0, len(protos), LANGUAGES):
        cos = v @ protos[a : a + LANGUAGES].T
        at = cos.argmax(1)
        more = cos[np.arange(len(v)), at]
        best, top = np.where(more > top, at + a, best), np.maximum(top, more)
    return best, top


def size_class(text: Column | str) -> Column:
    """Binary digits of the number of characters: cosines grow with the length."""
    return F.length(F.bin(F.char_length(text).cast("long")))


def usual_cosines(labelled: DataFrame) -> dict[int, float]:
    """For each size class, the cosine that all but a hundredth of labelled(size, score) reach: exact, of all rows, which are ranked in parallel. Nothing without rows."""
    return {r["size"]: r["least"] for r in percentiles(labelled, ["size"], "score", {"least": ("linear", 0.01)}).collect()}


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, or `names`: the language of the nearest prototype and its cosine (0 where negative).

    Only the text is looked at. A null text, or one without a letter, is `und` with score 0; so
    is every text if no language was learnt. Ties go to the first language by code point.
    Columns of docs stay, but for ones of those names, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats a language
    docs = docs.drop(*names)
    every = [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = shared.value
        for b in slices(batches):
            v = text_vectors(b.column("text").to_pylist())
            known = np.abs(v).sum(1) > 0
            if langs:
                best, top = nearest(v, protos)
                pred = [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                score = np.where(known, np.clip(top, 0, 1), 0.0)
            else:
                pred, score = ["und"] * len(v), np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], every)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(names[0], "string").add(names[1], "double"))
