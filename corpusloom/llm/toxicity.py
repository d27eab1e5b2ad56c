"""Toxicity: subword-bag embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word's features are its byte 3- to 6-grams and the whole word, hashed into buckets; a text's
vector is the mean of its words' mean bucket embeddings. The classifier is fitted on a bounded,
documented sample of labelled rows (fit_on) or on all of them (fit_whole); scoring runs where the texts lie. A misspelling keeps most
of its grams, and so most of its weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import _BYTE, mix, powers, slices, words_of

BITS = 20
GRAMS = (3, 4, 5, 6)
#: Labelled rows of each class that the fit reads, at most (about), picked by a hash of doc_id.
FIT_ROWS = 5000
DIM = 4
EPOCHS, MOST_EPOCHS = 7, 40
#: Minibatches of the fit, at least: few rows are gone through more often, up to MOST_EPOCHS times.
STEPS = 1200
BATCH = 50
#: A bucket that n texts of the sample have counts n / (n + RARE): rare ones weigh less, so that few are learnt by heart, and none goes.
RARE = np.float32(5)
#: Standard errors that a bucket's shares of the two classes' texts have to differ by to count at all. Without it, long texts
#: drown what tells in neutral grams that were learnt by heart.
CHANCE = 4.0


def _grams(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the whole word and each gram length: buckets by word or byte position, and each word's range in them."""
    data, starts, ends, _ = words_of(text)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    bucket = lambda h: (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
    yield bucket((sums[ends] - sums[starts]) * down[starts] + np.uint64(1)), np.arange(len(starts)), np.arange(1, len(starts) + 1)
    for n in GRAMS:
        if len(data) >= n:
            first = np.minimum(starts, len(data) - n + 1)
            yield bucket((sums[n:] - sums[:-n]) * down[: len(data) - n + 1]), first, np.maximum(first, ends - n + 1)


def features(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text; the weights of a text with words add up to 1."""
    _, starts, ends, bounds = words_of(text)
    of = np.ones(len(starts))
    for n in GRAMS:
        of += np.maximum(0, ends - starts - n + 1)
    ids, words = [], []
    for buckets, a, b in _grams(text):
        counts = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(a) else np.zeros(0, np.int64)
        ids.append(buckets[at])
        words.append(np.repeat(np.arange(len(a)), counts))
    ids, words = np.concatenate(ids), np.concatenate(words)
    doc = np.searchsorted(bounds, words, "right") - 1
    per = np.diff(bounds)
    weight = 1.0 / of[words] / per[doc]
    key, inverse = np.unique(doc * (1 << BITS) + ids, return_inverse=True)
    total = np.bincount(inverse, weight, len(key)).astype(np.float32)
    cut = np.searchsorted(key >> BITS, np.arange(len(text) + 1))
    return [((key[x:y] & ((1 << BITS) - 1)).astype(np.int32), total[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Model:
    """A bucket's log-odds (its embedding times the softmax's two columns' difference), and the bias."""

    odds: np.ndarray
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        _, starts, ends, bounds = words_of(text)
        total, of = np.zeros(len(starts)), np.zeros(len(starts))
        for buckets, a, b in _grams(text):
            sums = np.concatenate([[0.0], np.cumsum(self.odds[buckets], dtype=np.float64)])
            total += sums[b] - sums[a]
            of += b - a
        means = np.concatenate([[0.0], np.cumsum(total / np.maximum(of, 1))])
        n = np.diff(bounds)
        z = self.bias + (means[bounds[1:]] - means[bounds[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str | None], labels: np.ndarray, share: float, seed: int = 3) -> Model:
    """Train embeddings and softmax together. share: of label 1 among all labelled rows, for the bias.

    Without rows of both classes the score is the share itself, whatever the text.
    """
    # A few texts at a time bound the memory.
    return fit_features([row for at in range(0, len(texts), 25) for row in features(pa.array(texts[at : at + 25], pa.string()))], labels, share, seed)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, seed: int = 3, trust: np.ndarray | None = None) -> Model:
    """fit() on what features() made of the texts. trust: what buckets count, where more texts than these tell."""
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    if trust is None:
        texts_with = np.zeros((2, 1 << BITS), np.float32)
        for (ids, _), label in zip(rows, labels.tolist(), strict=True):
            texts_with[label][ids] += 1
        trust = _trust(texts_with, np.bincount(labels, minlength=2))
    # What counts for nothing is left out of the steps.
    rows = [(ids[own], weights[own]) for ids, weights in rows for own in [trust[ids] > 0]]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    e2, w2, b2 = np.full((1 << BITS, 1), 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    y = np.eye(2, dtype=np.float32)[labels]
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // len(rows))))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = 0.3 * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids = np.concatenate([rows[i][0] for i in own])
            weight = SCALE * (np.concatenate([rows[i][1] for i in own]) * trust[ids])
            n = np.array([len(rows[i][0]) for i in own])
            doc = np.repeat(np.arange(len(own)), n)
            x = np.stack([np.bincount(doc, weight * e[ids, k], len(own)) for k in range(DIM)], 1).astype(np.float32)
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - y[own]) / len(own)
            gw, gb, gx = x.T @ d, d.sum(0), d @ w.T
            touched, where = np.unique(ids, return_inverse=True)
            ge = np.stack([np.bincount(where, weight * gx[doc, k], len(touched)) for k in range(DIM)], 1).astype(np.float32)
            e2[touched] += (ge**2).mean(1, keepdims=True)
            e[touched] -= rate * ge / np.sqrt(e2[touched])
            w2 += gw**2
            b2 += gb**2
            w -= rate * gw / np.sqrt(w2)
            b -= rate * gb / np.sqrt(b2)
    sampled, share = labels.mean(), min(max(share, 1e-6), 1 - 1e-6)
    prior = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return Model((SCALE * trust * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32), float(b[1] - b[0] + prior))


def _trust(texts_with: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """What each bucket counts, 0 to 1, from how many texts of either class have it: the less, the better chance explains the difference."""
    n = texts_with.sum(0)
    p = n / texts.sum()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / texts).sum())
    z = np.abs(texts_with[0] / texts[0] - texts_with[1] / texts[1]) / spread
    return (np.maximum(0, 1 - (CHANCE / np.maximum(z, 1e-9)) ** 2) * n / (n + RARE)).astype(np.float32)


#: Means of many grams are small; the softmax sees them so many times larger.
SCALE = np.float32(15)


def _views(blobs: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers in each blob, where they lie: the sample is held once."""
    out = []
    for chunk in blobs.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [data[a:b].view(kind) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def fit_on(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled(doc_id, text, toxic): about `rows` of each class, by a hash of doc_id. Null labels and texts are left out.

    The sample is bounded, so one task trains on it, and is run again elsewhere if its executor
    is lost. The driver gets the bucket weights (4 MB) alone.
    """
    labelled = labelled.where("toxic in (0, 1) and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not n:
        return fit([], np.zeros(0, np.int64), 0.5)
    take = F.lit(False)
    for label, count in n.items():
        take = take | ((F.col("toxic") == label) & (F.abs(F.xxhash64("doc_id", F.lit(10)) % 1_000_000) < int(1_000_000 * min(1.0, rows / count))))
    share = n.get(1, 0) / sum(n.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 25):
                b = batch.slice(at, 25)
                ids, weights = zip(*features(b.column("text")), strict=True)
                blobs = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (ids, weights)]
                yield pa.RecordBatch.from_arrays([b.column("_order"), b.column("doc_id"), b.column("toxic"), *blobs], ["_order", "doc_id", "toxic", "ids", "weights"])

    def train(sample: pa.Table) -> pa.Table:
        order = pc.sort_indices(sample, [("_order", "ascending"), ("doc_id", "ascending")]).to_numpy()
        ids, weights = _views(sample["ids"], np.int32), _views(sample["weights"], np.float32)
        model = fit_features([(ids[i], weights[i]) for i in order], sample["toxic"].to_numpy().astype(np.int64)[order], share)
        return pa.table({"odds": pa.array([model.odds.tobytes()], pa.binary()), "bias": [model.bias]})

    sample = labelled.where(take).select(F.xxhash64("doc_id", "text").alias("_order"), "doc_id", "toxic", "text")
    key = labelled.schema["doc_id"].dataType.simpleString()
    sample = sample.mapInArrow(read, f"_order long, doc_id {key}, toxic int, ids binary, weights binary").withColumn("_all", F.lit(0))
    found = sample.groupBy("_all").applyInArrow(train, "odds binary, bias double").collect()
    if not found:
        return fit([], np.zeros(0, np.int64), share)
    return Model(np.frombuffer(found[0]["odds"], np.float32), found[0]["bias"])


#: Rows that one task of fit_whole trains on, about, and buckets whose counts are sent together.
TASK_ROWS, BLOCK = 8000, 4096


def fit_whole(labelled: DataFrame, task_rows: int = TASK_ROWS) -> Model:
    """Fit on all rows of labelled(doc_id, text, toxic), in parallel. Null labels and texts are left out.

    First all texts tell what each bucket counts. Then each task trains on about `task_rows` rows, dealt out by a hash, and a
    bucket's log-odds are averaged by how many of the tasks' texts have it. Up to task_rows rows are one task's.
    """
    labelled = labelled.where("toxic in (0, 1) and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    total = sum(n.values())
    share = n.get(1, 0) / total if total else 0.5
    if len(n) < 2:
        return fit([], np.zeros(0, np.int64), share)
    texts = np.array([n[0], n[1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 25):
                b = batch.slice(at, 25)
                for (ids, _), label in zip(features(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                    found[label][ids] += 1
        for k, part in enumerate(found.reshape(2, -1, BLOCK).swapaxes(0, 1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "x"])

    def trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("x").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int32).reshape(2, BLOCK).astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_trust(x, texts).tobytes()], pa.binary())], ["block", "x"])

    trust = np.zeros(1 << BITS, np.float32)
    for r in labelled.select("toxic", "text").mapInArrow(count, "block int, x binary").repartition("block").mapInArrow(trusted, "block int, x binary").collect():
        trust[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["x"], np.float32)
    shared = labelled.sparkSession.sparkContext.broadcast(trust)  # 4 MB

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trust, rows, order, labels = shared.value, [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 25):
                b = batch.slice(at, 25)
                for ids, weights in features(b.column("text")):
                    own = trust[ids] > 0
                    rows.append((ids[own], weights[own]))
                order += b.column("_order").to_pylist()
                labels += b.column("toxic").to_pylist()
        if len(set(labels)) < 2:
            return
        place = sorted(range(len(rows)), key=lambda i: (order[i], labels[i]))
        rows, labels = [rows[i] for i in place], np.array(labels)[place]
        model = fit_features(rows, labels, share, trust=trust)
        met = np.bincount(np.concatenate([ids for ids, _ in rows]), minlength=1 << BITS)
        own = np.flatnonzero(met)
        k, times, x = np.append(own, -1), np.append(met[own], len(rows)), np.append(model.odds[own], model.bias)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(times.astype(np.int64)), pa.array(x.astype(np.float64))], ["k", "n", "x"])

    dealt = labelled.select("toxic", "text", F.xxhash64("doc_id", "text").alias("_order")).repartition(-(-total // task_rows), "_order")
    found = dealt.mapInArrow(train, "k int, n long, x double").groupBy("k")
    # Rounded before they are added, so that the sums don't depend on the order of tasks.
    means = found.agg((F.sum((F.col("n") * F.round(F.col("x") * 1_000_000)).cast("long")) / F.sum("n") / 1_000_000).alias("x")).toArrow()  # one row a bucket that counts
    if not means.num_rows:
        return fit([], np.zeros(0, np.int64), share)
    k, x = means["k"].to_numpy(), means["x"].to_numpy()
    odds = np.zeros(1 << BITS, np.float32)
    odds[k[k >= 0]] = x[k >= 0]
    return Model(odds, float(x[k < 0][0]))


def toxicity_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and a score (0 to 1) of each whole text, named `name`. Null, empty and blank texts get the score of the bias alone.

    Columns of docs stay as they are, but for one of that name, which is replaced. Rows that
    repeat get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column("text")))], [*names, name])

    fields = StructType([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(run, fields)
