"""LM scoring: a log-bilinear model over the head's words, trained by noise-contrastive estimation in numpy.

Counts of all words come from all training texts. The model predicts each token from the two
before it: one of the head's words, which are as many as the corpus has, up to HEAD, or `other`,
whose probability mass is dealt out by add-one counts. The softmax has three levels: `other`, the
FREQUENT most frequent words and groups of the rest come first, then the GROUP classes of one group,
then the CLASS words of one class; words next to each other by frequency share a class. Each level
sums to 1, so every token's probability is normalised. Each
task trains on all the tokens it holds, from the same start, and the tasks' parameters are averaged:
each row by how often the tasks met it. The head's counts are broadcast; the counts of the other
words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, stored, word_hashes

#: Words that stand alone in the softmax's first level, classes of a group, and words of a class.
FREQUENT = 255
GROUP = 32
CLASS = 256
DIM = 16
#: Words whose counts and parameters every task holds (about 220 bytes each).
HEAD = 262_144
#: Tasks that train at most; each sends back the rows of words that it met.
REPLICAS = 4096
MINIBATCH = 4096
#: Contexts whose sums are computed at once.
BLOCK = 256
#: Noise draws: shared by a minibatch in the first level, and by a group's or class's tokens in it below.
NOISE, NEAR = 32, 4
#: Parameters are sent as 16-bit multiples of one part in so many.
FINE = 2048
RATE = 0.1
#: Bits of a hash's prefix by which words are looked up.
PREFIX = 20
END = np.uint64(0xE0D0F0D0C0)


@dataclass
class Vocabulary:
    """Sorted hashes of the head's words, their counts and their model ids (0: other); totals of the whole corpus."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int
    firsts: np.ndarray | None = None  # where the words of each prefix start; workers make it on first use

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, model id) of each hash; count 0 for words outside the head."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if self.firsts is None:
            self.firsts = np.searchsorted(self.words, np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX))
        # Hashes are spread evenly, so few words share a prefix: a step or two from the first of them.
        at, last = np.take(self.firsts, (h >> np.uint64(64 - PREFIX)).astype(np.int64)), len(self.words) - 1
        np.minimum(at, last, out=at)
        found = np.take(self.words, at)
        behind = np.flatnonzero((found < h) & (at < last))
        while len(behind):
            at[behind] += 1
            found[behind] = self.words[at[behind]]
            behind = behind[(found[behind] < h[behind]) & (at[behind] < last)]
        hit = found == h
        return np.where(hit, self.counts[at], 0), np.where(hit, self.ids[at], 0)

    def unigram(self) -> np.ndarray:
        """Add-one probabilities of `other` and the modelled words."""
        own = self.ids > 0
        c = np.ones(own.sum() + 1)
        c[self.ids[own]] += self.counts[own]
        c[0] = self.other_mass()
        return c / c.sum()

    def other_mass(self) -> int:
        """Add-one mass of all words that aren't modelled, and of one that was never seen."""
        own = self.ids > 0
        return int(self.total - self.counts[own].sum() + self.distinct - own.sum() + 1)


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text's tokens start."""
    h, bounds = word_hashes(text)
    out = np.insert(h, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def count_words(train: DataFrame) -> DataFrame:
    """(h, c): how often each word (by hash), and the end, occurs in train(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, c = np.unique(tokens_of(b.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(words: DataFrame) -> Vocabulary:
    """The head: all words as frequent as the HEAD most frequent ones allow. words: (h, c), a stored table."""
    n = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # How many words have each count is a short table: its length is at most the root of twice the corpus.
    by = words.groupBy("c").agg(F.count("*").alias("n")).where(F.col("c") > 1).orderBy(F.desc("c")).limit(HEAD).toPandas()
    fits = by[by["n"].cumsum() <= HEAD]
    least = int(fits["c"].min()) if len(fits) else 0
    head = words.where(F.col("c") >= least).toPandas() if least else words.limit(0).toPandas()
    head = head.sort_values(["c", "h"], ascending=[False, True], kind="stable")
    h = head["h"].to_numpy(np.int64).view(np.uint64)
    ids = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return Vocabulary(h[order], head["c"].to_numpy(np.int64)[order], ids[order], int(n[0]), int(n[1]))


def _contexts(ids: np.ndarray, starts: np.ndarray, words: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The model ids one and two tokens before each token; words + 1 stands before a text."""
    one = np.concatenate([[words + 1], ids[:-1]])
    one[starts] = words + 1
    two = np.concatenate([[words + 1], one[:-1]])
    two[starts] = words + 1
    return one, two


def _first(ids: np.ndarray) -> np.ndarray:
    """Where each model id stands in the first level."""
    return np.where(ids <= FREQUENT, ids, FREQUENT + 1 + (ids - FREQUENT - 1) // (CLASS * GROUP))


def _log_sums(q: np.ndarray, x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials of q @ x. held: float32 numbers to overwrite, as many as that has at least."""
    s = held[: len(q) * x.shape[1]].reshape(len(q), x.shape[1])
    np.matmul(q, x, out=s)
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
        sums = s @ np.ones(s.shape[1], s.dtype)
    if np.isfinite(sums).all() and sums.min() > 1e-30:
        return np.log(sums)
    s = q @ x
    top = s.max(1, keepdims=True)
    return np.log(np.exp(s - top).sum(1)) + top[:, 0]


def _sigmoid(x: np.ndarray, n: int) -> np.ndarray:
    """1 / (1 + exp(-x)) / n, in the place of x."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(x.dtype.type(1 / n), x, out=x)


@dataclass
class Model:
    one: np.ndarray  # (words + 2, DIM), of the token before
    two: np.ndarray  # of the one before that
    top: np.ndarray  # (first level, DIM)
    top_bias: np.ndarray
    classes: np.ndarray  # (classes of the words after the FREQUENT ones, DIM), within their groups
    class_bias: np.ndarray
    word: np.ndarray  # (words after the FREQUENT ones, DIM), within their classes
    word_bias: np.ndarray

    @classmethod
    def plain(cls, unigram: np.ndarray) -> Model:
        """The unigram model: no row has a direction."""
        n, rare = len(unigram), unigram[FREQUENT + 1 :]
        top, of = np.bincount(_first(np.arange(n)), unigram), np.arange(len(rare)) // CLASS
        mid = np.bincount(of, rare)
        zero = lambda k: np.zeros((k, DIM), np.float32)
        part = lambda x, whole: np.log(x / whole).astype(np.float32)
        return cls(
            zero(n + 1), zero(n + 1), zero(len(top)), part(top, 1.0),
            zero(len(mid)), part(mid, top[FREQUENT + 1 + np.arange(len(mid)) // GROUP]), zero(len(rare)), part(rare, mid[of]),
        )

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        rng, m = np.random.default_rng(5), cls.plain(unigram)
        for x, _ in m.tables():
            x[:] = rng.standard_normal(x.shape, np.float32) * np.float32(0.1)
        return m

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Directions and biases of all rows, in the order in which they are sent."""
        return [(self.one, None), (self.two, None), (self.top, self.top_bias), (self.classes, self.class_bias), (self.word, self.word_bias)]

    def cast(self, kind: type) -> Model:
        """With directions of this number type: half as long for the way to the tasks."""
        return Model(self.one.astype(kind), self.two.astype(kind), self.top.astype(kind), self.top_bias, self.classes.astype(kind), self.class_bias, self.word.astype(kind), self.word_bias)

    def log_probabilities(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities; first-level sums are made once per distinct context, the others group by group and class by class."""
        key, where = np.unique(one * len(self.one) + two, return_inverse=True)
        z, top = np.empty(len(key), np.float32), np.column_stack([self.top, self.top_bias])
        a, b = np.divmod(key, len(self.one))
        q = np.column_stack([np.take(self.one, a, axis=0) + np.take(self.two, b, axis=0), np.ones(len(key), np.float32)])  # the last column meets the biases
        held = np.empty(BLOCK * max(len(top), GROUP, CLASS), np.float32)
        for at in range(0, len(key), BLOCK):
            z[at : at + BLOCK] = _log_sums(q[at : at + BLOCK], top.T, held)
        q = np.take(q, where, axis=0)
        out = np.einsum("nd,nd->n", q, np.take(top, _first(ids), axis=0)).astype(np.float64) - z[where]
        rest = np.flatnonzero(ids > FREQUENT)
        rest = rest[np.argsort(ids[rest], kind="stable")]
        v, q = ids[rest] - FREQUENT - 1, np.take(q, rest, axis=0)
        for x, bias, rows, width in ((self.classes, self.class_bias, v // CLASS, GROUP), (self.word, self.word_bias, v, CLASS)):
            x = np.column_stack([x, bias])
            own = np.einsum("nd,nd->n", q, np.take(x, rows, axis=0))
            cuts = np.append(np.flatnonzero(np.diff(rows // width, prepend=-1)), len(rows))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = rows[lo] // width * width
                for part in range(lo, hi, BLOCK):
                    to = min(hi, part + BLOCK)
                    own[part:to] -= _log_sums(q[part:to], x[at : at + width].T, held)
            out[rest] += own
        return out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the float32 rows from each start to the next. Complex numbers add two columns at a time, which halves numpy's steps."""
    return np.add.reduceat(x.view(np.complex64), starts, axis=0).view(np.float32)


class Trainer:
    """NCE by Adagrad on minibatches, at all levels. A minibatch's examples share the first level's noise; those of a group or class share noise that is even within it."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        mass = np.bincount(_first(np.arange(len(unigram))), unigram)
        self.edges, self.base = np.cumsum(mass), np.log(NOISE * mass).astype(np.float32)
        self.sums = [np.full((len(x), 2), 1e-6, np.float32) for x, _ in model.tables()]

    def _step(self, k: int, rows: np.ndarray, grads: np.ndarray, bias: np.ndarray | None = None) -> None:
        x, b = self.m.tables()[k]
        keys = np.sort(rows << 32 | np.arange(len(rows)))
        rows, order = keys >> 32, keys & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        own, total, sums = rows[starts], _sums(np.take(grads, order, axis=0), starts), self.sums[k]
        seen = np.take(sums, own, axis=0)
        seen[:, 0] += np.einsum("nd,nd->n", total, total) / DIM
        if bias is not None:
            g = np.add.reduceat(bias[order], starts)
            seen[:, 1] += g**2
            b[own] -= RATE * g / np.sqrt(seen[:, 1])
        sums[own] = seen
        x[own] = np.take(x, own, axis=0) - RATE * total / np.sqrt(seen[:, :1])

    def learn(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.m
        for at in range(0, len(ids), MINIBATCH):
            w, a, b = ids[at : at + MINIBATCH], one[at : at + MINIBATCH], two[at : at + MINIBATCH]
            t, q = _first(w), np.take(m.one, a, axis=0) + np.take(m.two, b, axis=0)
            noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
            r, n = np.take(m.top, t, axis=0), m.top[noise]
            good = np.einsum("nd,nd->n", q, r) + m.top_bias[t] - self.base[t]
            bad = q @ n.T + (m.top_bias[noise] - self.base[noise])
            dg, db = -_sigmoid(-good, len(w)), _sigmoid(bad, len(w))
            gq = dg[:, None] * r + db @ n
            rest = np.flatnonzero(w > FREQUENT)
            if len(rest):
                rest = rest[np.argsort(w[rest], kind="stable")]
                v = w[rest] - FREQUENT - 1
                own = np.take(q, rest, axis=0)
                gq[rest] += self._learn_within(3, v // CLASS, GROUP, own, len(w)) + self._learn_within(4, v, CLASS, own, len(w))
            self._step(2, np.concatenate([t, noise]), np.concatenate([dg[:, None] * q, db.T @ q]), np.concatenate([dg, db.sum(0)]))
            self._step(0, a, gq)
            self._step(1, b, gq)

    def _learn_within(self, k: int, v: np.ndarray, width: int, q: np.ndarray, n: int) -> np.ndarray:
        """A step of table k's rows v, in ascending order, within their runs of `width` rows; returns the gradients of their contexts."""
        x, bias = self.m.tables()[k]
        new = np.diff(v // width, prepend=-1) > 0
        cuts, of = np.flatnonzero(new), np.cumsum(new) - 1
        low = v[cuts] // width * width
        size = np.minimum(width, len(x) - low)[:, None]
        noise = low[:, None] + np.minimum((self.rng.random((len(low), NEAR), np.float32) * size).astype(np.int64), size - 1)
        base = np.log(NEAR / size).astype(np.float32)
        r, near = np.take(x, v, axis=0), np.take(x[noise], of, axis=0)
        good, bad = np.einsum("nd,nd->n", q, r) + bias[v] - base[of, 0], np.einsum("nkd,nd->nk", near, q) + (bias[noise] - base)[of]
        dg, db = -_sigmoid(-good, n), _sigmoid(bad, n)
        grads = _sums((db[:, :, None] * q[:, None, :]).reshape(len(v), -1), cuts).reshape(-1, DIM)
        self._step(k, np.concatenate([v, noise.ravel()]), np.concatenate([dg[:, None] * q, grads]), np.concatenate([dg, np.add.reduceat(db, cuts, axis=0).ravel()]))
        return dg[:, None] * r + np.einsum("nk,nkd->nd", db, near)


def _rows_of(blob: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blob.to_pylist()), kind).reshape(-1, width)


def train(texts: DataFrame, vocab: Vocabulary) -> Model:
    """One pass over all of texts(text), in parallel; each row averaged by how often the tasks met it. Without texts: the unigram model."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    unigram = vocab.unigram()
    model = Model.plain(unigram)
    if not vocab.total:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        chances = v.unigram()
        model, flat = Model.start(chances), Model.plain(chances)
        trainer, met = Trainer(model, chances, 17), [np.zeros(len(x), np.int64) for x, _ in model.tables()]
        for b in slices(batches):
            h, starts = tokens_of(b.column("text"))
            _, ids = v.look_up(h)
            one, two = _contexts(ids, starts[:-1], len(chances) - 1)
            trainer.learn(ids, one, two)
            rare = ids[ids > FREQUENT] - FREQUENT - 1
            for n, rows in zip(met, (one, two, _first(ids), rare // CLASS, rare), strict=True):
                n += np.bincount(rows, minlength=len(n))
        base = 0
        for n, (x, bias), (_, first) in zip(met, model.tables(), flat.tables(), strict=True):
            for at in range(0, len(n), 20_000):
                own = at + np.flatnonzero(n[at : at + 20_000])
                shift = bias[own] - first[own] if bias is not None else np.zeros(len(own), np.float32)
                sent = np.clip(np.round(np.column_stack([x[own], shift]) * FINE), -32767, 32767).astype("<i2")
                ends = pa.py_buffer((np.arange(len(own) + 1) * 2 * (DIM + 1)).astype(np.int32))
                blob = pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(sent.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array((base + own).astype(np.int32)), pa.array(n[own]), blob], ["k", "n", "x"])
            base += len(n)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n, x = [], [], []
        for b in batches:
            k.append(b.column("k").to_numpy())
            n.append(b.column("n").to_numpy())
            x.append(_rows_of(b.column("x"), "<i2", DIM + 1))
        if k and sum(map(len, k)):
            own, where = np.unique(np.concatenate(k), return_inverse=True)
            n, x = np.concatenate(n), np.concatenate(x)
            of = np.bincount(where, n)  # whole numbers below 2^53, so that the order of rows changes nothing
            means = np.stack([np.bincount(where, n * x[:, d].astype(np.float64)) / of for d in range(DIM + 1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([own.astype("<i4").tobytes()], pa.binary()), pa.array([np.round(means).astype("<i2").tobytes()], pa.binary())], ["k", "x"])

    sent = texts.select("text").coalesce(REPLICAS).mapInArrow(run, "k int, n long, x binary").repartition("k")
    found = sent.mapInArrow(average, "k binary, x binary").toArrow()  # 38 bytes a row, at most HEAD words' rows
    ends = np.cumsum([len(x) for x, _ in model.tables()])
    for ks, xs in zip(found["k"], found["x"], strict=True):
        k, x = np.frombuffer(ks.as_py(), "<i4"), np.frombuffer(xs.as_py(), "<i2").reshape(-1, DIM + 1) / np.float32(FINE)
        for (rows, bias), end in zip(model.tables(), ends, strict=True):
            own = (k < end) & (k >= end - len(rows))
            rows[k[own] - (end - len(rows))] = x[own, :DIM]
            if bias is not None:
                bias[k[own] - (end - len(rows))] += x[own, DIM]
    return model


def score(docs: DataFrame, held_out, keep: list[str]) -> DataFrame:
    """Score every whole text of docs(text, *keep). held_out: condition on docs; those rows aren't learnt from.

    Returns keep, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (the model's), log10. A null or empty text is one end token. Rows that repeat are
    scored one by one; an empty table gives an empty result; with nothing to learn from, N and
    V are 0. Other columns are dropped.
    """
    docs = docs.select("text", *keep, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learnt = docs.where("not held_out")
    words = stored(count_words(learnt), "words")
    vocab = vocabulary(words)
    model = train(learnt, vocab)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model.cast(np.float16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value[0], shared.value[1].cast(np.float32)
        for b in slices(batches):
            h, starts = tokens_of(b.column("text"))
            c, ids = v.look_up(h)
            logs, at = np.log10(c + 1), starts[:-1]
            own = m.log_probabilities(ids, *_contexts(ids, at, len(m.one) - 2)) / np.log(10)
            sums = [np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), logs, own, (ids == 0).astype(np.int64), np.where(ids == 0, logs, 0.0))]
            rest = np.flatnonzero(c == 0)
            doc = np.searchsorted(starts, rest, "right") - 1
            order = np.lexsort((h[rest], doc))
            d, w = doc[order], h[rest][order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(d)))
            ends = np.searchsorted(d[first], np.arange(len(at) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (w[first].view(np.int64), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in [*keep, "held_out"]), pa.array(np.diff(starts).astype(np.int64)), *map(pa.array, sums), *lists], [*keep, "held_out", "n_tokens", "known", "logs", "own", "others", "other_logs", "rest", "times"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    raw = docs.mapInArrow(run, f"{types}, n_tokens long, known long, logs double, own double, others long, other_logs double, rest array<long>, times array<long>")
    raw = stored(raw.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = raw.select("row", F.explode(F.arrays_zip("rest", "times")).alias("z")).select("row", F.col("z.rest").alias("h"), F.col("z.times").alias("times"))
    rare = rare.join(words, "h").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = raw.drop("rest", "times").join(rare, "row", "left").withColumns({"rare_known": F.coalesce("rare_known", F.lit(0)), "rare_logs": F.coalesce("rare_logs", F.lit(0.0))})
    each = float(np.log10(vocab.total + vocab.distinct + 1))
    return out.select(
        *keep, "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * each).alias("base_score"),
        (F.col("own") + F.col("other_logs") + F.col("rare_logs") - F.col("others") * float(np.log10(vocab.other_mass()))).alias("score"),
    )
