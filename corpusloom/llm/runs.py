"""Maximal periodic runs of words in whole texts, by an enhanced suffix array of each text.

Suffixes of words are sorted by prefix doubling; texts that lie together in a batch are sorted at
once, each with symbols of its own, so that suffixes of different texts share nothing. Every LCP
interval of depth D is tested for branching tandems: of each of its children but the largest,
each suffix i asks whether suffix i + D or i - D lies in the interval too, by the inverse suffix
array. Two suffixes of an interval D apart are a square of period D; it branches if the word after
it breaks the period. Each run has one branching square for its period: rotating that to the left
as long as words agree gives the run. No tree nodes are made: intervals and children are ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import slices

#: Least words of a run; a run also holds its period twice.
LEAST = 12


def _levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the suffixes whose first symbol occurs again, and the ranks by the first 1, 2, 4, ... symbols.

    A rank is the place of the first suffix with this beginning. Only suffixes that still share theirs are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = start
    shared = ~(first & np.concatenate([first[1:], [True]]))
    kept, open_ = order, np.flatnonzero(shared)
    keep = shared.copy()
    levels, k = [rank], 1
    while len(open_):
        i = kept[open_]
        after = rank[np.minimum(i + k, n)].astype(np.int64)
        group = rank[i].astype(np.int64)
        by = np.argsort(group * (n + 2) + after + 1, kind="stable")
        i, group, after = i[by], group[by], after[by]
        kept = kept.copy()
        kept[open_] = i
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        start = open_[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        rank = rank.copy()
        rank[i] = start
        levels.append(rank)
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return kept[keep], levels


def _neighbours_lcp(suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it; 0 for the first."""
    n = len(levels[0]) - 1
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    out = np.zeros(len(suffixes), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        out[1:] += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return out


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Sparse table: least of 1, 2, 4, ... entries from each place."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        last, half = out[-1], 1 << (len(out) - 1)
        out.append(np.minimum(last[: len(last) - half], last[half:]))
    return out


def _extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix of the interval around suffix `at` in which all share `depth` symbols."""
    table = _minima(lcp)
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        row, w = table[k], 1 << k
        go = left - w + 1 >= 1
        go &= row[np.where(go, left - w + 1, 0)] >= depth
        left = left - np.where(go, w, 0)
        go = right + w <= len(lcp) - 1
        go &= row[np.where(go, right + 1, 0)] >= depth
        right = right + np.where(go, w, 0)
    return left, right


def squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and period of every branching tandem, symbols[i : i + D] == symbols[i + D : i + 2 D] with a symbol after it that breaks the period; and the ranks."""
    none = np.zeros(0, np.int64)
    n = len(symbols)
    suffixes, levels = _levels(symbols) if n else (none, [])
    if not len(suffixes):
        return none, none, levels
    suffixes = suffixes.astype(np.int64)
    lcp = _neighbours_lcp(suffixes, levels)
    inverse = np.full(n + 1, -1, np.int64)
    inverse[suffixes] = np.arange(len(suffixes))
    split = np.flatnonzero(lcp > 0)
    depth = lcp[split]
    left, right = _extents(lcp, split, depth)
    # Splits of one interval stand together, in order; each begins a child, and the interval's first child begins at its left end.
    by = np.lexsort((split, depth, left))
    split, depth, left, right = split[by], depth[by], left[by], right[by]
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    head = np.flatnonzero(new)
    interval = np.cumsum(new) - 1
    begins = np.concatenate([left[head], split])
    own = np.concatenate([np.arange(len(head)), interval])
    by = np.lexsort((begins, own))
    begins, own = begins[by], own[by]
    last = np.concatenate([own[1:] != own[:-1], [True]])
    ends = np.where(last, right[head][own], np.concatenate([begins[1:], [0]]) - 1)
    sizes = ends - begins + 1
    # All children but the largest, the first of equal ones.
    big = np.lexsort((-sizes, own))
    largest = np.zeros(len(own), bool)
    largest[big[np.concatenate([[True], own[big][1:] != own[big][:-1]])]] = True
    begins, own, sizes = begins[~largest], own[~largest], sizes[~largest]
    starts, periods = [none], [none]
    # Suffixes of smaller children number up to n log n: they are tested in pieces.
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
        count = sizes[at:to]
        place = np.repeat(begins[at:to] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        i, node = suffixes[place], head[np.repeat(own[at:to], count)]
        d, lo, hi = depth[node], left[node], right[node]
        for first, other in ((i, i + d), (i - d, i - d)):
            ok = (other >= 0) & (other < n)
            there = inverse[np.where(ok, other, n)]
            ok &= (there >= lo) & (there <= hi)
            f, p = first[ok], d[ok]
            end = f + 2 * p
            breaks = (end >= n) | (symbols[np.minimum(end, n - 1)] != symbols[np.minimum(f + p, n - 1)])
            starts.append(f[breaks])
            periods.append(p[breaks])
        at = to
    return np.concatenate(starts), np.concatenate(periods), levels


def _rotated(begins: np.ndarray, periods: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Where each run begins: as far left of `begins` as every word equals the one a period later. Equal ranks tell that 1, 2, 4, ... words agree."""
    begins = begins.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = begins - (1 << k)
        ok = back >= 0
        back = np.where(ok, back, 0)
        begins -= (ok & (levels[k][back] == levels[k][back + periods])).astype(np.int64) << k
    return begins


def runs(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of all runs, by start, then period."""
    starts, periods, levels = squares(symbols)
    found = np.unique(np.stack([starts + 2 * periods, periods], 1), axis=0)
    ends, periods = found[:, 0], found[:, 1]
    out = [np.zeros((0, 3), np.int64)]
    # Squares that end a run of period p and fit it twice have multiples of p as their periods. So, of squares with one end,
    # the least period counts, then the least of those that its run doesn't hold twice, and so on: each is over twice the last.
    while len(ends):
        new = np.concatenate([[True], ends[1:] != ends[:-1]])
        end, period = ends[new], periods[new]
        begin = _rotated(end - 2 * period, period, levels)
        out.append(np.stack([begin, end - begin, period], 1))
        rest = 2 * periods > (end - begin)[np.cumsum(new) - 1]
        ends, periods = ends[rest], periods[rest]
    begins, length, periods = np.concatenate(out).T
    keep = length >= np.maximum(least, 2 * periods)
    by = np.lexsort((periods[keep], begins[keep]))
    return begins[keep][by], length[keep][by], periods[keep][by]


def tail_looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with, for a tenth of all ids, a tail that repeats its first words. Rows without an id keep theirs."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, looped: bool = False, least: int = LEAST) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the text with each repetition collapsed.

    A run is a stretch of words with a least period q, of max(least, 2 q) words at least, that neither neighbouring word
    extends. Collapsing drops what any run contains after its first q words. Of equally long runs the first, then the one of
    the smaller period counts. Null, empty and blank texts have no runs and collapse to nothing; each row of a repeated doc_id
    is a text of its own. With `looped`, tails are edited first (tail_looped). Other columns of docs are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            if looped:
                texts = [tail_looped(w, d) for w, d in zip(texts, ids, strict=True)]
            symbols, base = [], 0
            for words in texts:
                known: dict[bytes, int] = {}
                symbols.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
                base += len(known)
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
            begins, length, period = runs(np.concatenate(symbols), least)
            cut = np.searchsorted(begins, bounds)
            rows = []
            for k, words in enumerate(texts):
                b, m, q = (x[cut[k] : cut[k + 1]] for x in (begins - bounds[k], length, period))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(b.tolist(), m.tolist(), q.tolist(), strict=True))
                best = None
                if len(b):
                    j = int(np.argmax(m))
                    best = (int(b[j]), int(m[j]), int(q[j]))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, b + q, 1)
                    np.add.at(edge, b + m, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                first = best or (None, None, None)
                rows.append((ids[k], len(b), *first, 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)
