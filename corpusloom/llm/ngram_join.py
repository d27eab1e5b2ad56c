"""N-gram Jaccard join: count vectors of shingle groups in R-trees, bounds by coordinate minima, exact checks.

Every text becomes its set of distinct n-word shingles. Equal sets are one node. Two nodes can
link only if they share one of their first shingles in a common order of all shingles (a set of
n needs an overlap of at least ceil(least * n), so it is enough to look at the first
n - ceil(least * n) + 1). So the nodes are range-partitioned by (first shingle, size): neighbours
in that order are the nodes that may link. A shingle's nodes are cut where sizes leave a gap that
no link spans, and into cells of bounded size; a hot shingle's cells lie in several partitions.

In each cell an R-tree over the nodes' count vectors finds the nodes whose summed coordinate
minima allow a link. Those pairs are held against each other by bitmaps of a fourth of the hashes,
and what may still link is checked on the whole sets. Only links between different
components are of interest. So first each node is checked with a few of the nodes that the trees
find for it, which joins groups of near copies without listing their pairs. Then the trees search
the cells that still span several components, between components alone, a bounded number of pairs
for each two components at a time, until all that the bound allows are checked or joined. Nodes
outside a hot shingle's largest component also visit its other cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, mix, slices, small, stored, word_hashes
from corpusloom.llm.components import components

#: Groups of shingles, coordinates of a node's point.
GROUPS = 256
#: Nodes in a cell, at most, and in an R-tree's leaf.
CELL, LEAF = 256, 16
#: Pairs of the same two components that a cell gives at first; each further round gives GROWTH times as many.
FIRST_PAIRS, GROWTH = 4, 8
#: Documents read for the order of shingles: so many (about), or this share of all. The order changes the cost, never the result.
ORDER_DOCS, ORDER_SHARE = 20_000, 0.02
#: Shingles put last in that order, at most (12 bytes each in every task).
COMMON = 100_000
#: A prefix row holds the upper bits of a shingle's hash and, below, the set's size, or SIZE for larger ones.
SIZE_BITS = 20
SIZE = (1 << SIZE_BITS) - 1
#: Rows of three numbers that are sent to every task rather than the texts being shuffled.
SMALL = 200_000
#: Digests that a task remembers, so that it gives the prefix of copies once.
SEEN = 1 << 18


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle, a blank one none."""
    h, bounds = word_hashes(text)
    grams = np.zeros(len(h), np.uint64)
    for i in range(words):
        grams[: len(h) - i] += h[i:] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) * (2 * i + 1) % (1 << 64))
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            whole = h[a:b] * np.arange(3, 3 + 2 * (b - a), 2, dtype=np.uint64)
            out.append(mix(whole.sum(keepdims=True) + np.uint64(b - a)) if b > a else h[:0])
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def count_blob(s: np.ndarray) -> bytes:
    """Shingles per group in 4 bits each, in multiples (rounded up) of a step that comes first: never below the counts."""
    c = np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    step = max(1, -(-int(c.max()) // 15))
    q = (-(-c // step)).astype(np.uint8)
    return np.uint32(step).tobytes() + (q[::2] << 4 | q[1::2]).tobytes()


def mark_blob(s: np.ndarray) -> bytes:
    """A bitmap of a fourth of the shingles, by their hashes, with one to two bits for each shingle of the set."""
    bits = np.zeros(1 << max(6, len(s).bit_length()), np.uint8)
    bits[(s[s >> np.uint64(62) == 0] % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles may reach a Jaccard index of `percent`: a bit that one bitmap alone has stands for a shingle, at least, that isn't shared."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, width), 0) for v in (x, y))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (100 + percent) * most >= percent * (n + m)


def points_of(blobs: pa.Array) -> np.ndarray:
    """Count vectors, a row for each blob."""
    raw = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, 4 + GROUPS // 2)
    out = np.empty((len(raw), GROUPS), np.int32)
    out[:, ::2], out[:, 1::2] = raw[:, 4:] >> 4, raw[:, 4:] & 15
    steps = np.ascontiguousarray(raw[:, :4]).view("<u4").astype(np.int32)
    return out * steps if len(steps) and steps.max() > 1 else out


def signatures(docs: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, key, nid, first, counts, marks): set size, its digest and that as a number, its first shingles with the size, group counts, bitmap.

    Copies that a task has just seen have no first shingles, counts and bitmap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = shared.value
        seen: set[bytes] = set()
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), words)
            keys, firsts, counts, marks = [], [], [], []
            for s in sets:
                keys.append(_digest(s) if len(s) else None)
                if keys[-1] is None or keys[-1] in seen:
                    firsts.append(np.zeros(0, np.int64))
                    counts.append(None)
                    marks.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(keys[-1])
                order = s
                if len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    hot = last[at] == s
                    if hot.any():
                        order = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])
                first = order[: len(s) - -(-percent * len(s) // 100) + 1]
                firsts.append((first >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | np.uint64(min(len(s), SIZE))).view(np.int64))
                counts.append(count_blob(s))
                marks.append(mark_blob(s))
            nids = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nids, pa.int64()), _lists(firsts), pa.array(counts, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "n", "key", "nid", "first", "counts", "marks"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, nid long, first array<long>, counts binary, marks binary")


def set_nodes(sig: DataFrame) -> DataFrame:
    """(key, nid, head, n, counts, marks) of each distinct set among signatures, stored. head: the smallest doc_id that has it."""
    per_set = sig.where("key is not null").groupBy("key", "nid")
    return stored(per_set.agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.max("counts").alias("counts"), F.max("marks").alias("marks")), "nodes")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of documents, sorted, and each one's place by frequency. They come last in the order, the most frequent ones at the end."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    limit = int(min(1.0, max(ORDER_DOCS / n, ORDER_SHARE)) * (1 << 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(b.column("text"), words)])
            s, k = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(k)], ["s", "k"])

    seen = docs.where(F.abs(F.hash("doc_id").cast("long")) < limit).select("doc_id", "text").mapInArrow(run, "s long, k long")
    top = seen.groupBy("s").agg(F.sum("k").alias("k")).where("k > 1").orderBy(F.desc("k"), "s").limit(COMMON).select("s").toPandas()["s"]
    s = top.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], (len(s) - order).astype(np.int32)


def _cells(percent: int):
    """Cells of rows (x, nid) that are sorted: each shingle's nodes, where two at least are near in size, cut to CELL nodes.

    cut: the shingle may have other cells, in this partition or the next.
    """

    def cells(x: np.ndarray, nid: np.ndarray, begun: bool, final: bool) -> tuple[pa.RecordBatch, np.ndarray, bool]:
        """The cells, which rows are held for the next batch, and whether a cell of their shingle was given before."""
        s, n = x >> SIZE_BITS, x & SIZE
        new = np.ones(len(x), bool)
        new[1:] = (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(x))
        flag = ends - starts > CELL
        flag[0] |= begun
        hold = 0
        if final:
            flag[-1] = True
        else:
            # The last shingle may go on: its whole cells are given, the rest is held.
            hold = (ends[-1] - starts[-1] - 1) % CELL + 1
            ends[-1] -= hold
        per = -(-(ends - starts) // CELL)
        at = np.repeat(starts, per) + CELL * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        size, flags = np.minimum(np.repeat(ends, per) - at, CELL), np.repeat(flag, per)
        keep = (size > 1) | flags
        at, size, flags = at[keep], size[keep], flags[keep]
        rows = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
        nids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(nid[rows]))
        out = pa.RecordBatch.from_arrays([pa.array(s[at]), nids, pa.array(n[at]), pa.array(n[at + size - 1]), pa.array(flags)], ["s", "nids", "lo", "hi", "cut"])
        return out, np.arange(len(x) - hold, len(x)), bool(flag[-1]) if len(starts) == 1 or ends[-1] > starts[-1] else False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = nid = np.zeros(0, np.int64)
        begun = True  # what stands first may go on from the partition before
        for b in batches:
            x, nid = np.concatenate([x, b.column("x").to_numpy()]), np.concatenate([nid, b.column("nid").to_numpy()])
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:] != x[:-1]) | (nid[1:] != nid[:-1])
            x, nid = x[fresh], nid[fresh]
            if len(x):
                out, held, begun = cells(x, nid, begun, False)
                x, nid = x[held], nid[held]
                yield out
        if len(x):
            yield cells(x, nid, begun, True)[0]

    return run


class RTree:
    """Points with summed-minima search. Bulk-loaded: halves along the coordinate of the widest spread, or the sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, int, np.ndarray | None, int, int]] = []
        self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        k = len(self.nodes)
        self.nodes.append(None)  # type: ignore[arg-type]
        own, sizes = self.points[rows], self.sizes[rows]
        top, low, high = own.max(0), int(sizes.min()), int(sizes.max())
        if len(rows) <= leaf:
            self.nodes[k] = (top, low, high, rows, -1, -1)
        else:
            spread = top - own.min(0)
            by = sizes if high - low > spread.max() else own[:, spread.argmax()]
            order = rows[np.argsort(by, kind="stable")]
            half = len(rows) // 2
            self.nodes[k] = (top, low, high, None, self._build(order[:half], leaf), self._build(order[half:], leaf))
        return k

    def search(self, q: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose overlap with q, of this size, may be large enough for a Jaccard index of `percent`, sorted."""
        found, todo = [], [0]
        while todo:
            top, low, high, rows, left, right = self.nodes[todo.pop()]
            if 100 * high < percent * size or 100 * size < percent * low or (100 + percent) * int(np.minimum(q, top).sum()) < percent * (size + low):
                continue
            if rows is None:
                todo += [left, right]
            else:
                bound = np.minimum(self.points[rows], q).sum(1)
                found.append(rows[(100 + percent) * bound >= percent * (self.sizes[rows] + size)])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def cell_pairs(cell: np.ndarray, n: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), j before i in the same cell, that the bound allows to link. Rows are sorted by cell.

    A cell that fits a leaf is looked through as one; larger ones are searched by a tree.
    """
    starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
    sizes = np.diff(np.append(starts, len(cell)))
    leaf = np.repeat(sizes <= LEAF, sizes)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, LEAF):
        a = np.flatnonzero(leaf[d:] & (cell[d:] == cell[:-d])) + d
        if not len(a):
            break
        lo, hi = np.minimum(n[a], n[a - d]), np.maximum(n[a], n[a - d])
        a = a[100 * lo >= percent * hi]
        a = a[(100 + percent) * np.minimum(points[a], points[a - d]).sum(1) >= percent * (n[a] + n[a - d])]
        i.append(a)
        j.append(a - d)
    for at, m in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        tree = RTree(points[at : at + m], n[at : at + m])
        for k in range(1, m):
            near = tree.search(points[at + k], int(n[at + k]), percent)
            near = near[near < k]
            i.append(np.full(len(near), at + k))
            j.append(at + near)
    return np.concatenate(i), np.concatenate(j)


def _numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _whole_cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns and points of the batches, cut so that no cell is divided."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [*_numbers(b, "cell", *names), points_of(b.column("counts"))]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        at = int(np.searchsorted(now[0], now[0][-1]))
        held = [c[at:] for c in now]
        if at:
            yield [c[:at] for c in now]
    if held is not None and len(held[0]):
        yield held


def _first_partners(percent: int):
    """(b, a, n, cell): for each node of a cell the first one before it that the tree finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, nid, n, points in _whole_cells(batches, ("nid", "n")):
            i, j = cell_pairs(cell, n, points, percent)
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(nid[i[first]]), pa.array(nid[j[first]]), pa.array(n[j[first]]), pa.array(cell[i[first]])], ["b", "a", "n", "cell"])

    return run


def _between(percent: int, most: int):
    """(a, b, more): pairs of different components in a cell, at most `most` of two components; more: the cell, if there are others.

    A cell's own rows come first, then those that visit it, which only meet its own.
    """

    def capped(cell: int, nid: np.ndarray, comp: np.ndarray, i: np.ndarray, other: np.ndarray, comp_o: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        p, q = np.minimum(comp[i], comp_o[j]), np.maximum(comp[i], comp_o[j])
        at = np.flatnonzero(p != q)
        at = at[np.lexsort((q[at], p[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (p[at[1:]] != p[at[:-1]]) | (q[at[1:]] != q[at[:-1]])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(at)))
        rank = np.arange(len(at)) - np.repeat(starts, size)
        more = np.where(np.repeat(size > most, size)[rank < most], cell, -1)
        at = at[rank < most]
        x, y = nid[i[at]], other[j[at]]
        return [np.maximum(x, y), np.minimum(x, y), more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "more"])
        own: list[np.ndarray] = []
        tree, done = None, False

        def inner() -> Iterator[pa.RecordBatch]:
            if own and not done:
                i, j = cell_pairs(np.zeros(len(own[0]), np.int64), own[2], own[3], percent)
                yield give(capped(current, own[0], own[1], i, own[0], own[1], j))

        current = None
        for b in batches:
            cell, visits, *cols = _numbers(b, "cell", "visits", "nid", "component", "n")
            cols.append(points_of(b.column("counts")))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (visits[1:] != visits[:-1])) + 1
            edges = [0, *cuts.tolist(), len(cell)] if len(cell) else [0]
            for u, v in zip(edges[:-1], edges[1:], strict=True):
                part = [c[u:v] for c in cols]
                if cell[u] != current:
                    yield from inner()
                    current, own, tree, done = int(cell[u]), [], None, False
                if not visits[u]:
                    own = [np.concatenate(x) for x in zip(own, part, strict=True)] if own else part
                elif own:
                    if tree is None:
                        yield from inner()
                        tree, done = RTree(own[3], own[2]), True
                    near = [tree.search(q, int(m), percent) for q, m in zip(part[3], part[2], strict=True)]
                    i = np.repeat(np.arange(v - u), [len(x) for x in near])
                    yield give(capped(current, part[0], part[1], i, own[0], own[1], np.concatenate(near)))
        yield from inner()

    return run


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, stored. pairs: a stored table.

    Unrelated long texts pass the bound of their counts, the more of them the larger the table; bitmaps rule them out before
    any text is shuffled. The sets are made again from the texts, which are shorter.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("marks_a", "n_a", "marks_b", "n_b"))
            yield b.select(["a", "b"]).filter(pa.array([may_link(*x, percent) for x in zip(*cols, strict=True)], pa.bool_()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = b.column("key").to_pylist()
            keep = pa.array([bool(len(s)) and _digest(s) == k for s, k in zip(shingle_sets(b.column("text"), words), keys, strict=True)], pa.bool_())
            yield b.select(["nid", "text"]).filter(keep)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            for b in slices(iter([x]), "other"):
                sets = zip(shingle_sets(b.column("text"), words), shingle_sets(b.column("other"), words), strict=True)
                keep = []
                for p, q in sets:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    met = stored(ends(pairs).join(nodes.select("nid", "key", "head", "n", "marks"), "nid"), "met")
    own = met.select("nid", "n", "marks")
    marked = small(pairs, SMALL).join(own.toDF("a", "n_a", "marks_a"), "a").join(own.toDF("b", "n_b", "marks_b"), "b")
    pairs = stored(marked.mapInArrow(likely, "a long, b long"), "likely")
    wanted = stored(ends(pairs).join(met.select("nid", "key", "head"), "nid"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("head"), "text").join(small(wanted, SMALL), "head").select("nid", "key", "text")
    texts = stored(texts.mapInArrow(read, "nid long, text string").groupBy("nid").agg(F.first("text").alias("text")), "texts")
    both = small(pairs, SMALL).join(texts.withColumnRenamed("nid", "a"), "a").join(texts.select(F.col("nid").alias("b"), F.col("text").alias("other")), "b")
    out = stored(both.select("a", "b", "text", "other").mapInArrow(check, "a long, b long"), "links")
    discard(met, pairs, wanted, texts)
    return out


def first_links(docs: DataFrame, nodes: DataFrame, lists: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs checked, those that link, cells with a pair): each node with up to three of the nodes that the trees find first for it."""
    rows = lists.select("cell", F.explode("nids").alias("nid")).join(nodes.select("nid", "n", "counts"), "nid")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "n", "nid")
    found = stored(rows.mapInArrow(_first_partners(percent), "b long, a long, n long, cell long"), "partners")
    some = [F.min(F.struct("n", "a"))["a"], *(F.min(F.struct(F.xxhash64("a", F.lit(k)), "a"))["a"] for k in (1, 2))]
    pairs = found.groupBy("b").agg(F.array_distinct(F.array(*some)).alias("a")).select("b", F.explode("a").alias("a"))
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    live = stored(found.select("cell").distinct(), "live")
    discard(found)
    return pairs, _links(docs, nodes, pairs, words, percent), live


def _open_rows(lists: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(cell, visits, nid, component, n, counts) of those of the cells whose shingle still spans several components, with their visitors, stored."""
    own = lists.select("cell", "s", F.explode("nids").alias("nid")).join(comps, F.col("nid") == comps["node"], "left")
    own = own.select("cell", "s", "nid", F.coalesce("component", "nid").alias("component"))
    # A cell that holds all of its shingle stands for itself; others are taken together by shingle.
    group = [F.coalesce("s", F.lit(0)).alias("g"), F.when(F.col("s").isNull(), F.col("cell")).otherwise(-1).alias("h")]
    spans = own.groupBy(*group).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("g", "h")
    own = stored(own.select("*", *group).join(spans, ["g", "h"]).select("cell", "s", "nid", "component"), "open")
    many = own.where("s is not null")
    major = many.groupBy("s", "component").agg(F.count("*").alias("m")).groupBy("s").agg(F.max_by("component", F.struct("m", "component")).alias("major"))
    minor = many.join(major, "s").where("component <> major").join(nodes.select("nid", "n"), "nid").select("s", "nid", "n", "component", F.col("cell").alias("home"))
    near = F.expr(f"home <> cell and (hi = {SIZE} or 100 * hi >= {percent} * n) and 100 * n >= {percent} * lo")
    visits = minor.join(lists.where("s is not null").select("s", "cell", "lo", "hi"), "s").where(near).select("cell", F.lit(True).alias("visits"), "nid", "component")
    rows = own.select("cell", F.lit(False).alias("visits"), "nid", "component").unionByName(visits)
    rows = stored(rows.join(nodes.select("nid", "n", "counts"), "nid"), "open-rows")
    discard(own)
    return rows


def jaccard_components(docs: DataFrame, words: int = 3, least: float = 0.9) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text, ...).

    Two rows link if the Jaccard index of their shingle sets is least or more (exactly, in
    hundredths). component_id is the smallest doc_id reachable by links, the row's own
    included. Null, empty and blank texts have no shingles and link with nothing. A row whose
    doc_id is null can't be named: it links with nothing and gets a null component_id. Rows
    that repeat, or share a doc_id, each get a result row. Other columns are not looked at.
    Sets whose digests agree in 64 bits count as one.
    """
    docs, percent = docs.select("doc_id", "text"), ceil(100 * least - 1e-9)
    named = docs.where("doc_id is not null")
    sig = stored(signatures(named, words, percent, common_shingles(named, words)), "signatures")
    ids = stored(sig.select("doc_id", "n", "key", "nid"), "ids")
    nodes = set_nodes(sig)

    first = sig.select("nid", F.explode("first").alias("x")).repartitionByRange("x", "nid").sortWithinPartitions("x", "nid")
    cells = first.mapInArrow(_cells(percent), "s long, nids array<long>, lo long, hi long, cut boolean")
    # Shingles with the same nodes, as those of two near copies, are one list.
    lists = cells.withColumn("s", F.when(F.col("cut"), F.col("s"))).groupBy("s", "nids").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    lists = stored(lists.withColumn("cell", F.monotonically_increasing_id()), "lists")
    discard(sig)

    tried, links, live = first_links(named, nodes, lists.where("size(nids) > 1"), words, percent)
    comps = stored(components(links), "components")
    # Cells without a pair that the bound allows are done with, but for those whose shingle has other cells.
    live = live.unionByName(lists.where("s is not null").select("cell")).distinct()
    rows, most = _open_rows(lists.join(live, "cell", "left_semi"), nodes, comps, percent), FIRST_PAIRS
    while True:
        found = stored(rows.repartition("cell").sortWithinPartitions("cell", "visits", "n", "nid").mapInArrow(_between(percent, most), "a long, b long, more long"), "found")
        fresh = stored(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            links = _links(named, nodes, fresh, words, percent)
            # What is joined already goes on as stars, however many links there were.
            joined = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
            before, comps = comps, stored(components(joined), "components")
            tried = stored(tried.unionByName(fresh), "tried")
            discard(before)
        again = found.where("more >= 0").select(F.col("more").alias("cell")).distinct()
        if again.isEmpty():
            break
        held = rows.select("cell", "visits", "nid", "n", "counts").join(again, "cell", "left_semi").join(comps, F.col("nid") == comps["node"], "left")
        before, rows = rows, stored(held.select("cell", "visits", "nid", F.coalesce("component", "nid").alias("component"), "n", "counts"), "open-rows")
        discard(before, found)
        most *= GROWTH

    labelled = nodes.select("nid", "key", "head").join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least_id = labelled.groupBy("component").agg(F.min("head").alias("component_id"))
    by_key = labelled.join(least_id, "component").select("key", "component_id")
    out = ids.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if "doc_id" in docs.columns and docs.schema["doc_id"].nullable:
        blank = docs.where("doc_id is null")
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        out = out.unionByName(signatures(blank, words, percent, none).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return out
