"""Exact top-k by inner product: one ball tree per shard, searched best bound first.

Candidates go to the nearest of some coarse centres, and a centre's candidates to shards of bounded
size. Centre and radius bound the inner product of a query with all that lies there: a query first
searches one shard under its best bound, and its kth score then rules out the shards, and in the
others the balls, whose bound (q . centre + |q| * radius) lies below. A task holds one shard and
one batch of queries; k rows at most per query and visited shard come back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

SHARD_ROWS = 8192
#: Coarse centres at most: candidates with the smallest hashes. Each takes a vector in every task.
CENTRES = 1024
LEAF = 128


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; vectors that are null, empty or hold null or non-finite components go, and rows without an id."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


class BallTree:
    """Balls over rows, halved along the line between two far points."""

    def __init__(self, points: np.ndarray):
        self.points, self.balls = points, []
        self._build(np.arange(len(points)))
        self.centres = np.array([b[0] for b in self.balls])
        self.radii = np.array([b[1] for b in self.balls])

    def _build(self, rows: np.ndarray) -> int:
        k, own = len(self.balls), self.points[rows]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        self.balls.append((centre, away.max() * (1 + 1e-9) + 1e-6, None, -1, -1))
        if len(rows) <= LEAF or away.max() == 0:
            self.balls[k] = (*self.balls[k][:2], rows, -1, -1)
        else:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            order = rows[np.argsort(own @ (b - a), kind="stable")]
            half = len(rows) // 2
            self.balls[k] = (*self.balls[k][:2], None, self._build(order[:half]), self._build(order[half:]))
        return k

    def search(self, q: np.ndarray, own_id: int, ids: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """Up to k (score, -id), best first; rows that score below floor may be left out."""
        bounds = bounds_of(q[None], self.centres, self.radii)[0]
        best: list[tuple[float, int]] = []
        todo = [(-bounds[0], 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            if -bound < floor:
                break
            rows, left, right = self.balls[at][2:]
            if rows is None:
                heapq.heappush(todo, (-bounds[left], left))
                heapq.heappush(todo, (-bounds[right], right))
                continue
            scores = self.points[rows] @ q
            for i in np.flatnonzero(scores >= floor):
                if ids[rows[i]] != own_id:
                    item = (scores[i], -int(ids[rows[i]]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return sorted(best, reverse=True)


def bounds_of(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of a query (row) with a point in a ball (column) is larger."""
    bounds = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * radii
    return bounds + 1e-9 * (1 + np.abs(bounds))


def _vectors(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of the vectors of a batch."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


class Shards:
    """For each vector length: centres, radii, shards of each centre, and the first one's number."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, dim: int) -> np.ndarray:
        return self.centres.get(dim, np.zeros((1, dim)))

    def fill(self, cells: list[tuple[int, int, int, float]]) -> int:
        """Take (length, centre, rows, radius) of all that have rows; returns the number of shards."""
        total = 0
        for dim in sorted({c[0] for c in cells}):
            own = sorted(c for c in cells if c[0] == dim)
            at = np.array([c[1] for c in own])
            shards = np.array([max(1, round(c[2] / SHARD_ROWS)) for c in own])
            self.kept[dim] = (at, np.array([c[3] * (1 + 1e-9) + 1e-6 for c in own]), shards, total + np.cumsum(shards) - shards)
            total += int(shards.sum())
        return total


def shard_rows(candidates: DataFrame) -> tuple[DataFrame, Shards]:
    """candidates (id, v, dim) with `shard`, and where the shards lie."""
    spark = candidates.sparkSession
    wanted = min(CENTRES, max(1, round(candidates.count() / SHARD_ROWS)))
    picked = candidates.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(wanted).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(r["dim"], []).append(r["v"])
    shards = Shards({d: np.unique(np.array(v, np.float64), axis=0) for d, v in by.items()})
    shared = spark.sparkContext.broadcast(shards)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows in _by_length(b):
                part = b.take(pa.array(rows))
                points, centres = _vectors(part.column("v"), dim).astype(np.float64), shared.value.of(dim)
                cell = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
                away = np.sqrt(((points - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("dim"), pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "v", "dim", "cell", "away"])

    placed = stored(candidates.mapInArrow(near, "id long, v array<long>, dim int, cell int, away double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # CENTRES rows, and one for each length without
    shards.fill([(c["dim"], c["cell"], c["n"], c["r"]) for c in cells])
    first = [(d, int(c), int(s), int(f)) for d, (at, _, many, start) in shards.kept.items() for c, s, f in zip(at, many, start, strict=True)]
    table = spark.createDataFrame(first, "dim int, cell int, many int, first int")
    placed = placed.join(F.broadcast(table), ["dim", "cell"])  # as many rows as cells
    return placed.select("id", "v", "dim", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias("shard")), shards


def routed(queries: DataFrame, shards: Shards, home: bool) -> DataFrame:
    """(shard, id, v, dim, floor) of queries (id, v, dim, floor): the shard under the best bound, or all others whose bound reaches floor."""
    shared = queries.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows in _by_length(b):
                if dim not in shared.value.kept:
                    continue
                part = b.take(pa.array(rows))
                at, radii, many, first = shared.value.kept[dim]
                bounds = bounds_of(_vectors(part.column("v"), dim).astype(np.float64), shared.value.of(dim)[at], radii)
                best = bounds.argmax(1)
                own = first[best] + part.column("id").to_numpy() % many[best]
                if home:
                    to, which = own, np.arange(len(own))
                else:
                    i, c = np.nonzero(bounds >= part.column("floor").to_numpy()[:, None])
                    which = np.repeat(i, many[c])
                    ends = np.cumsum(many[c])
                    to = np.repeat(first[c] - ends + many[c], many[c]) + np.arange(len(which))
                    other = to != own[which]
                    to, which = to[other], which[other]
                part = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(part.column(c) for c in ("id", "v", "dim", "floor"))], ["shard", "id", "v", "dim", "floor"])

    return queries.select("id", "v", "dim", "floor").mapInArrow(run, "shard int, id long, v array<long>, dim int, floor double")


def _search(k: int):
    """(query_id, vec_id, score) from rows sorted by shard, its candidates before its queries."""

    def found(points: np.ndarray, ids: np.ndarray, tree: BallTree, qs: np.ndarray, own: np.ndarray, floors: np.ndarray) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        exact = float(np.abs(points).max()) * np.abs(qs).max(1).astype(np.float64) * points.shape[1] < 2**53
        for vec, mine, floor, within in zip(qs, own.tolist(), floors.tolist(), exact.tolist(), strict=True):
            if within:
                near = tree.search(vec.astype(np.float64), mine, ids, k, floor)
            else:  # beyond the integers that doubles hold
                near = heapq.nlargest(k, ((sum(int(a) * int(b) for a, b in zip(p, vec, strict=True)), -int(i)) for i, p in zip(ids, points, strict=True) if i != mine))
            out += [(mine, -i, int(s)) for s, i in near]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, tree, points, ids = None, [], None, None, None
        for b in batches:
            shard, asks, dims = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "dim"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *cuts.tolist(), len(shard)] if len(shard) else [0]
            out: list[tuple[int, int, int]] = []
            for u, v in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(u, v - u)
                own, vectors = part.column("id").to_numpy(), _vectors(part.column("v"), int(dims[u]))
                if shard[u] != current:
                    current, rows, tree = shard[u], [], None
                if not asks[u]:
                    rows.append((own, vectors))
                elif rows:
                    if tree is None:
                        ids, points = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                        tree = BallTree(points.astype(np.float64))
                    out += found(points, ids, tree, vectors, own, part.column("floor").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates by integer inner product, exact.

    candidates, queries: (id, v array<long>), as whole_vectors() gives. Ties go to the smaller
    id, a query's own id is no candidate, and vectors of another length than the query's have
    no product with it. Fewer than k candidates give fewer rows, an empty side none. Of rows
    that repeat an id among the candidates, each stands for itself; queries are taken once
    each, by the smallest vector. Scores have to fit a long.
    """
    placed, shards = shard_rows(stored(candidates.select("id", "v", F.size("v").alias("dim")), "candidates"))
    q = queries.groupBy("id").agg(F.min("v").alias("v"))
    q = stored(q.select("id", "v", F.size("v").alias("dim"), F.lit(float("-inf")).alias("floor")), "queries")

    def pass_(asked: DataFrame) -> DataFrame:
        rows = placed.join(asked.select("shard").distinct(), "shard", "left_semi")
        rows = rows.select("shard", F.lit(False).alias("asks"), "id", "v", "dim", F.lit(None).cast("double").alias("floor"))
        both = rows.unionByName(asked.withColumn("asks", F.lit(True)))
        return both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    first = stored(pass_(stored(routed(q, shards, True), "asked")), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if all(int(many.sum()) <= 1 for _, _, many, _ in shards.kept.values()):
        return ranked(first)  # one shard for each length of vector: all queries have met all candidates
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(f"n >= {k}")
    floors = q.drop("floor").join(kth, q["id"] == kth["query_id"], "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    return ranked(first.unionByName(pass_(stored(routed(floors, shards, False), "asked"))))
