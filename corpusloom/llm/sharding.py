"""A uniform shuffle of rows into shards of exact sizes, with DataFrame functions only.

Rows lie in blocks of bounded size. How many rows of each block go to each shard is one draw
from the multivariate hypergeometric law, so that the matrix of blocks by shards has exact row
and column sums and is distributed as in a uniform permutation of all rows. Blocks permute their
rows, hand them out by the matrix, and each shard permutes what it gets.

The matrix is drawn down a tree: a node of up to FAN children divides what its blocks send to
each shard among them, all nodes of a level at once. So no task sees more than one node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import running, stored

#: Rows of a block, as a power of two, and children of a node of the tree.
BLOCK_BITS = 14
FAN = 32
#: Draws of up to so many balls are made ball by ball, larger ones by rejection.
BALLS = 16
#: Rejections in a row after which a draw takes its mode; one is rejected with a chance of about a quarter.
TRIES = 64


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def uniform(*keys: Column) -> Column:
    """A number above 0 and below 1 that these keys decide."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) * 2.0**-53


def log_factorial(x: Column) -> Column:
    """ln(x!) of a whole number x: from a table up to BALLS, else by Stirling's series."""
    d = x.cast("double")
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(BALLS + 1)))
    series = (d + 0.5) * F.ln(d) - d + 0.5 * math.log(2 * math.pi) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
    return F.when(x <= BALLS, F.get(table, x.cast("int"))).otherwise(series)


def _by_balls(total: Column, good: Column, n: Column, seed: Column) -> Column:
    step = lambda s, k: F.struct(
        (s["hit"] + (uniform(seed, k) * (total - k) < (good - s["hit"])).cast("long")).alias("hit")
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n), F.struct(F.lit(0).cast("long").alias("hit")), lambda s, k: F.when(k < n, step(s, k)).otherwise(s))["hit"]


def _by_rejection(total: Column, good: Column, n: Column, seed: Column) -> Column:
    """Ratio of uniforms below a table mountain around the mode (Stadlober's hat)."""
    t, g, m = (c.cast("double") for c in (total, good, n))
    share = g / t
    middle = m * share + 0.5
    spread = F.sqrt((t - m) * m * share * (1 - share) / (t - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
    mode = F.floor((m + 1) * (g + 1) / (t + 2))
    weight = lambda k: log_factorial(k) + log_factorial(good - k) + log_factorial(n - k) + log_factorial(total - good - n + k)

    def attempt(p: Column, k: Column) -> Column:
        u = uniform(seed, k, F.lit(1))
        at = p["middle"] + p["width"] * (uniform(seed, k, F.lit(2)) - 0.5) / u
        inside = (at >= 0) & (at < F.least(good, n) + 1)
        return F.when(inside, _let(F.floor(at), lambda z: F.when(2 * F.ln(u) <= p["top"] - weight(z), z)))

    start = F.struct(middle.alias("middle"), width.alias("width"), mode.alias("mode"), weight(mode).alias("top"))
    return _let(start, lambda p: F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), lambda got, k: F.coalesce(got, attempt(p, k))), p["mode"]))


def hypergeometric(total: Column, good: Column, n: Column, seed: Column) -> Column:
    """How many of n balls, drawn without putting back, are good, if `good` of all `total` are. Equal seeds give equal draws."""
    few = F.least(n, total - n)
    rare = F.least(good, total - good)
    low, high = F.least(few, rare), F.greatest(few, rare)

    def back(z: Column) -> Column:
        # z: good balls among few, or rare ones, which is the same law
        z = F.when(good > total - good, few - z).otherwise(z)
        return F.when(n > total - n, good - z).otherwise(z)

    drawn = F.when(low <= BALLS, _by_balls(total, high, low, seed)).otherwise(_by_rejection(total, high, low, seed))
    return _let(drawn, back)


def _divide(capacity: Column, sizes: Column, seed: Column) -> Column:
    """Each child's counts for the shards: sizes are the children's rows, capacity the shards' counts, both with the same sum."""

    def child(state: Column, k: Column) -> Column:
        def shard(s: Column, j: Column) -> Column:
            room = F.get(state["left"], j)
            take = hypergeometric(s["total"], room, s["n"], F.xxhash64(seed, k, j))
            return _let(take, lambda z: F.struct((s["n"] - z).alias("n"), (s["total"] - room).alias("total"), F.concat(s["out"], F.array(z)).alias("out")))

        none = F.array().cast("array<long>")
        begin = F.struct(F.get(sizes, k).alias("n"), F.aggregate(state["left"], F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), none.alias("out"))
        row = F.aggregate(F.sequence(F.lit(0), F.size(capacity) - 1), begin, shard)["out"]
        return _let(row, lambda r: F.struct(F.zip_with(state["left"], r, lambda a, b: a - b).alias("left"), F.concat(state["out"], F.array(r)).alias("out")))

    begin = F.struct(capacity.alias("left"), F.array().cast("array<array<long>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), begin, child)["out"]


def communication_matrix(blocks: DataFrame, capacity: list[int], seed: int = 0) -> DataFrame:
    """block, counts: how many of its rows go to each shard. blocks: block (long from 0, each once), n rows; capacity: rows of each shard, summing to all rows."""
    levels = [stored(blocks.select(F.col("block").cast("long").alias("node"), F.col("n").cast("long").alias("n")), "level")]
    while levels[-1].agg(F.max("node")).first()[0]:
        levels.append(stored(levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sum("n").alias("n")), "level"))
    got = levels[-1].select("node", F.array(*(F.lit(c).cast("long") for c in capacity)).alias("counts"))
    for depth, level in reversed(list(enumerate(levels[:-1]))):
        under = level.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("own"))
        split = _divide(F.col("counts"), F.col("own.n"), F.xxhash64(F.lit(seed), F.lit(depth), F.col("node")))
        pairs = got.join(under, "node").select(F.explode(F.arrays_zip(F.col("own.node").alias("node"), split.alias("counts"))).alias("x"))
        got = stored(pairs.select("x.node", "x.counts"), "matrix")
    return got.withColumnRenamed("node", "block")


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """docs' columns, shard (0 to shards - 1) and slot (from 0, gapless in each shard), all orders of all rows alike likely.

    Shards differ by one row at most, the first ones being the larger. Null, empty, long and repeated rows are dealt like any
    others, equal texts apart from each other. No rows give no rows. Columns named shard or slot are replaced. The seed and
    the rows' places in the files decide; the same files give the same shuffle, files cut otherwise another one.
    """
    rows = docs.drop("shard", "slot").withColumn("_m", F.monotonically_increasing_id())
    rows = stored(rows, "rows").withColumn("_chunk", F.shiftright("_m", BLOCK_BITS))
    sizes = stored(rows.groupBy("_chunk").agg(F.count("*").alias("n")), "sizes")
    blocks = running(sizes, [F.col("_chunk")]).withColumnRenamed("at", "block")
    blocks = stored(blocks, "blocks")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base, extra = divmod(total, shards)
    capacity = [base + (k < extra) for k in range(shards)]
    matrix = communication_matrix(blocks, capacity, seed) if total else blocks.select("block", F.lit(None).cast("array<long>").alias("counts"))
    upto = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    bounds = blocks.join(matrix, "block").select("_chunk", F.slice(upto, 2, shards).alias("_upto"))
    # Permute locally, and hand out by the matrix.
    order = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.xxhash64(F.lit(seed), F.lit("out"), "_m"), "_m"))
    sent = rows.withColumn("_place", order).join(bounds, "_chunk")
    shard = F.size(F.filter("_upto", lambda x: x < F.col("_place")))
    # Permute again; a shard starts after all rows of those before it.
    got = running(sent.withColumn("shard", shard).drop("_chunk", "_place", "_upto"), [F.col("shard"), F.xxhash64(F.lit(seed), F.lit("in"), "_m"), F.col("_m")])
    start = F.col("shard") * F.lit(base) + F.least(F.col("shard"), F.lit(extra))
    return got.withColumn("slot", F.col("at") - start).drop("at", "_m")
