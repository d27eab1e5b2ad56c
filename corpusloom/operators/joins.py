"""Joins: exact key with an as-of fallback, bands, cells of keys that both sides repeat, key coverage, numbering without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_or_latest(left: DataFrame, right: DataFrame, group: str, symbol: str, time: str, value: str) -> DataFrame:
    """left with `owner` and `how`: right's `value` of the same (group, symbol), the latest one; else its latest in group at or before left's time.

    Rows with neither get nulls. Ties in time go to the larger value. The fallback is one window
    over both sides together, so that no pairs are formed.
    """
    exact = right.groupBy(group, symbol).agg(F.max_by(value, F.struct(time, value)).alias("_exact"))
    mine = [F.col(c) for c in left.columns]
    both = left.select(*mine, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    blank = [F.col(c) if c in (group, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    both = both.unionByName(right.select(*blank, F.lit(0).alias("_side"), F.col(value).alias("_value")))
    w = Window.partitionBy(group).orderBy(time, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("_latest", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")
    found = latest.join(exact, [group, symbol], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_latest").isNotNull(), "latest")
    return found.select(*mine, F.coalesce("_exact", "_latest").alias("owner"), how.alias("how"))


def band_counts(left: DataFrame, right: DataFrame, key: str, ident: str, time: str, width: int) -> DataFrame:
    """left's (ident, matches): rows of right(key, time) with the same key and at most `width` away, and a verdict: none, unique or ambiguous.

    Whole numbers of time only. Rows meet in bands of that width, so that a hot key is spread;
    a row of left looks into three bands.
    """
    band = F.floor(F.col(time) / width)
    a = left.select(ident, key, F.col(time).alias("_t"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    b = right.select(key, F.col(time).alias("_u"), band.alias("_band"))
    met = a.join(b, [key, "_band"]).where(F.abs(F.col("_t") - F.col("_u")) <= width).groupBy(ident).agg(F.count("*").alias("matches"))
    n = F.coalesce("matches", F.lit(0))
    return left.select(ident).join(met, ident, "left").select(ident, n.alias("matches"), F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("verdict"))


#: Rows of either side in a cell, and pairs in a task.
CELL, TASK_PAIRS = 512, 1 << 22


def cell_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys that both may repeat, so that the pairs of one key are many tasks' work.

    The rows that a side has of a key are dealt out by their hash into blocks of some CELL rows, and each block meets each of
    the other side's in a cell of its own. Rows are copied once for each block that they meet: a row moves for CELL / 2 pairs
    in large groups. The number of tasks follows the pairs, not the bytes that make them. Rows of a side have to be
    distinct, as equal ones lie in one block. Both sides are read more than once.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    blocks = size(left, "_n").join(size(right, "_m"), keys)
    tasks = -(-(blocks.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 1) // TASK_PAIRS)
    blocks = blocks.select(*keys, F.ceil(F.col("_n") / CELL).alias("_rows"), F.ceil(F.col("_m") / CELL).alias("_columns"))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = [*keys, "_row", "_column"]
    a = left.join(blocks, keys).select(*left.columns, own(left, "_rows").alias("_row"), each("_columns").alias("_column"))
    b = right.join(blocks, keys).select(*right.columns, own(right, "_columns").alias("_column"), each("_rows").alias("_row"))
    return a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).drop("_row", "_column")


def key_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, in left only and in right only. Null keys are equal to each other."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    k = sides.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return k.agg(F.count_if(F.expr("_l + _r = 2")).alias("both"), F.count_if(F.expr("_l > _r")).alias("left_only"), F.count_if(F.expr("_l < _r")).alias("right_only"))


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 by (bucket, order), null buckets first. bucket must not decrease along the order.

    Each bucket is numbered by itself; only the buckets' counts pass through one window.
    """
    x = df.withColumn("_bucket", bucket)
    per = x.groupBy(F.col("_bucket").alias("_of")).agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return x.withColumn("_own", own).join(before, F.col("_bucket").eqNullSafe(F.col("_of"))).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_of", "_before", "_own")


def total_join(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """left with right's columns, where each row has to find exactly one partner: none, or a key that right holds twice, is an error that names the key.

    The error is raised by the task that meets it. Null keys find no partner.
    """
    once = right.groupBy(*keys).agg(F.count("*").alias("_times"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("_right"))
    x = left.join(once, keys, "left")
    key = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    wrong = F.when(F.col("_times").isNull(), F.lit("no partner in ")).when(F.col("_times") > 1, F.lit("several partners in "))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(f"{what} for "), key)).cast(once.schema["_right"].dataType)).otherwise(F.col("_right"))
    return x.withColumn("_right", checked).select(*left.columns, "_right.*")
