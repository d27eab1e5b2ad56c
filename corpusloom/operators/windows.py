"""Ordered operators: as-of lookups, quotas, stratified samples, running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, group: str, order: list[str], value: Column, rows: int, name: str) -> DataFrame:
    """The last non-null value at most `rows` rows up, the row itself included."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-rows, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_after(df: DataFrame, group: str, order: list[str], value: Column, rows: int, name: str) -> DataFrame:
    """The first non-null value in the next `rows` rows."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(w))


def stratified(df: DataFrame, strata: list[str], key: str, quota: int, seed: str) -> DataFrame:
    """The first `quota` rows of each stratum by sha256(seed, key), with inverse-probability weights."""
    draw = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    # The rank alone in its window lets each task drop rows beyond the quota before the shuffle; sizes are counted apart.
    top = df.withColumn("draw", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))).where(F.col("draw") <= quota)
    sizes = df.groupBy(*(F.col(s).alias(f"_{s}") for s in strata)).agg(F.count("*").alias("population"))
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    x = top.join(sizes, same).drop(*(f"_{s}" for s in strata))
    return x.withColumn("weight", F.col("population") / F.least("population", F.lit(quota)))


def largest_remainder(strata: DataFrame, size: str, seats: int, order: list[str]) -> DataFrame:
    """Add `quota`: one seat per stratum, the others by shares of size - 1, leftovers to the largest fractions.

    No quota is above its stratum's size. Fewer seats than strata, or more than rows, are an error.
    """
    everything = Window.partitionBy()
    x = strata.withColumn("_room", F.col(size) - 1).withColumn("_all", F.sum("_room").over(everything)).withColumn("_n", F.count("*").over(everything))
    x = x.withColumn("_exact", (F.lit(seats) - F.col("_n")) * F.col("_room") / F.nullif(F.col("_all"), F.lit(0))).withColumn("_floor", F.floor("_exact"))
    left = F.lit(seats) - F.col("_n") - F.sum("_floor").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_floor")), *order))
    quota = (1 + F.coalesce("_floor", F.lit(0)) + F.when(rank <= left, 1).otherwise(0)).cast("long")
    wrong = (F.col("_n") > seats) | (F.col("_all") + F.col("_n") < seats)
    x = x.withColumn("quota", F.when(wrong, F.raise_error(F.lit("seats have to lie between the number of strata and that of rows")).cast("long")).otherwise(quota))
    return x.drop("_room", "_all", "_n", "_exact", "_floor")
