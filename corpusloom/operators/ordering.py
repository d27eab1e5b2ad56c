"""Places and running sums over all rows, and exact percentiles from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None) -> DataFrame:
    """df, stored, with `place` from 0 in this order and, under each new name, the sum of a column over all rows before.

    Rows are range-partitioned and sorted; places and sums are made within each sorted task, and only one row a task passes
    through one window.
    """
    sums = sums or {}
    s = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_m", 33))
    parts = s.groupBy("_part").agg(F.count("*").alias("_rows_ahead"), *(F.sum(c).alias(f"_sum_{x}") for x, c in sums.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_rows_ahead", *(f"_sum_{x}" for x in sums))))
    own = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({x: F.coalesce(F.sum(c).over(own), F.lit(0)) for x, c in sums.items()}).join(parts, "_part")
    place = F.col("_rows_ahead") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumns({"place": place} | {x: F.col(x) + F.col(f"_sum_{x}") for x in sums}).drop("_m", "_part", "_rows_ahead", *(f"_sum_{x}" for x in sums))


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, under each name, an exact percentile of value: ("linear", p) between neighbours, or ("rank", p), the ceil(p n)-th value and 0.0 of none.

    Values are counted first, then ranked by range-partitioned running sums, so no group is held by one task, whatever it
    holds. Null values are left out; a group of nulls has null and 0.0. Null group keys are a group.
    """
    groups = df.groupBy(*by).agg(F.count(value).alias("_total"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, [*by, value], {"_before": "_n"})
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]  # without groups, a row meets a row
    first = ranked.groupBy(*by).agg(F.min("_before").alias("_first"))
    totals = stored(groups.alias("l").join(first.alias("r"), same, "left").select("l.*", "_first"), "totals")
    spots, parts = [], {}
    for name, (how, p) in wanted.items():
        if how == "linear":
            exact = F.lit(float(p)) * (F.col("_total") - 1)
            spots += [F.struct(F.lit(f"{name}-low").alias("name"), F.floor(exact).alias("k")), F.struct(F.lit(f"{name}-high").alias("name"), F.ceil(exact).alias("k"))]
            parts[name] = lambda x, p=p, name=name: _between(x, p, name)
        else:
            spots.append(F.struct(F.lit(name).alias("name"), (F.greatest(F.ceil(F.round(F.lit(float(p)) * F.col("_total"), 9)), F.lit(1)) - 1).alias("k")))
            parts[name] = lambda x, name=name: F.coalesce(F.try_element_at(x, F.lit(name)).cast("double"), F.lit(0.0))
    targets = totals.where("_total > 0").select(*by, "_first", F.explode(F.array(*spots)).alias("s")).select(*by, F.col("s.name").alias("_name"), (F.col("_first") + F.col("s.k")).alias("_k"))
    reached = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n"))
    for c in same:
        reached = c & reached
    met = ranked.alias("l").join(targets.alias("r"), reached).select("l.*", "_name")
    found = met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_name", F.col(value).cast("double")))).alias("_x"))
    out = totals.alias("l").join(found.alias("r"), same, "left").select("l.*", "_x")
    return out.select(*by, *(f(F.col("_x")).alias(name) for name, f in parts.items()))


def _between(x: Column, p: float, name: str) -> Column:
    low, high = F.try_element_at(x, F.lit(f"{name}-low")), F.try_element_at(x, F.lit(f"{name}-high"))
    exact = F.lit(float(p)) * (F.col("_total") - 1)
    return low + (high - low) * (exact - F.floor(exact))
