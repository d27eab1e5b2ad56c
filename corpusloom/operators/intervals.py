"""Interval stabbing: the narrowest span of another table around each point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored

#: Points of a cell up to which it is one key of the join; cells with more are salted.
CELL = 100_000
#: Hot cells up to which their table is broadcast.
SMALL = 100_000


def _level(low: str, high: str) -> Column:
    """Cells of 2 to this power are wider than the span, which so lies in one of them or in two neighbours."""
    return F.length(F.bin(F.col(high) - F.col(low)))


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, point: str, span: str, cell: int = CELL) -> DataFrame:
    """(point, span, width) of each point(key, at) that some span(key, low, high) of its key holds, ends included: the narrowest, of equal ones the smallest.

    at, low and high are longs. An index of cells that grow by powers of two holds each span once or twice, however long it
    is, and a point looks into one cell of each level that occurs, 63 at most; so long spans are never spread over many
    cells and no range is compared outside a cell. Spans of the same ends count once. Cells with more than `cell` points are
    dealt out by salt, their spans copied to each share. Points and spans with a null or with high < low meet nothing; points
    outside all spans have no row.
    """
    s = spans.where(f"{key} is not null and {low} <= {high}").groupBy(key, low, high).agg(F.min(span).alias("_span")).withColumn("_level", _level(low, high))
    s = s.select(key, "_span", F.col(low).alias("_low"), F.col(high).alias("_high"), "_level", F.explode(F.array_distinct(F.array(F.expr(f"shiftright({low}, _level)"), F.expr(f"shiftright({high}, _level)")))).alias("_cell"))
    s = stored(s, "spans")
    levels = [r[0] for r in s.select("_level").distinct().collect()]  # 63 at most
    p = points.where(f"{key} is not null and {at} is not null").select(F.col(point).alias("_point"), key, F.col(at).alias("_at"), F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")).alias("_level"))
    p = p.withColumn("_cell", F.expr("shiftright(_at, _level)"))
    own = [key, "_level", "_cell"]
    p = stored(p.join(s.select(own).distinct(), own, "left_semi"), "points")
    hot = stored(p.groupBy(own).agg(F.ceil(F.count("*") / cell).cast("int").alias("_shares")).where("_shares > 1"), "hot")
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot
    shares = F.coalesce("_shares", F.lit(1))
    p = p.join(hot, own, "left").withColumn("_salt", F.pmod(F.xxhash64("_point"), shares).cast("int")).drop("_shares")
    s = s.join(hot, own, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    met = p.join(s, [*own, "_salt"]).where("_at between _low and _high")
    best = met.groupBy(F.col("_point").alias(point)).agg(F.min(F.struct((F.col("_high") - F.col("_low")).alias("width"), "_span")).alias("_b"))
    return best.select(point, F.col("_b._span").alias(span), F.col("_b.width").alias("width"))
