"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, with DataFrame functions only.

Targets are levels of water under caps. Blocks go to sources, and each source's blocks to its
shards, by the highest quotients t / (2k + 1). In a shard, documents stand in a seeded order,
and its blocks are taken from the start of that row of tokens, all of it first where the quota
is larger. So a shard takes its quota to the token, and most documents are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, running, stored

#: Tokens of a block.
BLOCK = 8
#: Documents of a shard (about), and shards of a source at most; a shard sorts rows of three numbers.
SHARD_DOCS, SHARDS = 1024, 4096


def apportion(parts: DataFrame, within: list[str], share: Column, seats: Column, order: list[str]) -> DataFrame:
    """Add `quota`: seats(within) go to the rows of parts by the highest quotients share / (2k + 1). Ties: by `order`.

    No share gets no seat. The shares of a group add up to any total. With n shares of total T,
    the quotients above T / (2 * seats - n) are no more than the seats, and those above
    T / (2 * seats + n) no fewer: only what lies between is ranked, about 2n quotients. Groups
    are ranked in one task each; without groups, all is ranked in parallel.
    """
    keys = list(dict.fromkeys([*within, *order]))
    x = parts.select(*keys, share.cast("double").alias("_share"), seats.cast("long").alias("_seats")).where("_share > 0")
    group = [F.col(c) for c in within] or [F.lit(0)]
    totals = x.groupBy(*(c.alias(f"_g{k}") for k, c in enumerate(group))).agg(F.sum("_share").alias("_all"), F.count("*").alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & c.eqNullSafe(F.col(f"_g{k}"))
    x = x.join(totals, same).drop(*(f"_g{k}" for k in range(len(group))))
    # One quotient more at either end makes up for the rounding of the divisions.
    least = F.greatest(F.floor(F.col("_share") * (F.col("_seats") - F.col("_n") / 2) / F.col("_all") + 0.5) - 1, F.lit(0))
    most = F.floor(F.col("_share") * (F.col("_seats") + F.col("_n") / 2) / F.col("_all") + 0.5) + 1
    x = x.withColumns({"_least": least.cast("long"), "_most": most.cast("long")})
    tries = x.withColumn("_k", F.explode(F.sequence("_least", "_most")))
    tries = tries.withColumn("_q", F.col("_share") / (2 * F.col("_k") + 1))
    by = [F.desc("_q"), *(F.col(c) for c in order), F.col("_k")]
    sure = x.groupBy(*within).agg(F.sum("_least").alias("_sure")) if within else x.agg(F.sum("_least").alias("_sure"))
    if within:
        ranked = tries.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).join(sure, within)
    else:
        ranked = running(tries, by).withColumn("_rank", F.col("at") + 1).drop("at").join(F.broadcast(sure))  # a row
    won = ranked.groupBy(*keys).agg((F.first("_least") + F.count_if(F.col("_rank") <= F.col("_seats") - F.col("_sure"))).alias("quota"))
    return parts.join(won, keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Add `target` to sources(key, source, source_size): share of all sizes by weight, under caps of cap times each size.

    Weights repeat along the sources by code point, null last. What a cap cuts off is shared
    by weight among the others: all sources are filled to one level of tokens a weight.
    """
    s = running(sources, [F.col("source").asc_nulls_last()]).withColumnRenamed("at", "rank")
    s = s.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"), "cap": F.col("source_size") * F.lit(float(cap))})
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    # By how early they are full: the first source that a common level doesn't fill sets the level.
    s = running(s, [F.col("cap") / F.col("w"), F.col("rank")], {"full": F.col("cap"), "past": F.col("w")})
    s = s.withColumn("level", (F.lit(total["size"] * float(share)) - F.col("full")) / (F.lit(total["w"]) - F.col("past")))
    first = s.where(F.col("level") * F.col("w") <= F.col("cap") * (1 + 1e-12)).agg(F.min_by("level", "at").alias("level")).first()["level"]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("w"))
    return s.withColumn("target", target).drop("rank", "w", "cap", "full", "past", "level", "at")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs(doc_id, text, source, ...).

    taken counts the words that the mix takes of the row, repeats included: for a whole
    cap, at most cap times its size. Null, empty and blank texts have size 0 and nothing is taken of them. A null
    source is a source like others, and the last. Rows that repeat are mixed one by one. An
    empty table gives an empty result. Reruns agree: nothing depends on the order of rows.
    Other columns are dropped.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size")).withColumn("key", key), "sized")
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, weights, share, cap)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    blocks = round(total * min(share, cap) / BLOCK)
    sources = apportion(sources, [], F.col("target"), F.lit(blocks), ["key"]).withColumn("shards", F.least(F.ceil(F.col("n") / SHARD_DOCS), F.lit(SHARDS)).cast("int"))
    sources = stored(sources.select("key", "source_size", "target", F.col("quota").alias("blocks"), "shards"), "sources")

    rows = rows.join(sources.select("key", "shards"), "key").withColumn("draw", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("shard", F.expr("pmod(xxhash64(draw), shards)").cast("int"))
    shards = rows.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).join(sources.select("key", "blocks"), "key")
    shards = apportion(shards, ["key"], F.col("shard_size"), F.col("blocks"), ["shard"])
    take = F.least(F.col("quota") * BLOCK, (F.col("shard_size") * F.lit(float(cap))).cast("long"))
    shards = stored(shards.select("key", "shard", "shard_size", take.alias("take")), "shards")

    before = F.coalesce(F.sum("size").over(Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before).join(shards, ["key", "shard"]).join(sources.select("key", "source_size", "target"), "key")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size"))).otherwise(0)
    part = F.col("take") - F.col("passes") * F.col("shard_size")
    rows = rows.withColumn("passes", passes.cast("long")).withColumn("part", part)
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("part") - F.col("start"), F.col("size")))
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))
