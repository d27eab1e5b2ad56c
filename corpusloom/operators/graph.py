"""Graphs by iterated joins: bounded reachability, ranks by peeling, paths that carry their bindings."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import running
from corpusloom.sources.tables import stored


#: Edges up to which the rest of a graph is peeled in one task.
REST = 200_000
#: Rounds after which the released nodes' tables are written as one.
ROUNDS = 16


def _peeled_rest(rows: pa.Table) -> pa.Table:
    """Peel a bounded rest: edges (src, node, need), ready nodes (rank), nodes reached before (got, rank, need). All reached nodes come back."""
    ready, got, best, need, edges = [], {}, {}, {}, {}
    for r in rows.to_pylist():
        if r["kind"] == "edge":
            edges.setdefault(r["src"], []).append(r["node"])
            need[r["node"]] = r["need"]
        elif r["kind"] == "ready":
            ready.append(r["node"])
            best[r["node"]] = r["rank"]
        else:
            got[r["node"]], best[r["node"]], need[r["node"]] = r["got"], r["rank"], r["need"]
    given, out = set(ready), []
    while ready:
        node = ready.pop()
        if node not in given:
            out.append((node, best[node], True))
        for to in edges.get(node, ()):
            got[to], best[to] = got.get(to, 0) + 1, max(best.get(to, 0), best[node] + 1)
            if got[to] == need[to]:
                ready.append(to)
    released = {x[0] for x in out} | given
    out += [(node, best[node], False) for node in got if node not in released]
    names = ["node", "rank", "released"]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], rows.schema.field("node").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=names)


def peeled_ranks(edges: DataFrame, rest: int = REST) -> DataFrame:
    """(node, rank, cyclic) of every node of edges(src, dst): the longest way from a node that no edge leads to, found by peeling.

    Each round takes the nodes whose edges have all been counted, reads the edges that leave them, once in all, and adds to
    how many of its edges each head has had; those that have had all are the next round's. Nodes that are never taken lie on
    cycles or behind them: they are cyclic, and get ranks of their own, in order, after all others. Repeated edges count
    once, edges with a null aren't counted. What is read is dropped when it is half of what is left; a rest of at most
    `rest` edges, counted, is peeled in one task, so that long chains don't cost a job for each node.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("src is not null and dst is not null").select("src", F.col("dst").alias("node")).distinct(), "edges")
    nodes = stored(edges.select(F.col("src").alias("node")).unionByName(edges.select("node")).distinct(), "nodes")
    needs = edges.groupBy("node").agg(F.count("*").alias("need"))
    edges = stored(edges.join(needs, "node").select("src", "node", "need"), "edges")
    kind = nodes.schema["node"].dataType.simpleString()
    front = stored(nodes.join(needs, "node", "left_anti").withColumn("rank", F.lit(0).cast("long")), "front")
    taken, waiting = [front], spark.createDataFrame([], f"node {kind}, got long, rank long, need long")
    left = size = edges.count()
    while left > rest and not front.isEmpty():
        hits = edges.join(front, edges["src"] == front["node"]).select(edges["node"], F.lit(1).cast("long").alias("got"), (F.col("rank") + 1).alias("rank"), "need")
        reached = hits.unionByName(waiting).groupBy("node").agg(F.sum("got").alias("got"), F.max("rank").alias("rank"), F.max("need").alias("need"))
        reached = stored(reached, "reached")
        front, waiting = reached.where("got = need").select("node", "rank"), reached.where("got < need")
        left -= edges.join(taken[-1], edges["src"] == taken[-1]["node"], "left_semi").count()
        taken.append(front)
        if len(taken) > ROUNDS:
            taken = [stored(reduce(DataFrame.unionByName, taken[:-1]), "taken"), front]
        if left < size / 2:
            done = reduce(DataFrame.unionByName, taken[:-1]).select(F.col("node").alias("src"))
            edges, size = stored(edges.join(done, "src", "left_anti"), "edges"), left
    done = reduce(DataFrame.unionByName, taken[:-1]) if len(taken) > 1 else front.limit(0)
    if 0 < left <= rest:
        none = lambda t: F.lit(None).cast(t)
        rows = edges.join(done.select(F.col("node").alias("src")), "src", "left_anti").select(F.lit("edge").alias("kind"), "src", "node", none("long").alias("got"), none("long").alias("rank"), "need")
        rows = rows.unionByName(front.select(F.lit("ready").alias("kind"), none(kind).alias("src"), "node", none("long").alias("got"), "rank", none("long").alias("need")))
        rows = rows.unionByName(waiting.select(F.lit("waiting").alias("kind"), none(kind).alias("src"), "node", "got", "rank", "need"))
        last = stored(rows.groupBy(F.lit("rest").alias("_g")).applyInArrow(_peeled_rest, f"node {kind}, rank long, released boolean"), "last")
        done = reduce(DataFrame.unionByName, [*taken, last.where("released").drop("released")])
        waiting = last.where("not released").select("node", "rank")
    else:
        done = reduce(DataFrame.unionByName, taken)
    done = stored(done, "ranks")
    # Nodes behind cycles may have been reached by the others: that counts for the rank after which they are put.
    top = done.select("rank").unionByName(waiting.select("rank")).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_top"))
    cyclic = running(nodes.join(done, "node", "left_anti"), ["node"]).join(F.broadcast(top)).select("node", (F.col("_top") + 1 + F.col("place")).alias("rank"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).unionByName(cyclic)


def bounded_reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): the shortest distance from each seed(node), at most depth edges(src, dst) long.

    A pair that was reached before isn't followed again, so cycles end. Each level is stored,
    so that the plan of the next one stays short.
    """
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    levels = [front.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("seed", "node")
        front = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        front = stored(front, "front")
        if front.isEmpty():
            break
        levels.append(front.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, levels)


def argument_flows(parameters: DataFrame, sites: DataFrame, arguments: DataFrame) -> DataFrame:
    """(callee, callee_param, caller, caller_param, site, line): which parameter of the caller a call hands to which one of the callee.

    parameters(function, pos, name), sites(site, caller, callee, line), arguments(site, pos or keyword, name). Arguments meet
    the callee's parameters by place or by keyword, and only names that are parameters of the caller flow on.
    """
    target = parameters.select(F.col("function").alias("callee"), F.col("pos").alias("_pos"), F.col("name").alias("callee_param"))
    handed = sites.join(arguments.select("site", F.col("pos").alias("_at"), "keyword", F.col("name").alias("caller_param")), "site")
    placed = handed.where("_at is not null").join(target, ["callee"]).where("_at = _pos")
    named = handed.where("keyword is not null").join(target.withColumnRenamed("callee_param", "keyword"), ["callee", "keyword"]).withColumn("callee_param", F.col("keyword"))
    both = placed.select("callee", "callee_param", "caller", "caller_param", "site", "line").unionByName(named.select("callee", "callee_param", "caller", "caller_param", "site", "line"))
    own = parameters.select(F.col("function").alias("caller"), F.col("name").alias("caller_param"))
    return both.join(own, ["caller", "caller_param"], "left_semi").distinct()


def incoming_paths(flows: DataFrame, targets: DataFrame, entries: DataFrame, depth: int = 6, most: int | None = None) -> DataFrame:
    """(target, parameter, entry, entry_param, depth, site, line, path): every way back from targets(function, parameter) to an entry(function).

    A way goes from a parameter to those that callers hand over for it, at most `depth` calls, and ends at the first entry.
    It never comes twice to the same parameter of the same function, but ways do so independently of each other: the state of
    the iteration is the whole way. path is parameter, then function and parameter of each call. Targets that no entry
    reaches have no row. The number of ways can grow with the branching to the power of `depth`; more than `most` at one
    depth, if given, are an error rather than cut off.
    """
    entry = entries.select(F.col("function").alias("caller"), F.lit(True).alias("_entry")).distinct()
    flows = stored(flows.join(entry, "caller", "left").withColumn("_entry", F.coalesce("_entry", F.lit(False))), "flows")
    state = lambda f, p: F.concat_ws("\0", F.col(f).cast("string"), F.col(p))
    front = targets.select(F.col("function").alias("target"), "parameter", F.col("function").alias("callee"), F.col("parameter").alias("callee_param"), F.array("parameter").alias("path"), F.array(state("function", "parameter")).alias("_seen")).distinct()
    found = []
    for d in range(1, depth + 1):
        step = front.join(flows, ["callee", "callee_param"])
        step = step.where(F.col("_entry") | (F.lit(d < depth) & ~F.array_contains("_seen", state("caller", "caller_param"))))
        step = stored(step.withColumn("path", F.concat("path", F.array(F.col("caller").cast("string"), F.col("caller_param")))), "step")
        n = step.count()
        if most is not None and n > most:
            raise ValueError(f"{n} ways at depth {d}, more than {most}")
        found.append(step.where("_entry").select("target", "parameter", F.col("caller").alias("entry"), F.col("caller_param").alias("entry_param"), F.lit(d).alias("depth"), "site", "line", "path"))
        if not n:
            break
        front = step.where("not _entry").select("target", "parameter", F.col("caller").alias("callee"), F.col("caller_param").alias("callee_param"), "path", F.concat("_seen", F.array(state("caller", "caller_param"))).alias("_seen"))
    return reduce(DataFrame.unionByName, found)
