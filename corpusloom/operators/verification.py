"""Findings against a manifest and against another read of the files they were found in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.readers import lines, stripped


def verified_findings(findings: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(finding_id, error, line_no): every rule that a stored finding breaks, line_no null for rules about the finding as a whole.

    findings(finding_id, repo, version, file, evidence_lines array<int>, evidence_hashes array<string>), manifest(repo,
    version), files(repo, file, text). Errors: `repeated id`, `outside manifest`, `other version`, `lengths differ`,
    `lines not sorted`, `file not found`, `line missing`, `hash differs`. The evidence of all findings meets the lines of the
    files in one join; only files that some finding names are split into lines, and only lines that meet evidence are hashed.
    Null arrays count as empty, a null hash as one that differs.
    """
    f = findings.withColumns({"evidence_lines": F.coalesce("evidence_lines", F.array().cast("array<int>")), "evidence_hashes": F.coalesce("evidence_hashes", F.array().cast("array<string>"))})
    listed = manifest.select("repo", F.col("version").alias("_listed"), F.lit(True).alias("_there")).dropDuplicates(["repo"])
    whole = f.join(listed, "repo", "left")
    uneven = F.size("evidence_lines") != F.size("evidence_hashes")
    unsorted = ~F.col("evidence_lines").eqNullSafe(F.array_sort(F.array_distinct("evidence_lines")))
    checks = F.array_compact(F.array(
        F.when(F.col("_there").isNull(), "outside manifest"), F.when(F.col("_there") & ~F.col("_listed").eqNullSafe(F.col("version")), "other version"),
        F.when(uneven, "lengths differ"), F.when(unsorted, "lines not sorted"),
    ))
    none = F.lit(None).cast("int")
    of_findings = whole.select("finding_id", F.explode(checks).alias("error"), none.alias("line_no"))
    repeated = f.groupBy("finding_id").agg(F.count("*").alias("_n")).where("_n > 1").select("finding_id", F.lit("repeated id").alias("error"), none.alias("line_no"))
    evidence = f.where(~uneven).select("finding_id", "repo", "file", F.explode(F.arrays_zip(F.col("evidence_lines").alias("line_no"), F.col("evidence_hashes").alias("hash"))).alias("e")).select("finding_id", "repo", "file", "e.*")
    named = files.join(evidence.select("repo", "file").distinct(), ["repo", "file"], "left_semi").withColumn("_key", F.struct("repo", "file"))
    there = named.select("repo", "file", F.lit(True).alias("_file")).distinct()
    source = lines(named, "_key").select("_key.*", "line_no", "line")
    met = evidence.join(there, ["repo", "file"], "left").join(source, ["repo", "file", "line_no"], "left")
    wrong = F.when(F.col("_file").isNull(), "file not found").when(F.col("line").isNull(), "line missing").when(~F.coalesce(F.col("hash") == F.sha2(stripped("line"), 256), F.lit(False)), "hash differs")
    of_lines = met.select("finding_id", wrong.alias("error"), "line_no").where("error is not null")
    return reduce(DataFrame.unionByName, [of_findings, repeated, of_lines])


def graph_report(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, view: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(graph_id, code, details, n) of every broken rule, and (type, graphs): how many graphs have nodes of each type.

    graphs(graph_id, candidate_id, verified, forbidden), nodes(graph_id, node_id, type), edges(graph_id, src, dst),
    view(graph_id, node_id). Codes: duplicate_graph_id, duplicate_candidate_id, evidence_hash_not_verified,
    forbidden_input_or_execution, duplicate_node_id, missing_required_node_types (in details), dangling_edge (n of them),
    incomplete_view (n nodes on one side alone). Rules are anti joins and counts by graph; a graph's nodes and edges never
    meet in one row.
    """
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    row = lambda df, code, details=none, n=one: df.select("graph_id", F.lit(code).alias("code"), details.alias("details"), n.alias("n"))
    twice = lambda by, df: df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1")
    candidates = twice(["candidate_id"], graphs.where("candidate_id is not null")).select("candidate_id")
    types = nodes.where("type is not null").select("graph_id", "type").distinct()
    wanted = graphs.select("graph_id").distinct().withColumn("type", F.explode(F.array(*map(F.lit, required))))
    missing = wanted.join(types, ["graph_id", "type"], "left_anti").groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("details"))
    known = nodes.select("graph_id", "node_id").distinct()
    ends = edges.withColumn("_edge", F.monotonically_increasing_id()).select("graph_id", "_edge", F.explode(F.array("src", "dst")).alias("node_id"))
    dangling = ends.join(known, ["graph_id", "node_id"], "left_anti").groupBy("graph_id").agg(F.count_distinct("_edge").alias("n"))
    sides = known.withColumn("_in", F.lit(1)).unionByName(view.select("graph_id", "node_id").distinct().withColumn("_in", F.lit(2)))
    uneven = sides.groupBy("graph_id", "node_id").agg(F.sum("_in").alias("_in")).where("_in < 3").groupBy("graph_id").agg(F.count("*").alias("n"))
    found = [
        row(twice(["graph_id"], graphs), "duplicate_graph_id"), row(graphs.join(candidates, "candidate_id", "left_semi"), "duplicate_candidate_id"),
        row(graphs.where("not coalesce(verified, false)"), "evidence_hash_not_verified"), row(graphs.where("coalesce(forbidden, false)"), "forbidden_input_or_execution"),
        row(twice(["graph_id", "node_id"], nodes).select("graph_id").distinct(), "duplicate_node_id"), row(missing, "missing_required_node_types", F.col("details")),
        row(dangling, "dangling_edge", none, F.col("n")), row(uneven, "incomplete_view", none, F.col("n")),
    ]
    return reduce(DataFrame.unionByName, found), types.groupBy("type").agg(F.count("*").alias("graphs"))


def sample_report(sample: DataFrame, population: DataFrame, strata: list[str], key: str, quota: int) -> DataFrame:
    """(rule, violations) of a stratified sample(key, strata, weight): `repeated`, `outside`, `quota` (strata with more or fewer than the quota, or than all they have), `uncovered` strata, `weight` (rows whose weight isn't rows over rows taken)."""
    sizes = population.groupBy(*strata).agg(F.count("*").alias("_all"))
    taken = sample.groupBy(*strata).agg(F.count_distinct(key).alias("_taken"))
    both = sizes.alias("l").join(taken.alias("r"), [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s in strata], "left").select("l.*", "_taken")
    weighed = sample.alias("l").join(both.alias("r"), [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s in strata]).select("weight", "_all", "_taken")
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
    found = [
        count(sample.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated"), count(sample.join(population.select(key), key, "left_anti"), "outside"),
        count(both.where(f"_taken <> least(_all, {quota})"), "quota"), count(both.where("_taken is null"), "uncovered"), count(weighed.where("weight is null or abs(weight - _all / _taken) > 1e-9"), "weight"),
    ]
    return reduce(DataFrame.unionByName, found)
