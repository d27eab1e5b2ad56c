"""Records in files: JSON lines, CSV, JSON by file, baselines, SARIF and tool reports, in and out."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import unquoted
from corpusloom.sources.tables import renamed

_LOCATION = "struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int, endLine int>>>"
_RULES = "array<struct<id string, name string, defaultConfiguration struct<level string>>>"
_FLOWS = f"array<struct<threadFlows array<struct<locations array<struct<location {_LOCATION}>>>>>>"
SARIF = (
    f"runs array<struct<tool struct<driver struct<name string, rules {_RULES}>>, results array<struct<ruleId string, level string,"
    f" message struct<text string>, locations array<{_LOCATION}>, codeFlows {_FLOWS}, partialFingerprints map<string, string>>>>>"
)
REPORT = "results array<struct<check_id string, path string, start struct<line int>, end struct<line int>, extra struct<severity string, message string>>>"


def required(df: DataFrame, need: tuple[str, ...] = (), unique: str | None = None) -> DataFrame:
    """df; an error if a needed column is null or empty somewhere, or if a value of `unique` is missing or occurs twice."""
    blank = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in {*need, *([unique] if unique else [])}]
    bad = {c: n for c, n in (df.agg(*blank).first().asDict() if blank else {}).items() if n}
    if bad:
        raise ValueError(f"rows without a value: {bad}")
    if unique and (twice := df.groupBy(unique).count().where("count > 1").first()):
        raise ValueError(f"{unique} {twice[0]} occurs {twice[1]} times")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, need: tuple[str, ...] = (), unique: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped, malformed ones are an error."""
    return required(spark.read.schema(schema).option("mode", "FAILFAST").json(path), need, unique)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Keys sorted, nulls kept. A whole new folder appears at once, by a rename; append adds files to it."""
    out = df.select(*sorted(df.columns)).write.option("ignoreNullFields", False)
    if append:
        out.mode("append").json(path)
        return
    part = f"{path}.{uuid.uuid4().hex}"
    out.json(part)
    renamed(df.sparkSession, part, path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the header's names. A byte order mark goes; quoted fields may hold quotes, commas and line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_records(spark: SparkSession, path: str, schema: str, name: str, pattern: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """Records of all files below path that glob names, and in column `name` what the pattern's group finds in a file's path."""
    files = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return files.json(path).select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias(name))


def write_baseline(found: DataFrame, path: str, kind: str, version: int = 1, a_file: int = 10_000) -> None:
    """Distinct fingerprints of found, about `a_file` in a JSON object."""
    each = found.select("fingerprint").where("fingerprint is not null").distinct()
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(max(1, math.ceil(each.count() / a_file))))
    held = each.groupBy(bucket.alias("b")).agg(F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    held.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), "fingerprints"))).write.text(path)


def read_baseline(spark: SparkSession, path: str, kind: str, version: int = 1, multi_line: bool = False) -> DataFrame:
    """(fingerprint); an error on another kind or version, on missing fingerprints and on repeats."""
    files = spark.read.schema("kind string, version int, fingerprints array<string>").option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
    fine = F.col("kind").eqNullSafe(kind) & F.col("version").eqNullSafe(version) & F.col("fingerprints").isNotNull()
    if other := files.where(~fine).first():
        raise ValueError(f"no baseline of kind {kind}, version {version}: {other['kind']}, {other['version']}")
    return required(files.select(F.explode("fingerprints").alias("fingerprint")), unique="fingerprint")


def _uri(path: Column) -> Column:
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def _place(path: Column, start: Column, end: Column) -> Column:
    region = F.struct(start.cast("int").alias("startLine"), end.cast("int").alias("endLine"))
    return F.struct(F.struct(F.struct(_uri(path).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))


def sarif_logs(found: DataFrame, key: str, tool: str) -> DataFrame:
    """(key, log): a SARIF 2.1.0 log as JSON for each key, its rules by id and its results by path, line and rule.

    found(key, rule, level, message, path, line_start, line_end, fingerprint, flow array<struct<path, line>>).
    A key's results make one document, so choose keys (files, repositories) whose findings one document can hold.
    """
    steps = F.transform("flow", lambda s: F.struct(_place(s["path"], s["line"], s["line"]).alias("location")))
    flows = F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows")))
    result = F.struct(
        F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(_place(F.col("path"), F.col("line_start"), F.col("line_end"))).alias("locations"),
        F.when(F.size("flow") > 0, flows).alias("codeFlows"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"),
    )
    rule = F.struct(F.col("rule").alias("id"), F.initcap(F.replace("rule", F.lit("_"), F.lit(" "))).alias("name"))
    g = found.groupBy(key).agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.array_sort(F.collect_list(F.struct("path", "line_start", "rule", "fingerprint", result.alias("r")))).alias("found"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), F.transform("found", lambda x: x["r"]).alias("results"))
    return g.select(key, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("log"))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, log) of each *.sarif file below path; sample_id is its name without the suffix."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sarif").text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)[.]sarif$", 1).alias("sample_id"), F.col("value").alias("log"))


def sarif_results(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """(key, rule, rule_name, level, message, fingerprints, places): a row for each result of each run. What is no SARIF gives none.

    The level is the result's, else its rule's, else `warning`. places: its own locations and those of its flows.
    """
    run = logs.select(key, F.explode(F.from_json(log, SARIF)["runs"]).alias("run"))
    r = run.select(key, F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r")).withColumn("id", F.col("r.ruleId"))
    rule = F.get(F.filter("rules", lambda x: x["id"] == F.col("id")), F.lit(0))
    flat = lambda a: F.flatten(F.array_compact(a))
    flow = flat(F.transform("r.codeFlows", lambda c: flat(F.transform(c["threadFlows"], lambda t: F.transform(t["locations"], lambda x: x["location"])))))
    return r.select(
        key, F.col("id").alias("rule"), rule["name"].alias("rule_name"), F.coalesce("r.level", rule["defaultConfiguration"]["level"], F.lit("warning")).alias("level"),
        F.col("r.message.text").alias("message"), F.col("r.partialFingerprints").alias("fingerprints"), flat(F.array("r.locations", flow)).alias("places"),
    )


def sarif_locations(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, line_start, line_end), distinct: percent escapes undone, a leading `./` gone, one line where there is no end."""
    at = results.select(*keys, F.explode("places").alias("p")).select(*keys, "p.physicalLocation.*")
    start = F.col("region.startLine")
    path = F.regexp_replace(unquoted(F.col("artifactLocation.uri")), "^([.]/)+", "")
    return at.select(*keys, path.alias("path"), start.alias("line_start"), F.coalesce("region.endLine", start).alias("line_end")).where("path is not null").distinct()


def report_results(reports: DataFrame, key: str, report: str = "report", mount: str = "/src/") -> DataFrame:
    """(key, rule, path, line_start, line_end, severity, message) of a scanner's JSON report; paths below where its container mounted the tree."""
    r = reports.select(key, F.explode(F.from_json(report, REPORT)["results"]).alias("r"))
    path = F.when(F.startswith("r.path", F.lit(mount)), F.substring("r.path", len(mount) + 1, 1 << 30)).otherwise(F.col("r.path"))
    return r.select(key, F.col("r.check_id").alias("rule"), path.alias("path"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), "r.extra.severity", "r.extra.message")
