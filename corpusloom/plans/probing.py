"""Queries that plant probe programs in repositories, scan them, and hold the findings against what they should be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import probes, scan
from corpusloom.plans.registry import query
from corpusloom.sources.readers import table

RULES = [
    scan.Rule("command_execution", "py_subprocess", "subprocess[.]run[(]", "high", (".py",)),
    scan.Rule("command_execution", "ts_spawn", "spawn[(]", "high", (".ts",)),
    scan.Rule("network_access", "py_requests", "requests[.]get[(]", "medium", (".py",)),
    scan.Rule("network_access", "ts_fetch", "fetch[(]", "medium", (".ts",)),
]
_DECLARED = [r"^\s*(?:async )?def ([A-Za-z_]\w*)", r"^\s*(?:export )?(?:async )?function ([A-Za-z_]\w*)"]


def _sql(value: object) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


_FIELDS = ("number", "name", "category", "symbol", "dependency", "source_type", "guard_kind", "polarity", "text")
_ROWS = ", ".join(
    f"({suite}, {_sql(language)}, {', '.join(_sql(getattr(p, f)) for f in _FIELDS)})"
    for suite, (languages, *_) in probes.SUITES.items() for language in languages for p in probes.probes(suite, language)
)
_PLANTED = f"""with t(suite, language, {", ".join(_FIELDS)}) as (values {_ROWS}),
r as (select 'R' || c_custkey sample_id, case when c_nationkey % 3 = 0 then 'typescript' else 'python' end lang from customer),
p as (select suite, sample_id, 'MUT-' || sample_id || '-' || number probe_id, 'probes/' || lower(sample_id) || '_' || name || case language when 'python' then '.py' else '.ts' end file, category, symbol, dependency, source_type, guard_kind, polarity, text from r join t on lang = language)"""


#: Repositories in a task, of some 43 programs each.
TASK_REPOSITORIES = 2000


def _repositories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("sample_id"), F.when(F.col("c_nationkey") % 3 == 0, "typescript").otherwise("python").alias("language"))


def _planted(r: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All suites' programs for the repositories, which customers stand for; the later suites are for those in Python."""
    of = [probes.planted(r if len(languages) > 1 else r.where(F.col("language").isin(*languages)), suite, keep=keep).withColumn("suite", F.lit(suite)) for suite, (languages, *_) in probes.SUITES.items()]
    return reduce(DataFrame.unionByName, of)


@query(_PLANTED + " select suite, sample_id, probe_id, file, category, symbol, dependency, source_type, guard_kind, polarity, sha256(text) text_sha256 from p")
def a18_probe_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every repository by every program of its suites, with the outcome that a detector should report."""
    return _planted(_repositories(spark, sf)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(_PLANTED + r""", l as (select suite, file, category, symbol, unnest(string_split(text, chr(10))) line from p),
f as (select distinct suite, file, symbol, case when regexp_matches(line, 'subprocess[.]run[(]|spawn[(]') then 'command_execution' when regexp_matches(line, 'requests[.]get[(]|fetch[(]') then 'network_access' end found from l),
m as (select p.suite, p.polarity, p.dependency, count(f.found) n from p left join f on f.suite = p.suite and f.file = p.file and f.symbol = p.symbol and f.found = p.category group by p.suite, p.polarity, p.dependency, p.probe_id)
select suite, polarity, dependency, count(*) probes, count(*) filter (n = 1) found_once, count(*) filter (n = 0) missed, count(*) filter (n > 1) ambiguous from m group by all""")
def a18_probes_found(spark: SparkSession, sf: str) -> DataFrame:
    """The planted programs are scanned with symbols, each in its own row; each should have one finding of its file, category and symbol. Only repositories are shuffled."""
    r = _repositories(spark, sf)
    tasks = max(1, -(-r.count() // TASK_REPOSITORIES))
    r = r.repartition(tasks, "sample_id").groupBy("sample_id", "language").agg(F.count("*").alias("claims"))
    p = _planted(r, keep=("claims",)).withColumn("suffix", F.concat(F.lit("."), F.substring_index("file", ".", -1)))
    return probes.found_once(scan.file_hits(p, RULES, _DECLARED, "suffix"), ["suite", "polarity", "dependency"])
