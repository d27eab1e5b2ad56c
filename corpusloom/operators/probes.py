"""Probe programs: short sources with one sensitive operation each, composed by rule, and what a detector should say of them."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Origin of the value: kind of source (None: no dependency), line before the function, parameter, first line, expression.
ORIGINS = {
    "python": {
        "tool": ("agent_tool_parameter", "@mcp.tool()", "given", "", "given"),
        "parameter": ("function_parameter", "", "given", "", "given"),
        "environment": ("source_api", "", "", "", "os.getenv('PROBE_VALUE')"),
        "fixed": (None, "", "given", "", "'echo probe'"),
        "overwritten": (None, "", "given", "given = 'echo probe'", "given"),
        "discarded": (None, "", "", "os.getenv('PROBE_VALUE')", "'echo probe'"),
    },
    "typescript": {
        "parameter": ("function_parameter", "", "given: string", "", "given"),
        "request": ("source_api", "", "", "", "request.json()"),
        "fixed": (None, "", "given: string", "", "'echo probe'"),
    },
}
#: What happens to the value on its way.
STEPS = {"python": {"direct": "{}", "trimmed": "{}.strip()", "formatted": "('%s' % {})"}, "typescript": {"direct": "{}", "trimmed": "{}.trim()"}}
#: Lines before the operation, and the kind of guard that they are; an unrelated one guards nothing.
GUARDS = {
    "python": {"open": ([], None), "checked": (["if not value:", "    return None"], "dominating_if"), "asserted": (["assert value"], "preceding_assert"), "unrelated": (["if approved():", "    print('audit only')"], None)},
    "typescript": {"open": ([], None), "checked": (["if (!value) return null;"], "dominating_if"), "unrelated": (["if (approved()) console.log('audit only');"], None)},
}
SINKS = {
    "python": {"command": ("command_execution", "subprocess.run(value, shell=True)"), "network": ("network_access", "requests.get(value, timeout=2)")},
    "typescript": {"command": ("command_execution", "spawn('sh', ['-c', value])"), "network": ("network_access", "fetch(value)")},
}
#: Languages, origins, steps, guards and sinks of a suite; parts that a language hasn't are left out.
SUITES = {
    1: (("python", "typescript"), ("tool", "parameter", "environment", "request", "fixed"), ("direct",), ("open", "unrelated"), ("command", "network")),
    2: (("python",), ("tool", "parameter", "environment", "overwritten"), ("trimmed",), ("open", "checked"), ("command", "network")),
    3: (("python",), ("tool", "parameter", "environment", "fixed"), ("direct", "formatted"), ("open", "asserted"), ("command",)),
    4: (("python",), ("tool", "parameter", "environment", "overwritten", "fixed", "discarded"), ("direct", "trimmed"), ("open",), ("command",)),
}
_CODES, _SUFFIXES = {"python": "PY", "typescript": "TS"}, {"python": "py", "typescript": "ts"}


@dataclass(frozen=True)
class Probe:
    number: str
    name: str
    category: str
    symbol: str
    dependency: bool
    source_type: str | None
    guard_kind: str | None
    polarity: str
    text: str


def _program(language: str, symbol: str, origin: tuple, step: str, guard: list[str], sink: str) -> str:
    _, before, parameter, first, value = origin
    value = step.format(value)
    if language == "python":
        body = [*([first] if first else []), f"value = {value}", *guard, f"return {sink}"]
        head = ["import os", "import subprocess", "", "import requests", "", *([before] if before else []), f"def {symbol}({parameter}):"]
        return "\n".join(head + ["    " + x for x in body]) + "\n"
    body = [f"const value = {value};", *guard, f"return {sink};"]
    return "\n".join([f"export function {symbol}({parameter}) {{", *("  " + x for x in body), "}"]) + "\n"


def probes(suite: int, language: str) -> list[Probe]:
    """All programs of a suite in a language; none if the suite hasn't it."""
    languages, *parts = SUITES[suite]
    have = (ORIGINS, STEPS, GUARDS, SINKS)
    chosen = [[p for p in part if p in of[language]] for part, of in zip(parts, have, strict=True)] if language in languages else [[]]
    out = []
    for names in product(*chosen):
        origin, step, (guard, kind), (category, sink) = (of[language][n] for n, of in zip(names, have, strict=True))
        source = origin[0]
        polarity = "negative_constant" if source is None else "negative_guard" if names[2] == "unrelated" else "positive" if kind is None else "positive_guarded"
        symbol = "probe_" + "_".join(names)
        out.append(Probe(f"{_CODES[language]}{suite}-{len(out) + 1:02d}", "_".join(names), category, symbol, source is not None, source, kind, polarity, _program(language, symbol, origin, step, guard, sink)))
    return out


def _literal(probe: Probe) -> Column:
    return F.struct(*(F.lit(v).cast("boolean" if f.name == "dependency" else "string").alias(f.name) for f, v in zip(fields(probe), astuple(probe), strict=True)))


def planted(repositories: DataFrame, suite: int, key: str = "sample_id", language: str = "language", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, probe_id, file, category, symbol, dependency, source_type, guard_kind, polarity, text): a suite's programs for each repository.

    The programs are literals of the plan, so repositories are read once and nothing is shuffled. A language
    that the suite hasn't is an error, as is a null one; a null key is kept and gives null ids and files.
    """
    known = {x: probes(suite, x) for x in SUITES[suite][0]}
    which = F.raise_error(F.concat(F.lit(f"suite {suite} has no programs in "), F.coalesce(F.col(language), F.lit("a null language"))))
    which = which.cast("array<" + "struct<" + ",".join(f"{f.name}:{'boolean' if f.name == 'dependency' else 'string'}" for f in fields(Probe)) + ">>")
    suffix = F.lit(None).cast("string")
    for x, of in known.items():
        which = F.when(F.col(language) == x, F.array(*map(_literal, of))).otherwise(which)
        suffix = F.when(F.col(language) == x, F.lit(_SUFFIXES[x])).otherwise(suffix)
    ident = F.col("_key").cast("string")
    each = repositories.select(F.col(key).alias("_key"), *keep, suffix.alias("_suffix"), F.inline(which))
    return each.select(
        F.col("_key").alias(key), *keep, F.concat(F.lit("MUT-"), ident, F.lit("-"), F.col("number")).alias("probe_id"), F.concat(F.lit("probes/"), F.lower(ident), F.lit("_"), F.col("name"), F.lit("."), F.col("_suffix")).alias("file"),
        "category", "symbol", "dependency", "source_type", "guard_kind", "polarity", "text",
    )


def matched(expected: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """expected with `matches`, the number of findings of its keys, and `claims`, that of expected rows which share them.

    An evaluation is fair where both are one. Both sides are counted before they meet, so a repeated key multiplies nothing.
    """
    found = findings.groupBy(*keys).agg(F.count("*").alias("matches"))
    claims = expected.groupBy(*keys).agg(F.count("*").alias("claims"))
    return expected.join(claims.join(found, keys, "left"), keys, "left").fillna(0, ["matches"])


def found_once(scanned: DataFrame, by: list[str]) -> DataFrame:
    """(by, probes, found_once, missed, ambiguous) of planted programs with their `hits` and `claims`, the number of repositories of their key.

    A program is its file's only one, so its own hits alone can be of its file, category and symbol. Programs without an id
    have no file, are missed, and count as one.
    """
    own = F.exists("hits", lambda h: (h["category"] == F.col("category")) & (h["symbol"] == F.col("symbol")))
    found = F.coalesce(own, F.lit(False)) & F.col("file").isNotNull()
    nameless = F.max(F.col("probe_id").isNull().cast("long"))
    return scanned.select(*by, "probe_id", "claims", found.alias("_found")).groupBy(*by).agg(
        (F.count("probe_id") + nameless).alias("probes"), F.count_if(F.expr("_found and claims = 1")).alias("found_once"),
        (F.count_if(F.expr("not _found and probe_id is not null")) + nameless).alias("missed"), F.count_if(F.expr("_found and claims > 1")).alias("ambiguous"),
    )
