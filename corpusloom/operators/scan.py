"""Rule scan over lines, and findings with content-hashed identities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.readers import line_arrays, lines, stripped

COMMENTS = ("#", "//", "/*", "*", '"""', "'''")
LONGEST_LINE = 2000
EVIDENCE_LINES = 50


@dataclass(frozen=True)
class Rule:
    category: str
    detector: str
    pattern: str
    confidence: str
    #: Suffixes, or languages, that the rule is for; none: all.
    suffixes: tuple[str, ...] = ()


def _begins(line: Column, *with_: str) -> Column:
    return line.rlike(r"^\s*(?:" + "|".join(rf"\Q{x}\E" for x in with_) + ")")


def _applies(suffixes: tuple[str, ...], suffix: str | None) -> Column:
    return F.col(suffix).isin(*suffixes) if suffix and suffixes else F.lit(True)


def _kept(line: Column, rules: list[Rule], suffix: str | None) -> Column:
    """Whether the line meets a rule that applies, told by one regex for each list of suffixes, and is neither long nor a comment."""
    some = [_applies(of, suffix) & line.rlike("(?i)" + "|".join(f"(?:{r.pattern})" for r in rules if r.suffixes == of)) for of in dict.fromkeys(r.suffixes for r in rules)]
    return reduce(Column.__or__, some) & (F.char_length(line) <= LONGEST_LINE) & ~_begins(line, *COMMENTS)


def _met(line: Column, rules: list[Rule], suffix: str | None) -> Column:
    return F.array_compact(F.array(*(F.when(_applies(r.suffixes, suffix) & line.rlike("(?i)" + r.pattern), F.struct(F.lit(r.category).alias("category"), F.lit(r.detector).alias("detector"), F.lit(r.confidence).alias("confidence"))) for r in rules)))


def matches(files: DataFrame, key: str, rules: list[Rule], suffix: str | None = None) -> DataFrame:
    """(key, line_no, line, category, detector, confidence): a row for each rule that a line meets.

    suffix: a column of files that tells which rules apply; without it all do. All patterns are
    literals of one projection over each line; comments, long lines, and lines that meet none
    of the patterns go first.
    """
    kept = lines(files, key, keep=(suffix,) if suffix else ()).where(_kept(F.col("line"), rules, suffix))
    return kept.withColumn("hit", F.explode(_met(F.col("line"), rules, suffix))).select(key, "line_no", "line", "hit.*")


#: Lines up to which a hit looks back for the declaration it stands in, and lines after a decorator in which it looks for what is decorated.
LOOK_BACK, LOOK_AHEAD = 30, 8


def with_symbols(hits: DataFrame, files: DataFrame, key: str, declarations: list[str], decorator: str = "@") -> DataFrame:
    """hits of matches() with `symbol`: the name in the nearest line, from the hit's own at most LOOK_BACK up, that declares one.

    declarations are regexes whose first group is the name; the first that a line meets counts. A hit in a line that begins
    with the decorator takes the first name declared in the LOOK_AHEAD lines after it, if there is one. Else symbol is null.
    Declarations and hits meet in one window a block of lines: both lie in blocks of LOOK_BACK + LOOK_AHEAD lines, and a
    declaration is copied to the neighbours from which it can be seen, so that a long file is no single task.
    """
    span = LOOK_BACK + LOOK_AHEAD
    name = F.coalesce(*(F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in declarations))
    some = F.col("line").rlike("|".join(f"(?:{p})" for p in declarations))
    block = lambda at: F.floor((at - 1) / span)
    declared = lines(files.join(hits.select(key).distinct(), key, "left_semi"), key).where(some).select(key, "line_no", name.alias("_name")).where("_name is not null")
    declared = declared.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("line_no")), block(F.col("line_no") + LOOK_BACK), block(F.greatest(F.col("line_no") - LOOK_AHEAD, F.lit(1)))))))
    own = hits.select(key, "line_no", F.startswith(F.regexp_replace("line", r"^\s+", ""), F.lit(decorator)).alias("_decorated")).distinct().withColumn("_block", block(F.col("line_no")))
    both = declared.select(key, "_block", "line_no", "_name", F.lit(False).alias("_decorated"), F.lit(0).alias("_hit"))
    both = both.unionByName(own.select(key, "_block", "line_no", F.lit(None).cast("string").alias("_name"), "_decorated", F.lit(1).alias("_hit")))
    by = Window.partitionBy(key, "_block").orderBy("line_no")
    found = F.struct("line_no", "_name")
    up = F.max(F.when(F.col("_name").isNotNull(), found)).over(by.rangeBetween(-LOOK_BACK, 0))["_name"]
    down = F.min(F.when(F.col("_name").isNotNull(), found)).over(by.rangeBetween(1, LOOK_AHEAD))["_name"]
    named = both.withColumn("symbol", F.when(F.col("_decorated"), F.coalesce(down, up)).otherwise(up)).where("_hit = 1").select(key, "line_no", "symbol")
    return hits.join(named, [key, "line_no"])


def file_hits(files: DataFrame, rules: list[Rule], declarations: list[str], suffix: str | None = None, text: str = "text", decorator: str = "@") -> DataFrame:
    """files with `hits` for their text: an array of (line_no, line, category, detector, confidence, symbol), as with_symbols() gives them to the hits of matches().

    All is found within a file's own row, so nothing is shuffled and keys needn't be single; a symbol is looked for in no more
    lines than a hit can see. A file's hits lie in one row: for files with very many of them there are the other two.
    """
    some = "|".join(f"(?:{p})" for p in declarations)
    name = lambda line: F.when(line.rlike(some), F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in declarations)))
    nearest = lambda of: F.aggregate(of, F.lit(None).cast("string"), lambda found, line: F.coalesce(found, name(line)))

    def symbol(at: Column, line: Column) -> Column:
        first = F.greatest(at - LOOK_BACK, F.lit(1))
        up = nearest(F.reverse(F.slice("_lines", first, at - first + 1)))
        down = nearest(F.slice("_lines", at + 1, F.lit(LOOK_AHEAD)))
        return F.when(_begins(line, decorator), F.coalesce(down, up)).otherwise(up)

    def hits(line: Column, at: Column) -> Column:
        fields = lambda h: F.struct(at.alias("line_no"), line.alias("line"), *(h[c].alias(c) for c in ("category", "detector", "confidence")), symbol(at, line).alias("symbol"))
        return F.when(_kept(line, rules, suffix), F.transform(_met(line, rules, suffix), fields))

    return line_arrays(files, text).withColumn("hits", F.flatten(F.array_compact(F.transform("_lines", lambda line, i: hits(line, i + 1))))).drop("_lines")


def evidence(hits: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(key, by, evidence_lines, evidence_hashes): the first EVIDENCE_LINES lines of each finding, in order, and their hashes."""
    pairs = F.slice(F.array_sort(F.collect_set(F.struct("line_no", F.sha2(stripped("line"), 256).alias("hash")))), 1, EVIDENCE_LINES)
    return hits.groupBy(key, *by).agg(pairs.alias("_e")).select(key, *by, F.col("_e.line_no").alias("evidence_lines"), F.col("_e.hash").alias("evidence_hashes"))


def identity(prefix: str, digits: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)))


def findings(hits: DataFrame, key: str, symbol: str | None = None, by_line: bool = False, prefixes: tuple[str, str] = ("F-", "FP-")) -> DataFrame:
    """One row per (key, category, symbol): lines, detectors, the position id and the fingerprint that survives moved lines.

    symbol: a column of hits; without it, or where it is null, hits are of `<module>`. by_line: one
    row per line. The fingerprint has the hashes of the first EVIDENCE_LINES lines, sorted; prefixes
    are those of the position id and of the fingerprint.
    """
    of = F.coalesce(F.col(symbol), F.lit("<module>")) if symbol else F.lit("<module>")
    hits = hits.withColumn("symbol", of).withColumn("_at", F.col("line_no") if by_line else F.lit(0))
    first = lambda h: F.array_sort(F.transform(F.slice(F.array_sort(h), 1, EVIDENCE_LINES), lambda x: x["h"]))
    g = hits.withColumn("h", F.sha2(stripped("line"), 256)).groupBy(key, "category", "symbol", "_at").agg(
        F.array_sort(F.collect_set("line_no")).alias("all_lines"), first(F.collect_set(F.struct("line_no", "h"))).alias("hashes"),
        F.array_sort(F.collect_set("detector")).alias("d"), F.max((F.col("confidence") == "high").cast("int")).alias("high"),
    )
    d = F.array_join("d", ";")
    return g.select(
        key, "category", "symbol", F.array_min("all_lines").alias("line_start"), F.array_max("all_lines").alias("line_end"), F.size("all_lines").alias("match_count"),
        F.array_join(F.slice("all_lines", 1, EVIDENCE_LINES).cast("array<string>"), ",").alias("evidence_lines"), d.alias("detectors"), F.when(F.col("high") == 1, "high").otherwise("medium").alias("confidence"),
        identity(prefixes[0], 16, F.col(key).cast("string"), F.col("category"), F.col("symbol"), F.array_min("all_lines").cast("string"), d).alias("finding_id"),
        identity(prefixes[1], 24, F.col(key).cast("string"), F.col("category"), F.col("symbol"), d, F.array_join("hashes", ";")).alias("fingerprint"),
    )
