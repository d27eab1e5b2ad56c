"""Scalar functions over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex. `*` and `?` cross slashes; `[seq]` is one of a set, `[!seq]` none of it."""
    out, at = "^", 0
    while at < len(pattern):
        c, end = pattern[at], pattern.find("]", at + 2 + pattern.startswith("[!", at))
        if c == "[" and end > 0:
            body = pattern[at + 1 : end]
            out += "[" + ("^" if body[0] == "!" else "") + re.sub(r"([\\\[^&])", r"\\\1", body.removeprefix("!")) + "]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        at += 1
    return out + "$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether the whole path, or its last part, meets one of the globs."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p)) | base.rlike(glob_regex(p))
    return hit


def suffix(path: Column) -> Column:
    """The lower-cased last suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"([.][^./]+)$", 1))


def normal_path(path: Column) -> Column:
    """A path without `.`, without empty parts and with each `..` taken off where there is a part before it; `.` if nothing is left. Leading slashes count as one."""
    rooted = F.startswith(path, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        up = (F.size(kept) > 0) & (last != "..")
        climbed = F.when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", climbed).otherwise(F.concat(kept, F.array(part)))

    inner = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), inner)).when(inner == "", ".").otherwise(inner)


def path_parts(path: Column) -> Column:
    """(parent, name, stem, suffix) of a path; a name that only begins with a dot has no suffix, and a name without a parent has `.`."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    parent = F.when(parent != "", parent).when(F.startswith(path, F.lit("/")), "/").otherwise(".")
    ending = F.regexp_extract(name, r"^.+([.][^.]+)$", 1)
    return F.struct(parent.alias("parent"), name.alias("name"), F.substr(name, F.lit(1), F.length(name) - F.length(ending)).alias("stem"), ending.alias("suffix"))


def slug(text: Column) -> Column:
    """Runs of other characters than letters, digits, `_` and `-` as one `-`, none at either end."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")


def markdown_cell(text: Column) -> Column:
    """Text that is safe in a Markdown table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def compact(items: Column, most: int, sep: str = "; ") -> Column:
    """The first `most` items, joined, and how many more there are: `a; b; ...(+3)`."""
    n = F.size(items)
    return F.concat(F.array_join(F.slice(items, 1, most), sep), F.when(n > most, F.concat(F.lit(sep + "...(+"), (n - most).cast("string"), F.lit(")"))).otherwise(""))


def elided(items: Column, most: int = 5, sep: str = " -> ") -> Column:
    """All items if there are at most `most`; else the first two, `...` and the last two."""
    short = F.concat(F.slice(items, 1, 2), F.array(F.lit("...")), F.slice(items, -2, 2))
    return F.array_join(F.when(F.size(items) <= most, items).otherwise(short), sep)


def identifiers(text: Column, reserved: list[str]) -> Column:
    """Distinct identifiers, sorted, without string literals (in which a backslash keeps a quote), reserved words and words in capitals."""
    bare = F.regexp_replace(text, r""""(?:[^"\\\\]|\\\\.)*"|'(?:[^'\\\\]|\\\\.)*'""".replace("\\\\", "\\"), " ")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    kept = F.array_except(found, F.array(*map(F.lit, reserved)))
    return F.array_sort(F.filter(kept, lambda x: ~x.rlike("^[0-9_]*[A-Z][A-Z0-9_]*$")))


def unquoted(text: Column) -> Column:
    """Percent escapes back to text. A plus sign is no blank."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def template_sql(pattern: str, column: str) -> str:
    """SQL for a regex with {symbol} in it, replaced by a column's text as it is, whatever characters it has."""
    before, after = (part.replace("\\", "\\\\").replace("'", "\\'") for part in pattern.split("{symbol}"))
    return f"concat('{before}', regexp_replace({column}, '([^A-Za-z0-9_])', '\\\\\\\\$1'), '{after}')"


def relative_module(parts: Column, level: Column, name: Column) -> Column:
    """The name `level` parts up from a dotted name's parts."""
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), F.array(name)), ".")


def arguments(text: Column) -> Column:
    """Parts between commas outside quotes and brackets of any depth, trimmed; none of empty text.

    One fold over the characters keeps the depth, the open quote and whether a backslash went before; a closing bracket too
    many changes nothing. It notes where to cut, and parts are cut out at the end.
    """
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        inside = s["quote"] != ""
        quote = F.when(inside & (s["escaped"] | (c != s["quote"])), s["quote"]).when(~inside & c.isin("'", '"', "`"), c).otherwise("")
        depth = F.when(inside, s["depth"]).when(c.isin("(", "[", "{"), s["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = ~inside & (c == ",") & (s["depth"] == 0)
        at = s["at"] + 1
        return F.struct(at.alias("at"), depth.alias("depth"), quote.alias("quote"), (inside & ~s["escaped"] & (c == "\\")).alias("escaped"), F.when(cut, F.concat(s["cuts"], F.array(at))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(chars, start, step)["cuts"]
    whole = F.concat(cuts, F.array(F.char_length(text) + 1))
    part = lambda at, k: F.regexp_replace(F.substr(text, at + 1, F.get(whole, k + 1) - at - 1), r"^\s+|\s+$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(cuts, part))


#: A quoted string of any of the three quotes, in which a backslash keeps the next character.
QUOTED = r"""(['"`])(?:\\.|(?!\1).)*\1"""


def body_end(lines: Column) -> Column:
    """Number, from 1, of the line in which the braces that these lines open are closed again, quoted ones aside; the last one if they never are. Null for no lines."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(False).alias("begun"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, QUOTED, "")
        braces = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
        now, begun, at = s["open"] + braces("{") - braces("}"), s["begun"] | F.contains(bare, F.lit("{")), s["at"] + 1
        return F.struct(at.alias("at"), now.alias("open"), begun.alias("begun"), F.coalesce(s["end"], F.when(begun & (now <= 0), at)).alias("end"))

    return F.when(F.size(lines) > 0, F.aggregate(lines, start, step, lambda s: F.coalesce(s["end"], s["at"])))


def binomial(n: Column, k: Column) -> Column:
    """n over k as a double; 0 where k is larger."""
    steps = F.sequence(F.lit(1).cast("long"), k.cast("long"))
    return F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - i + 1) / i)


def missing(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold (null counts as not held), in the order given."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
