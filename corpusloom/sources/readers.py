"""Readers and line splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import glob_match, suffix

#: What ends a line in text: CR LF as one, or any single one of these, most of which are rare.
_RARE_ENDS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
LINE_END = f"[\n{_RARE_ENDS}](?:(?<=\r)\n)?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, root: str, suffixes: list[str], prune: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """(path below root, size, status, text) of all files under root.

    status is the first that holds: `pruned` (a folder of that name above it), `suffix`, `excluded`
    (none of the include globs, if any, or one of the exclude globs), `large`, `binary` (NUL in the
    first 8192 bytes), else `kept`. Only kept files have a text; bad bytes become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = re.sub("^file:/+", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", top) + "/", "")
    files = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    cut = F.arrays_overlap(folders, F.array(*map(F.lit, prune)).cast("array<string>"))
    left_out = (~glob_match(F.col("path"), list(include)) if include else F.lit(False)) | glob_match(F.col("path"), list(exclude))
    status = F.when(cut, "pruned").when(~suffix(F.col("path")).isin(suffixes), "suffix").when(left_out, "excluded").when(F.col("size") > max_bytes, "large")
    status = status.when(F.expr("position(X'00' in substring(content, 1, 8192))") > 0, "binary").otherwise("kept")
    text = F.when(F.col("status") == "kept", F.make_valid_utf8(F.col("content").cast("string")))
    return files.withColumn("status", status).select("path", "size", "status", text.alias("text"))


def source_files(spark: SparkSession, root: str, suffixes: list[str], max_bytes: int = 1_000_000) -> DataFrame:
    """(path, size, text) of the text files under root that tree() keeps."""
    return tree(spark, root, suffixes, max_bytes=max_bytes).where("status = 'kept'").drop("status")


def line_arrays(files: DataFrame, text: str = "text") -> DataFrame:
    """files with `_lines` for their text: an array of its lines; a line end at the very end opens no further line. Texts are split once."""
    parts = F.col("_parts")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    split = F.when(F.col(text).rlike(f"[{_RARE_ENDS}]"), F.split(text, LINE_END)).otherwise(F.split(text, "\n"))
    return files.withColumn("_parts", split).drop(text).withColumn("_lines", whole).drop("_parts")


def lines(files: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, line_no from 1, line) of line_arrays(). Exploded with outer, as Spark else filters by the arrays' sizes first and splits each text several times for that."""
    each = line_arrays(files.select(key, *keep, text), text).select(key, *keep, F.posexplode_outer("_lines").alias("n", "line")).where("n is not null")
    return each.select(key, *keep, (F.col("n") + 1).alias("line_no"), "line")


def stripped(line: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^\s+", ""), r"\s+$", "")
