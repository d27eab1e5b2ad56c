"""Token totals kept by signed deltas: inserts, deletes and revised counts, in batches committed once each.

A store is a folder with one Parquet table of summed deltas per batch. A batch's table is written
aside and renamed to its name, which fails if that is taken: it appears whole or not at all, and of
two writers of one batch one wins. So a job that died half way is simply run again. Totals are the
sum over batches.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD

KEYS = ("source", "lang", "tokenizer_version")


def word_count(text: Column | str) -> Column:
    """Tokens of tokenizer version words-1: runs of anything but ASCII white space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_count(text: Column | str) -> Column:
    """Tokens of tokenizer version letters-1: runs of ASCII letters. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[A-Za-z]+")), F.lit(0)).cast("long")


def inserted(rows: DataFrame) -> DataFrame:
    """Changes that add rows(source, lang, tokenizer_version, tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    """Changes that take rows away again."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put new rows (another version, another count) in the place of old ones."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """A store of token totals by source, language and tokenizer version under one folder.

    Null sources and languages are keys of their own. Keys whose documents and tokens both come
    to nothing are left out of the totals; deletes of rows that were never inserted leave negative
    totals, which inserts that come later make good. A store or a batch without rows has no totals. Tokens that are null
    count as 0. Changes may have any other columns; they aren't read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        """A path of the shared file system, and that file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        at, fs = self._files(self.path)
        if not fs.exists(at):
            return []
        return sorted(x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("batch="))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes, once: False, and nothing done, if a batch of that name is committed."""
        goal, fs = self._files(f"{self.path}/batch={batch}")
        if fs.exists(goal):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        sums.where("docs <> 0 or tokens <> 0").write.parquet(aside)
        return self._name(aside, f"{self.path}/batch={batch}")

    def _name(self, aside: str, goal: str) -> bool:
        """Rename a folder, in one step, to a name that isn't taken. Otherwise it goes, and the answer is False."""
        jvm = self.spark._jvm
        (a, fs), (b, _) = self._files(aside), self._files(goal)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.spark._jsc.hadoopConfiguration()).rename(a, b, options)
        except Py4JJavaError:
            fs.delete(a, True)
            if not fs.exists(b):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, docs, tokens)."""
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long"
        paths = self._batches()
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
