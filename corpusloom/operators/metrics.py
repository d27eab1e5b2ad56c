"""Agreement and evaluation metrics as plain aggregations. Undefined metrics are null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored


def confusion(df: DataFrame, by: list[str], expected: Column, predicted: Column, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn (weighted sums, if weights are given), precision, recall and F1."""
    w = F.lit(1.0) if weight is None else weight
    part = lambda e, p: F.sum(F.when((expected == e) & (predicted == p), w).otherwise(0.0))
    c = df.groupBy(*by).agg(part(True, True).alias("tp"), part(False, True).alias("fp"), part(True, False).alias("fn"), part(False, False).alias("tn"))
    ratio = lambda a, b: F.expr(f"try_divide({a}, {b})")
    return c.withColumn("precision", ratio("tp", "tp + fp")).withColumn("recall", ratio("tp", "tp + fn")).withColumn("f1", ratio("2 * tp", "2 * tp + fp + fn"))


def fleiss(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """observed, expected, kappa of ratings(item, label) with the same number of raters for each item."""
    n = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    per = n.groupBy(item).agg(F.sum("n").alias("raters"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    observed = per.agg(F.avg(F.expr("pairs / (raters * (raters - 1))")).alias("observed"))
    total = n.groupBy(label).agg(F.sum("n").alias("n"))
    expected = total.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("expected"))
    return observed.join(F.broadcast(expected)).withColumn("kappa", F.expr("try_divide(observed - expected, 1 - expected)"))  # a row each


def cohen(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """observed, expected, kappa of two raters."""
    joint = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    observed = joint.agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("observed"), F.sum("n").alias("total"))
    left = joint.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("x"))
    right = joint.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("y"))
    both = left.join(right, "label").agg(F.sum(F.col("x") * F.col("y")).alias("both"))
    return observed.join(F.broadcast(both)).select("observed", (F.col("both") / (F.col("total") * F.col("total"))).alias("expected")).withColumn("kappa", F.expr("try_divide(observed - expected, 1 - expected)"))


#: A prime; draws are whole numbers below it.
PRIME = 2_147_483_647
#: Replicates drawn at once in a task, and patterns of votes beyond which bootstrap_kappa() refuses.
AT_ONCE, PATTERNS = 500, 20_000


def bootstrap_kappa(ratings: DataFrame, item: str, label: str, replicates: int = 5000, seed: int = 1) -> DataFrame:
    """One row: items, kappa (Fleiss) and the 95 % percentile interval (low, high) of `replicates` resamples of the items.

    Each resample draws as many items as there are, with putting back. Items matter only by how many raters gave which label,
    and such patterns are few whatever the number of items (at most the ways to deal raters over labels), so a draw is a
    pattern, found by where a hashed number falls among the patterns' cumulative counts. Tasks deal with ranges of draws and
    send one row of sums a replicate: neither items nor rows are multiplied, and reruns agree. Replicates whose expected
    agreement is 1 have no kappa. All items need the same number of raters, two or more, else an error. No ratings: nulls.
    """
    spark = ratings.sparkSession
    votes = ratings.groupBy(item, label).agg(F.count("*").alias("_n")).groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("label"), F.col("_n").alias("n")))).alias("votes"))
    counted = stored(votes.groupBy("votes").agg(F.count("*").alias("items")), "patterns")
    if counted.count() > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of votes")
    patterns = sorted(((tuple((v["label"], v["n"]) for v in r.votes), r.items) for r in counted.collect()), key=lambda x: tuple((a is not None, a or "", n) for a, n in x[0]))
    raters = {sum(n for _, n in p) for p, _ in patterns}
    if len(raters) > 1 or raters & {0, 1}:
        raise ValueError("all items need the same number of raters, two or more")
    columns = "items long, kappa double, low double, high double"
    if not patterns:
        return spark.createDataFrame([(0, None, None, None)], columns)
    r, labels = raters.pop(), sorted({a for p, _ in patterns for a, _ in p}, key=lambda a: (a is not None, a or ""))
    bounds = np.cumsum([n for _, n in patterns])
    total = int(bounds[-1])
    agree = np.array([sum(n * (n - 1) for _, n in p) for p, _ in patterns], np.int64)
    given = np.array([[dict(p).get(a, 0) for a in labels] for p, _ in patterns], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((replicates, 1 + len(labels)), np.int64)
        for batch in batches:
            j = batch.column("id").to_numpy()
            for piece in np.array_split(j, max(1, len(j) // 2000)):
                for at in range(0, replicates, AT_ONCE):
                    reps = np.arange(at, min(at + AT_ONCE, replicates))
                    drawn = np.searchsorted(bounds, draws(reps[:, None], piece[None, :], total, seed), "right")
                    hist = np.bincount((np.arange(len(reps))[:, None] * len(bounds) + drawn).ravel(), minlength=len(reps) * len(bounds)).reshape(len(reps), -1)
                    sums[reps, 0] += hist @ agree
                    sums[reps, 1:] += hist @ given
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(sums[:, 0]), pa.array(list(sums[:, 1:]), pa.list_(pa.int64()))], ["rep", "agree", "given"])

    parts = spark.range(total).mapInArrow(work, "rep long, agree long, given array<long>")
    reps = parts.groupBy("rep").agg(F.sum("agree").alias("agree"), *(F.sum(F.get("given", F.lit(k))).alias(f"g{k}") for k in range(len(labels))))
    own = spark.createDataFrame([(-1, int(sum(agree * [n for _, n in patterns])), *(int(x) for x in np.array([n for _, n in patterns]) @ given))], reps.schema)
    observed = F.col("agree") / F.lit(float(total) * r * (r - 1))
    expected = sum((F.pow(F.col(f"g{k}") / F.lit(float(total) * r), F.lit(2.0)) for k in range(len(labels))), F.lit(0.0))
    kappas = reps.unionByName(own).select("rep", F.when(F.abs(expected - 1) > 1e-9, (observed - expected) / (1 - expected)).alias("k"))
    drawn = F.when(F.col("rep") >= 0, F.col("k"))
    return kappas.agg(F.lit(total).cast("long").alias("items"), F.max(F.when(F.col("rep") < 0, F.col("k"))).alias("kappa"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))


def draws(rep: np.ndarray, j: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Numbers from 0 to n - 1 that rep, j and seed decide: two squarings modulo a prime."""
    a = (j % PRIME * 16_807 + rep * 48_271 + seed) % PRIME
    a = (a * a + 7 * a + 3) % PRIME
    a = (a * a + 11 * a + 5) % PRIME
    return a * n // PRIME


def _log_factorial(x: Column) -> Column:
    d = x.cast("double")
    series = (d + 0.5) * F.log(d) - d + 0.5 * math.log(2 * math.pi) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * d * d * d * d * d)
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(17)))
    return F.when(x <= 16, F.get(table, x.cast("int"))).otherwise(series)


def mcnemar_p(only_first: Column, only_second: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the binomial tail at one half, 1 at most.

    The tail is summed from its largest term down, each as a ratio of the one before. Terms more than 40 standard deviations
    below can't change a double, so the steps grow with the root of the counts; large counts don't overflow.
    """
    n, k = (only_first + only_second).cast("long"), F.least(only_first, only_second).cast("long")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0)
    far = F.least(k, F.ceil(20 * F.sqrt(n.cast("double"))) + 50)
    steps = F.when(far > 0, F.sequence(F.lit(0).cast("long"), far - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * ((k - i) / (n - k + i + 1))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.least(F.lit(1.0), 2 * F.exp(top) * F.aggregate(steps, start, step, lambda s: s["sum"]))


def plurality(votes: DataFrame, item: str, label: str) -> DataFrame:
    """(item, winner, votes, tied): the most frequent label; ties by label, and marked."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    top = n.groupBy(item).agg(F.max("n").alias("votes"))
    first = n.join(top, item).where("n = votes")
    return first.groupBy(item).agg(F.min(label).alias("winner"), F.first("votes").alias("votes"), (F.count("*") > 1).alias("tied"))
