"""Policy: new against a baseline, suppressions with an end date, and what blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(found: DataFrame, baseline: DataFrame, suppressions: DataFrame, blocks: Column, today: Column) -> DataFrame:
    """found(fingerprint, ...) with is_new, suppressed and blocking.

    baseline(fingerprint); suppressions(fingerprint, expires), the date null if there is no end.
    """
    old = baseline.select("fingerprint").distinct().withColumn("_old", F.lit(True))
    quiet = suppressions.where(F.col("expires").isNull() | (F.col("expires") >= today)).select("fingerprint").distinct().withColumn("_quiet", F.lit(True))
    x = found.join(old, "fingerprint", "left").join(quiet, "fingerprint", "left")
    x = x.withColumn("is_new", F.col("_old").isNull()).withColumn("suppressed", F.col("_quiet").isNotNull())
    return x.withColumn("blocking", F.col("is_new") & ~F.col("suppressed") & blocks).drop("_old", "_quiet")


def records(found: DataFrame, baseline: DataFrame, suppressions: DataFrame, meets: Column, today: Column) -> DataFrame:
    """found(fingerprint, ...) with baseline_status, suppression_id, policy_match and blocking.

    suppressions(suppression_id, fingerprint, expires): of those in force the smallest id counts.
    meets: what the policy names. A finding blocks if it is new, not suppressed, and meets that.
    """
    old = baseline.select("fingerprint").distinct().withColumn("_old", F.lit(True))
    valid = suppressions.where(F.col("expires").isNull() | (F.col("expires") >= today)).groupBy("fingerprint").agg(F.min("suppression_id").alias("suppression_id"))
    x = found.join(old, "fingerprint", "left").join(valid, "fingerprint", "left")
    x = x.withColumn("baseline_status", F.when(F.col("_old"), "existing").otherwise("new")).withColumn("policy_match", F.coalesce(meets, F.lit(False)))
    return x.withColumn("blocking", F.col("_old").isNull() & F.col("suppression_id").isNull() & F.col("policy_match")).drop("_old")


def expired(suppressions: DataFrame, today: Column) -> DataFrame:
    """Suppressions whose last day lies before today."""
    return suppressions.where(F.col("expires") < today)
