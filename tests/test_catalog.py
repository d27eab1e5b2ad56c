"""Registered queries against their SQL, and operators on literal rows."""

import math

import duckdb
import pandas as pd
import pytest

from corpusloom.operators import graph, metrics, policy, scan, windows
from corpusloom.plans import catalog
from corpusloom.sources.readers import lines

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert rows(got) == rows(con.sql(catalog.ORACLES[name]).df())


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, "x\u2028y\x1cz")], "k int, text string")
    assert sorted(map(tuple, lines(df, "k").collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (3, 1, "x"), (3, 2, "y"), (3, 3, "z")]


def test_fingerprint_survives_moved_lines(spark):
    rule = [scan.Rule("c", "d", "secret", "high")]
    df = spark.createDataFrame([("f", "secret one\n# secret two"), ("f2", "")], "k string, text string")
    moved = spark.createDataFrame([("f", "\n\nsecret one")], "k string, text string")
    a, b = (scan.findings(scan.matches(x, "k", rule), "k").first() for x in (df, moved))
    assert a.match_count == 1 and a.fingerprint == b.fingerprint and a.finding_id != b.finding_id


def test_policy_expiry(spark):
    from pyspark.sql import functions as F

    found = spark.createDataFrame([(x,) for x in "abc"], "fingerprint string")
    quiet = spark.sql("select 'b' fingerprint, date '2024-01-01' expires union all select 'c', null")
    got = policy.evaluate(found, found.where("fingerprint = 'a'"), quiet, F.lit(True), F.lit("2024-02-01").cast("date"))
    assert {r.fingerprint: r.blocking for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_reach_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = graph.bounded_reach(edges, spark.createDataFrame([(1,)], "node int"), 6)
    assert sorted((r.node, r.depth) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(1, False, False)], "k int, e boolean, p boolean")
    from pyspark.sql import functions as F

    r = metrics.confusion(df, ["k"], F.col("e"), F.col("p")).first()
    assert r.tn == 1 and r.precision is None and r.f1 is None


def test_quota_gives_all_seats(spark):
    df = spark.createDataFrame([("a", 70), ("b", 20), ("c", 1)], "s string, n int")
    assert sum(r.quota for r in windows.largest_remainder(df, "n", 30, ["s"]).collect()) == 30


def test_versions_of_all_events_are_registered(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").where("ts is not null").select("user_id", "event_type").distinct().count()
    r = catalog.QUERIES["d15_relation_metrics_all"](spark, SF).first()
    assert r.tp + r.fp + r.fn == e
