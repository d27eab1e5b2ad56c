"""Joins and scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as fn
from corpusloom.operators import joins


def test_exact_or_latest(spark):
    left = spark.createDataFrame([(1, "f", "a", 5), (2, "f", "z", 5), (3, "f", "z", 0), (4, None, "a", 5)], "k int, file string, symbol string, line int")
    right = spark.createDataFrame([("f", "a", 9, 70), ("f", "a", 1, 71), ("f", "b", 5, 72)], "file string, symbol string, line int, id int")
    got = {r.k: (r.owner, r.how) for r in joins.exact_or_latest(left, right, "file", "symbol", "line", "id").collect()}
    assert got == {1: (70, "exact"), 2: (72, "latest"), 3: (None, None), 4: (None, None)}
    assert joins.exact_or_latest(left.limit(0), right, "file", "symbol", "line", "id").count() == 0


def test_band_counts(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "x", -3), (3, "y", 10), (4, "x", None)], "k int, g string, t int")
    b = spark.createDataFrame([("x", 8), ("x", 12), ("x", 13), ("x", -1), (None, 10)], "g string, t int")
    got = {r.k: (r.matches, r.verdict) for r in joins.band_counts(a, b, "g", "k", "t", 2).collect()}
    assert got == {1: (2, "ambiguous"), 2: (1, "unique"), 3: (0, "none"), 4: (0, "none")}


def test_key_coverage_with_nulls(spark):
    a, b = spark.createDataFrame([(1,), (None,), (2,), (2,)], "k int"), spark.createDataFrame([(None,), (3,)], "k int")
    assert tuple(joins.key_coverage(a, b, ["k"]).first()) == (1, 2, 1)


def test_numbered(spark):
    df = spark.createDataFrame([(v,) for v in [12, 3, None, 27, 25, 11]], "v int")
    got = {r.v: r.n for r in joins.numbered(df, F.floor(F.col("v") / 10), ["v"], "n").collect()}
    assert got == {None: 1, 3: 2, 11: 3, 12: 4, 25: 5, 27: 6}


def test_text_functions(spark):
    df = spark.range(1).select(
        fn.glob_match(F.lit("src/a/b_test.py"), ["*_test.py"]).alias("g"), fn.suffix(F.lit("a.b/C.PY")).alias("s"), fn.slug(F.lit("--a b//c!")).alias("slug"),
        fn.markdown_cell(F.lit("a|b\nc")).alias("cell"), fn.compact(F.array(*map(F.lit, "abc")), 2).alias("c"), fn.elided(F.array(*map(F.lit, "abcdef")), 4).alias("e"),
        fn.identifiers(F.lit("if foo(bar, 'x y', MAX) and foo"), ["if", "and"]).alias("i"), fn.missing({"p": F.lit(None).cast("boolean"), "q": F.lit(True), "r": F.lit(False)}).alias("m"),
    )
    assert tuple(df.first()) == (True, ".py", "a-b-c", "a\\|b c", "a; b; ...(+1)", "a -> b -> ... -> e -> f", ["bar", "foo"], ["p", "r"])


def test_text_functions_at_their_edges(spark):
    items = lambda s: F.array(*map(F.lit, s))
    r = spark.range(1).select(
        fn.elided(items("abcdef")).alias("long"), fn.elided(items("abcde")).alias("short"), fn.compact(items("abcde"), 2).alias("more"), fn.compact(items("ab"), 2).alias("all"),
        fn.identifiers(F.lit(r"""f('a \' b', "x \" y", __, A_1, _b)"""), []).alias("names"), fn.unquoted(F.lit("a+b%20c")).alias("unquoted"), fn.arguments(F.lit('a, "b,c", f(1,2), [3,4]')).alias("arguments"),
        fn.binomial(F.lit(10), F.lit(3)).alias("binomial"), fn.relative_module(items("abc"), F.lit(2), F.lit("x")).alias("module"),
        *(fn.glob_match(F.lit(p), [g]).alias(f"g{k}") for k, (p, g) in enumerate([("src/a1.py", "a[0-9].py"), ("src/ax.py", "a[0-9].py"), ("b.py", "[!a].py"), ("a[.py", "a[[].py"), ("a[.py", "a[.py")])),
    ).first()
    assert (r.long, r.short, r.more, r["all"]) == ("a -> b -> ... -> e -> f", "a -> b -> c -> d -> e", "a; b; ...(+3)", "a; b")
    assert r.names == ["__", "_b", "f"] and r.unquoted == "a+b c" and r.arguments == ["a", '"b,c"', "f(1,2)", "[3,4]"] and r.binomial == 120
    assert r.module == "a.x"
    assert [r.g0, r.g1, r.g2, r.g3, r.g4] == [True, False, True, True, True]


def test_scan_symbols_suffixes_and_tabs(spark):
    from corpusloom.operators import scan

    rules = [scan.Rule("c", "d", "secret", "high"), scan.Rule("c", "py", "secret", "medium", (".py",))]
    df = spark.createDataFrame([("f", ".py", "\t# secret\nsecret\n secret"), ("g", ".js", "secret")], "k string, suffix string, text string")
    hits = scan.matches(df, "k", rules, "suffix")
    assert sorted((r.k, r.line_no, r.detector) for r in hits.collect()) == [("f", 2, "d"), ("f", 2, "py"), ("f", 3, "d"), ("f", 3, "py"), ("g", 1, "d")]
    named = hits.withColumn("symbol", F.when(F.col("line_no") == 2, "main"))
    assert sorted((r.k, r.symbol, r.match_count) for r in scan.findings(named, "k", "symbol").collect()) == [("f", "<module>", 1), ("f", "main", 1), ("g", "<module>", 1)]
    assert scan.findings(hits, "k", by_line=True).count() == 3 and scan.findings(hits, "k").count() == 2


def test_mcnemar_p_and_quota_errors(spark):
    import math

    from corpusloom.operators import metrics, windows

    pairs = [(0, 0), (3, 0), (5, 9), (12, 12), (400, 800)]
    got = [r.p for r in spark.createDataFrame(pairs, "a long, b long").select(metrics.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()]
    for p, (a, b) in zip(got, pairs, strict=True):
        assert abs(p - min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))) < 1e-9
    strata = spark.createDataFrame([("a", 3), ("b", 1), ("c", 6)], "s string, n int")
    assert {r.s: r.quota for r in windows.largest_remainder(strata, "n", 10, ["s"]).collect()} == {"a": 3, "b": 1, "c": 6}
    for seats in (2, 11):
        with pytest.raises(Exception, match="seats"):
            windows.largest_remainder(strata, "n", seats, ["s"]).collect()


def test_cells_spread_a_common_key(spark, monkeypatch):
    """All pairs come once, and those of one key are dealt out over tasks."""
    monkeypatch.setattr(joins, "CELL", 16)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1024)
    a = spark.range(200).selectExpr("if(id < 150, 'x', 'k' || id % 40) k", "id i").union(spark.sql("select null, -1L"))
    b = spark.range(300).selectExpr("if(id < 220, 'x', 'k' || id % 50) k", "id j").union(spark.sql("select null, -1L"))
    got = joins.cell_join(a, b, ["k"])
    assert sorted(map(tuple, got.select("k", "i", "j").collect())) == sorted(map(tuple, a.join(b, ["k"]).select("k", "i", "j").collect()))
    sizes = [r["count"] for r in got.where("k = 'x'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and sum(sizes) == 33000 and max(sizes) < 33000 / 5
    assert joins.cell_join(a.limit(0), b, ["k"]).count() == 0
