"""Spans, graphs, names, evidence, nested records, snapshots and file trees on literal rows."""

import hashlib
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import json as fj
from corpusloom.functions import text as fn
from corpusloom.operators import graph, intervals, metrics, ordering, resolution, scan, verification
from corpusloom.sources import readers
from corpusloom.sources.file_tree import scan_tree
from corpusloom.sources.snapshots import Conflict, Snapshots


def test_smallest_enclosing_against_all_pairs(spark):
    """Spans from one day to half of all time, many of the same ends, a hot key whose cells are salted, points outside all."""
    rng = random.Random(4)
    spans = [(rng.choice("aab"), low := rng.randint(-500, 500), low + rng.choice([0, 1, 3, 40, 41, 900]), k) for k in range(150)]
    spans += [("a", 5, 9, 900), ("a", 5, 9, 800), ("b", 7, 3, 901), (None, 0, 9, 902), ("a", None, 9, 903), ("a", -(1 << 40), 1 << 40, 904)]
    points = [(k, rng.choice("aab"), rng.randint(-600, 1500)) for k in range(400)] + [(1000, None, 5), (1001, "a", None), (1002, "z", 5), (1003, "a", 1 << 41)]
    got = intervals.smallest_enclosing(spark.createDataFrame(points, "p long, key string, at long"), spark.createDataFrame(spans, "key string, low long, high long, s long"), "key", "at", "low", "high", "p", "s", cell=20)
    want = {}
    for p, key, at in points:
        fits = [(h - lo, s) for k, lo, h, s in spans if k is not None and k == key and at is not None and lo is not None and lo <= at <= h]
        if fits:
            want[p] = min(fits)
    assert {r.p: (r.width, r.s) for r in got.collect()} == want and 1003 not in want
    assert intervals.smallest_enclosing(spark.createDataFrame([], "p long, key string, at long"), spark.createDataFrame([], "key string, low long, high long, s long"), "key", "at", "low", "high", "p", "s").count() == 0


def plain_ranks(edges):
    """Kahn by hand; what is left is put after all others."""
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {x for e in edges for x in e}
    need = {n: sum(b == n for _, b in edges) for n in nodes}
    rank, ready, done = dict.fromkeys(nodes, 0), [n for n in nodes if not need[n]], set()
    while ready:
        n = ready.pop()
        done.add(n)
        for a, b in edges:
            if a == n:
                rank[b] = max(rank[b], rank[n] + 1)
                need[b] -= 1
                if not need[b]:
                    ready.append(b)
    for n in sorted(nodes - done):
        rank[n] = max(rank.values()) + 1
    return {n: (rank[n], n not in done) for n in nodes}


@pytest.mark.parametrize("rest", [0, 3, graph.REST])
def test_peeled_ranks(spark, rest):
    """By rounds alone, by both, and in one task: a diamond with a long side, repeated edges, a cycle with a tail, a loop."""
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("c", "x"), ("y", "tail"), ("d", "tail"), ("l", "l"), (None, "a"), ("q", None)]
    got = graph.peeled_ranks(spark.createDataFrame(edges, "src string, dst string"), rest).collect()
    assert {r.node: (r["rank"], r.cyclic) for r in got} == plain_ranks(edges) and len(got) == len({r.node for r in got})


def test_peeled_ranks_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(0, 150), (300, 301), (301, 300), (301, 150)]
    got = {r.node: (r["rank"], r.cyclic) for r in graph.peeled_ranks(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[149] == (149, False) and got[150][1] and got == plain_ranks(edges)
    assert graph.peeled_ranks(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_incoming_paths(spark):
    """Places and keywords, a recursive function, two functions that call each other, an entry that is called itself, and the depth."""
    parameters = spark.createDataFrame([("sink", 0, "x"), ("sink", 1, "y"), ("mid", 0, "m"), ("rec", 0, "r"), ("ping", 0, "p"), ("pong", 0, "q"), ("tool", 0, "arg"), ("tool", 1, "more"), ("far", 0, "f")], "function string, pos int, name string")
    calls = [(1, "mid", "sink"), (2, "rec", "mid"), (3, "rec", "rec"), (4, "tool", "rec"), (5, "ping", "sink"), (6, "pong", "ping"), (7, "ping", "pong"), (8, "tool", "pong"), (9, "far", "tool"), (10, "tool", "sink")]
    given = [(1, 0, None, "m"), (1, 1, None, "local"), (2, None, "m", "r"), (3, 0, None, "r"), (4, 0, None, "arg"), (5, 0, None, "p"), (6, 0, None, "q"), (7, 0, None, "p"), (8, None, "q", "more"), (9, 0, None, "f"), (10, 1, None, "arg"), (10, None, "x", "more")]
    flows = graph.argument_flows(parameters, spark.createDataFrame([(s, a, b, 100 + s) for s, a, b in calls], "site long, caller string, callee string, line long"), spark.createDataFrame(given, "site long, pos int, keyword string, name string"))
    targets = spark.createDataFrame([("sink", "x"), ("sink", "y"), ("far", "f")], "function string, parameter string")
    entries = spark.createDataFrame([("tool",), ("tool",)], "function string")
    got = sorted((r.parameter, r.depth, r.entry_param, r.line, ">".join(r.path)) for r in graph.incoming_paths(flows, targets, entries).collect())
    assert got == [
        ("x", 1, "more", 110, "x>tool>more"), ("x", 3, "arg", 104, "x>mid>m>rec>r>tool>arg"), ("x", 3, "more", 108, "x>ping>p>pong>q>tool>more"), ("y", 1, "arg", 110, "y>tool>arg"),
    ]
    assert graph.incoming_paths(flows, targets, entries, depth=2).count() == 2
    with pytest.raises(ValueError, match="more than 1"):
        graph.incoming_paths(flows, targets, entries, most=1)


def test_percentiles_against_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 100])) for _ in range(500)] + [("hot", 7.0)] * 900 + [("none", None), ("one", 3.0)]
    wanted = {"q0": ("linear", 0.0), "q3": ("linear", 0.3), "q1": ("linear", 1.0), "r0": ("rank", 0.0), "r95": ("rank", 0.95), "r1": ("rank", 1.0)}
    for by in (["g"], []):
        got = {r.g if by else 0: r for r in ordering.percentiles(spark.createDataFrame(rows, "g string, v double"), by, "v", wanted).collect()}
        for g, r in got.items():
            v = sorted(x for k, x in rows if x is not None and (not by or k == g))
            line = lambda p, v=v: v[math.floor(p * (len(v) - 1))] + (v[math.ceil(p * (len(v) - 1))] - v[math.floor(p * (len(v) - 1))]) * (p * (len(v) - 1) % 1) if v else None
            rank = lambda p, v=v: v[max(0, math.ceil(round(p * len(v), 9)) - 1)] if v else 0.0
            for name, (how, p) in wanted.items():
                assert r[name] == pytest.approx(line(p) if how == "linear" else rank(p)), (g, name)
        assert len(got) == (6 if by else 1)


def test_bootstrap_of_kappa(spark):
    """Each replicate against one made by hand, and the interval about that of an ordinary bootstrap."""
    import numpy as np

    rng = random.Random(2)
    items = [[rng.choice("xyz" if k % 3 else "xx") for _ in range(4)] for k in range(60)]
    df = spark.createDataFrame([(k, r) for k, row in enumerate(items) for r in row], "item long, label string")

    def kappa(rows):
        n = len(rows)
        seen = sum(row.count(c) * (row.count(c) - 1) / 12 for row in rows for c in "xyz") / n
        by_chance = sum((sum(row.count(c) for row in rows) / (4 * n)) ** 2 for c in "xyz")
        return (seen - by_chance) / (1 - by_chance)

    got = metrics.bootstrap_kappa(df, "item", "label", 300, seed=5).first()
    keyed = sorted(items, key=lambda row: sorted((c, row.count(c)) for c in set(row)))
    reps = [kappa([keyed[i] for i in metrics.draws(np.int64(r), np.arange(60), 60, 5)]) for r in range(300)]
    assert got["items"] == 60 and got.kappa == pytest.approx(kappa(items)) and got.low == pytest.approx(np.quantile(reps, 0.025)) and got.high == pytest.approx(np.quantile(reps, 0.975))
    plain = [kappa(rng.choices(items, k=60)) for _ in range(2000)]
    assert abs(got.low - np.quantile(plain, 0.025)) < 0.05 and abs(got.high - np.quantile(plain, 0.975)) < 0.05
    assert tuple(metrics.bootstrap_kappa(df.limit(0), "item", "label", 9).first()) == (0, None, None, None)
    same = metrics.bootstrap_kappa(df.withColumn("label", F.lit("x")), "item", "label", 9).first()
    assert same.kappa is None and same.low is None
    with pytest.raises(ValueError, match="same number"):
        metrics.bootstrap_kappa(df.unionByName(df.limit(1)), "item", "label", 9)


def test_nested_json(spark):
    secret = 'a"b\\ é'
    tree = {"z": [{"k": secret, "n": 1.5}, [{"k": {"deep": [1, None]}}]], "k": None, "a": {"k": True, "kk": "stays", "m": {"k": [1, 2]}}, "b": 12345678901234567890}
    rows = [json.dumps(tree), json.dumps(secret), "no json", None, "[" * 100_000, '{"k": NaN}', '{ "k" : "x" , "k" : "y" }']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "i int, t string")
    out = {r.i: r for r in df.select("i", fj.redacted_json(F.col("t"), ["k"]).alias("r"), fj.redacted_json(F.col("t"), ["k"], True).alias("s"), fj.canonical_json(F.col("t")).alias("c")).collect()}
    blot = lambda v: {"redacted": True, "sha256": hashlib.sha256(v.encode()).hexdigest()}
    text = lambda v: {"redacted": True, "character_count": len(v), "sha256": hashlib.sha256(v.encode()).hexdigest()}
    shown = json.loads(out[0].r)
    assert shown == {"z": [{"k": text(secret), "n": 1.5}, [{"k": blot('{"deep":[1,null]}')}]], "k": None, "a": {"k": blot("true"), "kk": "stays", "m": {"k": blot("[1,2]")}}, "b": 12345678901234567890}
    assert json.loads(out[0].s)["a"]["k"] is True and json.loads(out[0].s)["z"][0]["k"] == text(secret)
    assert out[0].c == json.dumps(tree, sort_keys=True, ensure_ascii=False, separators=(",", ":")) and list(shown) == list(tree)
    assert out[1].r == json.dumps(secret, ensure_ascii=False) and json.loads(out[6].r) == {"k": text("y")}
    assert [out[k].r for k in (2, 3, 4, 5)] == [None] * 4 == [out[k].c for k in (2, 3, 4, 5)]


def test_best_line(spark):
    rows = ['{"call": {"line": 3}, "my_EXEC": {"line": "9"}, "exec_b": {"line": 7}, "exec_c": "text", "spawn": {"no": 1}}', '{"b": {"line": 2}, "a": {"line": 2}, "c": {"line": "x"}}', '{"a": 1}', "{}", None]
    got = [r.b for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(fj.best_line(F.col("t"), ["exec", "spawn"]).alias("b")).collect()]
    assert got[:2] == [(7, "exec_b"), (2, "a")] and got[2:] == [None, None, None]


def test_arguments_and_bodies(spark):
    cases = {"f(g(1,2),[3,(4)]),x": ["f(g(1,2),[3,(4)])", "x"], "": [], "  ": [""], "a,": ["a", ""], r"'it\'s, ok', `b,{`, c": [r"'it\'s, ok'", "`b,{`", "c"], "a), b(,c": ["a)", "b(,c"], '"open, a': ['"open, a'], "é,ü": ["é", "ü"]}
    got = {r.t: r.a for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", fn.arguments(F.col("t")).alias("a")).collect()}
    assert got == cases
    bodies = [(["f() {", "  s = '}';", "  if (x) { y }", "}", "z"], 4), (["a", "b"], 2), (["{", '"\\"}"', "}"], 3), (["}", "{", "}"], 2), ([], None)]
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(bodies)], "i int, b array<string>").orderBy("i")
    assert [r.e for r in rows.select(fn.body_end(F.col("b")).alias("e")).collect()] == [e for _, e in bodies]


def test_call_resolution(spark):
    definitions = spark.createDataFrame([("pkg.a", "f", 1), ("pkg.a", "f", 2), ("pkg.b", "g", 3), ("pkg.b", "f", 4), ("top", "h", 5), ("pkg.sub.c", "k", 6)], "module string, name string, key long")
    imports = spark.createDataFrame([("pkg.a", "f", "b", "f"), ("pkg.a", "gg", "b", "g"), ("pkg.b", "h", "top", "h"), ("pkg.a", "no", "gone", "x")], "module string, name string, from_module string, from_name string")
    aliases = spark.createDataFrame([("pkg.a", "bb", "pkg.b"), ("pkg.a", "pk", "pkg")], "module string, base string, to_module string")
    calls = [("own and imported", "pkg.a", None, "f"), ("renamed", "pkg.a", None, "gg"), ("whole name", "pkg.b", None, "h"), ("self", "pkg.b", "self", "g"), ("alias", "pkg.a", "bb", "g"), ("parts", "pkg.a", "pk.sub.c", "k"), ("unknown", "pkg.a", "zz", "g"), ("gone", "pkg.a", None, "no")]
    got = sorted(map(tuple, resolution.resolved_calls(spark.createDataFrame(calls, "site string, module string, base string, name string"), definitions, imports, aliases).collect()))
    assert got == sorted([("own and imported", 1, 0), ("own and imported", 2, 0), ("own and imported", 4, 1), ("renamed", 3, 1), ("whole name", 5, 1), ("self", 3, 0), ("alias", 3, 2), ("parts", 6, 2)])


def test_calls_of_a_common_name_move_no_pairs(spark):
    """600 calls by 600 definitions of one name: only calls and definitions are shuffled. A key under two names is met once, by its first way."""
    n = 600
    definitions = spark.range(n).selectExpr("'m' module", "'f' name", "id key").union(spark.sql("select 'm', 'g', 0L union all select 'm', 'f', null union all select 'm', 'f', null"))
    calls = spark.range(n).selectExpr("'s' || id site", "'m' module", "cast(null as string) base", "'f' name").union(spark.sql("select 's0', 'm', null, 'h'"))
    imports = spark.sql("select 'm' module, 'h' name, 'm' from_module, 'g' from_name union all select 'm', 'f', 'm', 'g'")
    aliases = spark.createDataFrame([], "module string, base string, to_module string")
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = resolution.resolved_calls(calls, definitions, imports, aliases).collect()
    assert written() - before < 1_000_000
    assert sorted(map(str, got)) == sorted(f"Row(site='s{i}', key={k}, how=0)" for i in range(n) for k in [*range(n), None])


def test_verified_findings(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = spark.createDataFrame([("r", "a.py", "one\n  two \nthree"), ("r", "b.py", "x"), ("other", "a.py", "one")], "repo string, file string, text string")
    manifest = spark.createDataFrame([("r", "v1"), ("other", "v1")], "repo string, version string")
    good = ("good", "r", "v1", "a.py", [1, 2], [sha("one"), sha("two")])
    bad = [
        ("tampered", "r", "v1", "a.py", [1, 3], [sha("one"), sha("THREE")]), ("gone", "r", "v1", "c.py", [1], [sha("x")]), ("long", "r", "v1", "b.py", [2], [sha("x")]), ("order", "r", "v1", "a.py", [2, 1], [sha("two"), sha("one")]),
        ("uneven", "r", "v1", "a.py", [1], []), ("old", "r", "v0", "b.py", [1], [sha("x")]), ("foreign", "z", "v1", "a.py", [1], [sha("one")]), ("twice", "r", "v1", "b.py", [1], [sha("x")]), ("twice", "r", "v1", "b.py", [1], [sha("x")]), ("empty", "r", "v1", "a.py", None, None),
    ]
    columns = "finding_id string, repo string, version string, file string, evidence_lines array<int>, evidence_hashes array<string>"
    got = sorted((r.finding_id, r.error, r.line_no) for r in verification.verified_findings(spark.createDataFrame([good, *bad], columns), manifest, files).collect())
    assert got == [("foreign", "file not found", 1), ("foreign", "outside manifest", None), ("gone", "file not found", 1), ("long", "line missing", 2), ("old", "other version", None), ("order", "lines not sorted", None), ("tampered", "hash differs", 3), ("twice", "repeated id", None), ("uneven", "lengths differ", None)]
    assert verification.verified_findings(spark.createDataFrame([good], columns), manifest, files).count() == 0


def test_symbols_of_hits(spark):
    """The nearest declaration above, at most 30 lines up and across blocks of lines; below for decorators."""
    body = ["def a():"] + ["x"] * 29 + ["secret", "secret"] + ["x"] * 20 + ["class B:", "  secret", "@secret", "# c", "def late():", "secret"] + ["x"] * 40 + ["@secret"] + ["x"] * 8 + ["def too_far():"]
    files = spark.createDataFrame([("f", "\n".join(body)), ("g", "secret")], "k string, text string")
    hits = scan.matches(files, "k", [scan.Rule("c", "d", "secret", "high")])
    got = {(r.k, r.line_no): r.symbol for r in scan.with_symbols(hits, files, "k", [r"^\s*def (\w+)", r"^\s*class (\w+)"]).collect()}
    at = {n: i + 1 for i, n in enumerate(body) if n not in ("x", "secret")}
    assert got[("f", 31)] == "a" and got[("f", 32)] is None and got[("f", at["class B:"] + 1)] == "B" and got[("f", at["def late():"] + 1)] == "late" and got[("g", 1)] is None
    assert got[("f", at["class B:"] + 2)] == "late" and got[("f", len(body) - 9)] is None and len(got) == 7


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, state string, n long")
    now = lambda: sorted((str(r.k), r.state, r.n) for r in table.read().collect())
    assert table.version() == 0 and table.read() is None
    assert table.upsert(rows(("a", "draft", 1), ("a", "completed", 2), ("b", "draft", 1), (None, "draft", 1)), ["k"], "n") == 1
    assert now() == [("None", "draft", 1), ("a", "completed", 2), ("b", "draft", 1)]
    # Two writers start from version 1: one loses, and nothing of it is seen.
    assert table.commit(rows(("x", "completed", 1)), 1) == 2
    with pytest.raises(Conflict):
        table.commit(rows(("y", "completed", 1)), 1)
    assert now() == [("x", "completed", 1)] and len(os.listdir(tmp_path / "t" / "data")) == 2
    # A writer that finds another one's version reads again: completed rows of both stay.
    other, first = Snapshots(spark, f"file://{tmp_path}/t"), table.version
    table.version = lambda: (other.upsert(rows(("z", "completed", 3)), ["k"], "n"), setattr(table, "version", first), 2)[2]
    assert table.upsert(rows((None, "draft", 5)), ["k"], "n") == 4
    assert now() == [("None", "draft", 5), ("x", "completed", 1), ("z", "completed", 3)] and table.read(1).count() == 3
    table.forget(1)
    assert table.version() == 4 and len(os.listdir(tmp_path / "t" / "data")) == 1 and len(now()) == 3


def test_scan_tree_opens_only_what_it_keeps(spark, tmp_path, monkeypatch):
    for name, data in {"a.py": b"x = '\xff'\n", "b.md": b"#", "lib/c.py": b"1", "lib/deep/h.py": b"h", "node_modules/d.py": b"1", "e.py": b"\0", "f.py": b"1" * 50, "g_test.py": b"1", "out/i.py": b"1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    for shut in ("f.py", "g_test.py", "b.md", "node_modules/d.py"):  # opening these would fail for anyone but root
        os.chmod(tmp_path / shut, 0)
    tree = scan_tree(spark, str(tmp_path), [".py"], prune=("node_modules",), exclude=("*_test.py", "out"), max_bytes=40)
    got = {r.path: r for r in tree.collect()}
    assert {p: r.status for p, r in got.items()} == {"a.py": "kept", "b.md": "suffix", "lib/c.py": "kept", "lib/deep/h.py": "kept", "node_modules": "pruned", "out": "pruned", "e.py": "binary", "f.py": "large", "g_test.py": "excluded", "link.py": "link", "loop": "link"}
    assert got["a.py"].text == "x = '�'\n" and got["e.py"].text is None and got["f.py"].size == 50
    assert {r.status: r["count"] for r in tree.groupBy("status").count().collect()} == {"kept": 3, "suffix": 1, "pruned": 2, "binary": 1, "large": 1, "excluded": 1, "link": 2}
    assert sorted(r.path for r in tree.where("status = 'kept' and path like 'lib/%'").collect()) == ["lib/c.py", "lib/deep/h.py"]
    assert [r.path for r in tree.where("path = 'lib/c.py'").collect()] == ["lib/c.py"]


def test_listing_opens_no_file(tmp_path, monkeypatch):
    """Planning lists and prunes without opening anything; a task opens the kept files of its own alone."""
    import builtins

    from pyspark.sql.datasource import EqualTo

    from corpusloom.sources import file_tree

    for name in ("a.py", "skip/b.py", "c.txt", "large.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (99 if "large" in name else 3))
    opened, plain = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda path, *a, **b: (opened.append(os.path.basename(str(path))), plain(path, *a, **b))[1])
    reader = file_tree._Reader({"path": str(tmp_path), "suffixes": ".py", "prune": "skip", "maxbytes": "50"})
    parts = reader.partitions()
    assert opened == [] and sorted(r[0] for p in parts for r in p.rows) == ["a.py", "c.txt", "large.py", "skip"]
    assert sorted((r[0], r[2]) for p in parts for r in reader.read(p)) == [("a.py", "kept"), ("c.txt", "suffix"), ("large.py", "large"), ("skip", "pruned")]
    assert opened == ["a.py"]
    only = file_tree._Reader({"path": str(tmp_path), "suffixes": ".py", "prune": "skip"})
    assert list(only.pushFilters([EqualTo(("status",), "suffix")])) == []
    assert [r[0] for p in only.partitions() for r in p.rows] == ["c.txt"]


def test_total_join(spark):
    from corpusloom.operators import joins

    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "k int, y int")
    assert sorted(map(tuple, joins.total_join(left, right, ["k"], "cases").collect())) == [(1, "a", 10), (2, "b", 20), (2, "c", 20)]
    for k, said in ((3, "several partners in cases for 3"), (9, "no partner in cases for 9"), (None, "no partner in cases for null")):
        with pytest.raises(Exception, match=said):
            joins.total_join(left.unionByName(spark.createDataFrame([(k, "z")], left.schema)), right, ["k"], "cases").collect()


def test_graph_report(spark):
    graphs = spark.createDataFrame([("good", "c1", True, False), ("bad", "c2", None, True), ("bad", "c3", True, False), ("same", "c1", True, None)], "graph_id string, candidate_id string, verified boolean, forbidden boolean")
    nodes = [("good", 1, "source"), ("good", 2, "sink"), ("bad", 1, "source"), ("bad", 1, "step"), ("same", 1, "sink"), ("same", 2, "source"), ("same", 3, None)]
    edges = [("good", 1, 2), ("bad", 1, 7), ("bad", 8, 9), ("bad", 1, 7), ("same", 1, 2)]
    view = [("good", 1), ("good", 2), ("bad", 1), ("bad", 5), ("same", 1), ("same", 2)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    errors, types = verification.graph_report(graphs, make(nodes, "graph_id string, node_id int, type string"), make(edges, "graph_id string, src int, dst int"), make(view, "graph_id string, node_id int"), ["source", "sink"])
    assert sorted(map(str, map(tuple, errors.collect()))) == sorted(map(str, [
        ("bad", "duplicate_graph_id", None, 1), ("good", "duplicate_candidate_id", None, 1), ("same", "duplicate_candidate_id", None, 1), ("bad", "evidence_hash_not_verified", None, 1), ("bad", "forbidden_input_or_execution", None, 1),
        ("bad", "duplicate_node_id", None, 1), ("bad", "missing_required_node_types", "sink", 1), ("bad", "dangling_edge", None, 3), ("bad", "incomplete_view", None, 1), ("same", "incomplete_view", None, 1),
    ]))
    assert {r.type: r.graphs for r in types.collect()} == {"source": 3, "sink": 2, "step": 1}


def test_sample_report(spark):
    population = spark.createDataFrame([(k, "a" if k < 6 else "b" if k < 9 else None) for k in range(10)], "k long, s string")
    good = [(0, "a", 3.0), (1, "a", 3.0), (6, "b", 1.5), (7, "b", 1.5), (9, None, 1.0)]
    report = lambda rows: {r.rule: r.violations for r in verification.sample_report(spark.createDataFrame(rows, "k long, s string, weight double"), population, ["s"], "k", 2).collect()}
    assert set(report(good).values()) == {0}
    assert report([*good, good[0]])["repeated"] == 1 and report([*good, (77, "a", 2.0)]) == {"repeated": 0, "outside": 1, "quota": 1, "uncovered": 0, "weight": 2}
    assert report(good[:4]) == {"repeated": 0, "outside": 0, "quota": 0, "uncovered": 1, "weight": 0} and report([(0, "a", None), *good[1:]])["weight"] == 1


def test_mcnemar_of_large_counts(spark):
    """Against sums of all terms where those can be made, and the normal tail beyond; no array grows with the counts."""
    pairs = [(50_000, 50_000), (49_000, 51_000), (5_000_000, 5_010_000), (10**9, 10**9 + 60_000), (1, 10**7)]
    got = [r.p for r in spark.createDataFrame(pairs, "a long, b long").select(metrics.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()]
    for p, (a, b) in zip(got, pairs, strict=True):
        z = (abs(a - b) - 1) / math.sqrt(a + b)
        assert p == pytest.approx(min(1, math.erfc(z / math.sqrt(2))), rel=2e-2, abs=1e-12), (a, b)


def test_dispositions_and_queue(spark):
    from corpusloom.operators import disposition

    columns = "gt_id string, repository string, category string, proofs array<string>, statuses array<string>, auth_supplied boolean, behavior boolean, vulnerability boolean, denied boolean, basis string"
    strong = ["boundary_or_reachability", "runtime_marker", "source_trace"]
    rows = [
        ("a", "z", "command_execution", strong, ["Unauthenticated", "documented_default"], None, True, None, None, None), ("b", "m", "command_execution", ["source_trace"], None, True, True, False, False, None),
        ("c", None, "filesystem_write", strong, [], False, True, False, False, None), ("d", "m", "unknown", None, ["x"], None, True, False, False, None), ("e", "m", "network_access", strong, [], None, True, True, False, None),
        ("f", "m", "network_access", strong, [], None, True, False, True, "guarded"), ("g", "m", "network_access", [], [], None, False, False, False, None), ("h", "m", None, [], [], None, False, False, True, None), ("i", "a", "command_execution", ["source_trace"], None, True, True, False, False, None),
    ]
    df = spark.createDataFrame(rows, columns)
    queue = disposition.upgrade_queue(df)
    got = [(r.upgrade_id, r.gt_id, r.score, r.tier) for r in queue.orderBy("upgrade_id").collect()]
    assert got == [
        ("VGU-001", "c", 12, "priority_boundary_impact_followup"), ("VGU-002", "a", 12, "priority_boundary_impact_followup"), ("VGU-003", "i", 7, "impactful_behavior_needs_boundary_validation"),
        ("VGU-004", "b", 7, "impactful_behavior_needs_boundary_validation"), ("VGU-005", "d", 0, "behavior_gt_needs_additional_validation"),
    ]
    lacks = {r.gt_id: r.missing for r in queue.collect()}
    assert lacks["a"] == ["document_non_destructive_impact_marker_and_privilege_context", "prepare_private_maintainer_report_before_public_claim"]
    assert lacks["c"] == ["document_concrete_confidentiality_integrity_availability_impact", "check_default_or_documented_deployment_exposure", "prepare_private_maintainer_report_before_public_claim"]
    assert lacks["d"][0].startswith("confirm_untrusted") and len(lacks["d"]) == 6
    assert [r.gt_id for r in disposition.upgrade_queue(df, 2).orderBy("upgrade_id").collect()] == ["c", "a"]
    where = {r.gt_id: (r.disposition, r.basis) for r in disposition.dispositions(df, queue).collect()}
    assert where["e"] == ("vulnerability_gt", "confirmed_boundary_and_impact_reproduction") and where["a"] == ("pending_upgrade_or_disclosure", "priority_boundary_impact_followup")
    assert where["f"] == ("guarded_not_vulnerability", "guarded") and where["h"] == ("guarded_not_vulnerability", "explicit_not_a_vulnerability_claim") and where["g"] == ("pending_upgrade_or_disclosure", "behavior_confirmed_but_disposition_not_explicit")


def test_paths(spark):
    import posixpath
    from pathlib import PurePosixPath

    paths = ["a/b/../c.ts", "./a//b/.", "../../x", "a/../..", "/../a", "/", "", ".", "a/..", "/a/b/", "x/.hidden", "n.tar.gz", "dir.d/name", "a/../../b/../c"]
    for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", fn.normal_path(F.col("p")).alias("n"), fn.path_parts(fn.normal_path(F.col("p"))).alias("x")).collect():
        assert r.n == posixpath.normpath(r.p), r.p
        if r.n not in (".", "/") and not r.n.endswith(".."):
            pure = PurePosixPath(r.n)
            assert tuple(r.x) == (str(pure.parent), pure.name, pure.stem, pure.suffix), r.p


def test_probe_programs(spark):
    """Python programs compile and do what their outcome says; a suite's are all different; other languages are refused."""
    import ast

    from corpusloom.operators import probes

    for suite, (languages, *_) in probes.SUITES.items():
        for language in languages:
            made = probes.probes(suite, language)
            assert len({p.text for p in made}) == len({p.number for p in made}) == len({p.symbol for p in made}) == len(made)
            for p in made if language == "python" else []:
                names = {x.name: x for x in ast.walk(ast.parse(p.text)) if isinstance(x, ast.FunctionDef)}
                assert list(names) == [p.symbol] and bool(names[p.symbol].decorator_list) == (p.source_type == "agent_tool_parameter")
                assert ("assert value" in p.text) == (p.guard_kind == "preceding_assert") and p.dependency == (not p.polarity == "negative_constant")
    four = probes.probes(4, "python")
    assert 2 * sum(p.dependency for p in four) == len(four)
    assert probes.probes(1, "python")[0].text == "import os\nimport subprocess\n\nimport requests\n\n@mcp.tool()\ndef probe_tool_direct_open_command(given):\n    value = given\n    return subprocess.run(value, shell=True)\n"
    repos = spark.createDataFrame([("A-1", "python"), ("b", "typescript"), (None, "python")], "sample_id string, language string")
    got = probes.planted(repos, 1).collect()
    assert len(got) == 2 * len(probes.probes(1, "python")) + len(probes.probes(1, "typescript"))
    assert {(r.probe_id, r.file) for r in got if r.sample_id == "A-1"} >= {("MUT-A-1-PY1-01", "probes/a-1_tool_direct_open_command.py")}
    assert probes.planted(repos.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="no programs in typescript"):
        probes.planted(repos, 2).collect()
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, n int")
    f = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert sorted((r.k, r.matches, r.claims) for r in probes.matched(x, f, ["k"]).collect()) == [("a", 1, 2), ("a", 1, 2), ("b", 2, 1), ("c", 0, 1)]


def test_pruned_json(spark):
    cases = [('{"title":1,"p":{"title":{"x":1},"q":[{"title":2,"r":[[{"title":3}]]}]}}', '{"p":{"q":[{"r":[[{}]]}]}}'), ('["title"]', '["title"]'), ("{", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "j string").select("j", fj.pruned_json(F.col("j"), ["title"]).alias("p")).collect()
    assert {r.j: r.p for r in got} == dict(cases)


def test_hits_within_a_file_equal_those_by_windows(spark):
    """All line ends, comments, long lines, decorators, declarations near and out of reach, rules by suffix."""
    rng = random.Random(7)
    parts = ["secret one", "token SECRET two", "# secret", "   // secret", "@wrap secret", "@wrap", "def f{}(a):", "  class C{}:", "def (secret)", "x" * 1995 + "secret", "", " ", "other", "token", *["pass"] * 20]
    ends = ["\n"] * 6 + ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n\n", "\n\r"]
    texts = ["".join(rng.choice(parts).format(k) + rng.choice(ends if i % 2 else ["\n"]) for k in range(rng.randint(0, 90))) + rng.choice(["", "secret"]) for i in range(120)] + [None]
    files = spark.createDataFrame([(i, rng.choice([".py", ".ts", None]), t) for i, t in enumerate(texts)], "k int, suffix string, text string")
    rules = [scan.Rule("c", "d", "secret", "high"), scan.Rule("c", "e", "token.*secret", "medium", (".py",)), scan.Rule("g", "h", "^@|token", "medium", (".py", ".ts"))]
    declared = [r"^\s*def (\w*)", r"^\s*class (\w+)"]
    want = scan.with_symbols(scan.matches(files, "k", rules, "suffix"), files, "k", declared)
    got = scan.file_hits(files, rules, declared, "suffix").select("k", F.inline("hits"))
    columns = ["k", "line_no", "line", "category", "detector", "confidence", "symbol"]
    rows = sorted(str(tuple(r)) for r in got.select(columns).collect())
    assert rows == sorted(str(tuple(r)) for r in want.select(columns).collect()) and len(rows) > 500
    by_hand = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    for r in readers.line_arrays(files.where("text is not null")).collect():
        lines = by_hand.split(texts[r.k])
        assert r._lines == (lines[:-1] if lines[-1] == "" else lines)


def test_probes_found_of_repeated_and_nameless_repositories(spark, tmp_path):
    """As the SQL has it, with only repositories shuffled."""
    import duckdb

    from corpusloom.plans import probing, registry

    customers = spark.range(600).selectExpr("id c_custkey", "cast(id % 25 as int) c_nationkey").union(spark.sql("select 3L, 3 union all select 4L, 4 union all select 5L, 6 union all select null, 1 union all select null, 3 union all select 7000L, null"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = sorted(tuple(r) for r in probing.a18_probes_found(spark, str(tmp_path)).collect())
    assert written() - before < 200_000
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLES["a18_probes_found"]).fetchall())
    assert {r[5] for r in got} == {1} and sum(r[6] for r in got) > 0
