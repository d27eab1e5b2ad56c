"""Readers and sinks on literal files."""

import json

import pytest

from corpusloom.sources import records
from corpusloom.sources.readers import tree


def test_tree_tells_why_a_file_is_left_out(spark, tmp_path):
    for name, data in {"a.py": b"x = '\xff'\n", "b.md": b"#", "lib/c.py": b"1", "node_modules/d.py": b"1", "e.py": b"\0", "f.py": b"1" * 50, "g_test.py": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in tree(spark, str(tmp_path), [".py"], prune=("node_modules",), exclude=("*_test.py",), max_bytes=40).collect()}
    assert {p: r.status for p, r in got.items()} == {"a.py": "kept", "b.md": "suffix", "lib/c.py": "kept", "node_modules/d.py": "pruned", "e.py": "binary", "f.py": "large", "g_test.py": "excluded"}
    assert got["a.py"].text == "x = '�'\n" and got["e.py"].text is None
    only = tree(spark, str(tmp_path), [".py"], include=("lib/*",)).where("status = 'kept'").collect()
    assert [r.path for r in only] == ["lib/c.py"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"k": "a", "n": 1}\n\n{"k": "b", "n": null}\n')
    df = records.read_jsonl(spark, str(tmp_path / "in.jsonl"), "k string, n int", need=("k",), unique="k")
    assert df.count() == 2
    with pytest.raises(ValueError, match="without a value"):
        records.required(df, need=("n",))
    with pytest.raises(ValueError, match="occurs 2 times"):
        records.required(df.unionByName(df), unique="k")
    out = f"file://{tmp_path}/out"
    records.write_jsonl(df.select("n", "k").coalesce(1), out)
    assert sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()) == ['{"k":"a","n":1}', '{"k":"b","n":null}']
    with pytest.raises(FileExistsError):
        records.write_jsonl(df, out)
    records.write_jsonl(df, out, append=True)
    assert spark.read.json(out).count() == 4


def test_csv_and_records_by_file(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿id,note\n1,"a ""b"", c"\n2,"two\nlines"\n'.encode())
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()] == [("1", 'a "b", c'), ("2", "two\nlines")]
    for name in ("one", "two"):
        (tmp_path / f"{name}.latest.json").write_text(json.dumps({"n": len(name), "other": [1]}, indent=1))
    (tmp_path / "one.json").write_text('{"n": 9}')
    got = records.read_records(spark, str(tmp_path), "n int", "case_id", r"([^/]+)[.]latest[.]json$", "*.latest.json")
    assert sorted((r.case_id, r.n) for r in got.collect()) == [("one", 3), ("two", 3)]


def test_baseline(spark, tmp_path):
    found = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "fingerprint string")
    path = f"file://{tmp_path}/base"
    records.write_baseline(found, path, "kind", a_file=1)
    assert sorted(r.fingerprint for r in records.read_baseline(spark, path, "kind").collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="no baseline"):
        records.read_baseline(spark, path, "kind", 2)
    (tmp_path / "twice.json").write_text('{"kind": "kind", "version": 1,\n "fingerprints": ["a", "a"]}')
    with pytest.raises(ValueError, match="occurs 2 times"):
        records.read_baseline(spark, str(tmp_path / "twice.json"), "kind", multi_line=True)


def test_sarif(spark, tmp_path):
    at = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    flow = [{"threadFlows": [{"locations": [{"location": at("a%20b+c.py", 3)}, {"location": at("./x.py", 1)}]}]}]
    run = {"tool": {"driver": {"rules": [{"id": "r1", "name": "One", "defaultConfiguration": {"level": "error"}}]}}, "results": [
        {"ruleId": "r1", "message": {"text": "m"}, "locations": [at("x.py", 1)], "codeFlows": flow}, {"ruleId": "r2", "message": {"text": "n"}}]}
    (tmp_path / "s-1.sarif").write_text(json.dumps({"version": "2.1.0", "runs": [run]}, indent=2))
    (tmp_path / "bad.sarif").write_text("no json")
    results = records.sarif_results(records.read_sarif(spark, str(tmp_path)), "sample_id")
    assert sorted((r.sample_id, r.rule, r.rule_name, r.level) for r in results.collect()) == [("s-1", "r1", "One", "error"), ("s-1", "r2", None, "warning")]
    assert sorted((r.path, r.line_start, r.line_end) for r in records.sarif_locations(results, "sample_id").collect()) == [("a b+c.py", 3, 3), ("x.py", 1, 1)]


def test_report_paths_leave_the_mount(spark):
    one = lambda path: {"check_id": "c", "path": path, "start": {"line": 1}, "end": {"line": 2}, "extra": {"severity": "WARNING", "message": "m"}}
    df = spark.createDataFrame([("k", json.dumps({"results": [one("/src/a.py"), one("b/src/c.py")]})), ("none", None)], "k string, report string")
    assert sorted(r.path for r in records.report_results(df, "k").collect()) == ["a.py", "b/src/c.py"]
