import hashlib

import pytest

from premia.operators import reconcile as ops
from premia.sources import tables as io


def test_files_are_listed_and_every_planted_error_is_named(spark, tmp_path):
    for name, text in {"a/x.py": "print()", "paper/evidence/t.csv": "k\n1\n", "tests/t.py": "", "gone.md": "z"}.items():
        target = tmp_path / "root" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    actual = ops.file_manifest(ops.read_files(spark, str(tmp_path / "root")))
    rows = {r["path"]: r for r in actual.collect()}
    assert rows["a/x.py"]["sha256"] == hashlib.sha256(b"print()").hexdigest()
    assert rows["a/x.py"]["bytes"] == 7 and rows["a/x.py"]["role"] == "source"
    assert rows["paper/evidence/t.csv"]["producer"] == "analysis.pipeline"
    assert rows["tests/t.py"]["role"] == "test" and rows["gone.md"]["role"] == "documentation"
    assert ops.manifest_check(actual, actual).count() == 0
    good = [tuple(r) for r in actual.where("path <> 'gone.md'").collect()]
    bad = [(p, r, pr, b + (p == "a/x.py"), "0" if p.startswith("tests") else s) for p, r, pr, b, s in good]
    bad += [good[0], ("../up", "source", "x", 1, "x"), ("a//b", "source", "x", 1, "x"), ("none.md", "documentation", "x", 1, "x")]
    found = {tuple(r) for r in ops.manifest_check(spark.createDataFrame(bad, actual.schema), actual).collect()}
    dup = good[0][0]
    assert found == {
        ("a/x.py", "bytes_differs"), ("tests/t.py", "sha256_differs"), (dup, "duplicate_path"), ("../up", "unsafe_path"),
        ("a//b", "unsafe_path"), ("none.md", "missing_file"), ("gone.md", "unlisted_file"),
    }


def test_cells_differ_only_beyond_the_tolerance(table):
    a = table([("x", 1.0, None), ("y", 2.0, 3.0), ("z", 1.0, 1.0)], "k string, u double, v double")
    b = table([("x", 1.0 + 1e-13, None), ("y", 2.0, None), ("w", 1.0, 1.0)], "k string, u double, v double")
    got = {(r["k"], r["column_name"]) for r in ops.summary_differences(a, b, ["k"], ["u", "v"]).collect()}
    assert got == {("y", "v"), ("z", "u"), ("z", "v"), ("w", "u"), ("w", "v")}


def test_ledger_keys_never_change(table):
    ledger = table([(1, "old")], "k int, v string")
    batch = table([(1, "new"), (2, "new")], "k int, v string")
    assert [tuple(r) for r in ops.append_ledger(ledger, batch, ["k"]).collect()] == [(2, "new")]


def test_text_and_json_checks(table):
    docs = table([("a", '{"x": [{"bad": 1}, {"bad": 2}]}'), ("a", r'{"x": "\"bad\": 1"}'), ("b", '{"badly": 1}')], "k string, t string")
    got = {r["k"]: (r["documents_with_key"], r["occurrences"]) for r in ops.json_key_audit(docs, ["k"], "t", "bad").collect()}
    assert got == {"a": (1, 2), "b": (0, 0)}
    names = table([("t", " Bid "), ("t", "value")], "table_name string, column_name string")
    assert [r["column_name"] for r in ops.banned_columns(names).collect()] == ["bid"]


def test_csv_and_json_round_trip(spark, table, tmp_path):
    df = table([("b", 0.1 + 0.2), ("a", float("nan")), ("c", None)], "k string, x double")
    io.write_csv(df.where("k = 'b'"), str(tmp_path / "csv"), ["k"])
    assert io.read_csv(spark, str(tmp_path / "csv"), df.schema).first()["x"] == 0.1 + 0.2
    io.write_json(df, str(tmp_path / "json"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect())
    assert lines[0] == '{"k":"a","x":null}' and lines[2] == '{"k":"c","x":null}'
    assert io.header_gaps(df, ["k", "y"]) == ["y"]


def test_domain_closure(table):
    df = table([("g", "a"), ("g", "b"), ("h", "a"), ("h", "z")], "k string, v string")
    got = {r["k"]: r["closed"] for r in ops.domain_closure(df, ["k"], "v", ["a", "b"]).collect()}
    assert got == {"g": True, "h": False}


@pytest.mark.parametrize("path,bad", [("a/b.c", False), ("/a", True), ("a/../b", True), ("./a", True), ("a/", True), ("", True), ("a..b", False)])
def test_unsafe_paths(table, path, bad):
    from pyspark.sql import functions as F

    assert table([(path,)], "p string").select(ops.unsafe_path(F.col("p")).alias("u")).first()["u"] is bad
