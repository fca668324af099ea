import datetime as dt
import json

from pyspark.sql import functions as F

from axisframe.operators import schema_drift as sd
from axisframe.operators.components import components

T0 = dt.datetime(2026, 1, 1)
FILES = "file_id string, series_id string, file_seq int, written_at timestamp, n_rows int, column_order array<string>"
RECORDS = "file_id string, row_no int, obs_name string, payload string, loaded_at timestamp"


def drift(spark, files, rows):
    f = spark.createDataFrame([(i, s, q, T0, 0, c) for i, s, q, c in files], FILES)
    r = spark.createDataFrame([(i, n, o, p if isinstance(p, (str, type(None))) else json.dumps(p), T0) for i, n, o, p in rows], RECORDS)
    return f, r


def report(f, r):
    return sorted(tuple(x) for x in sd.drift_report(f, r).select("file_id", "change_kind", "old_name", "new_name").collect())


def test_each_kind_of_change(spark):
    files = [("f1", "s", 1, ["a", "old", "t", "gone"]), ("f3", "s", 3, ["t", "new", "a", "more"]), ("g", "other", 1, ["z"])]
    rows = [
        ("f1", 0, "x", {"a": 1, "old": "p", "t": 1, "gone": 5}), ("f1", 1, "y", {"a": 2, "old": None, "t": 2, "gone": 6}),
        ("f3", 0, "x", {"a": 1, "new": "p", "t": 1.0, "more": 7}), ("f3", 1, "y", {"a": "stray", "new": "q", "t": 2.5}), ("f3", 2, "z", {"a": 4}),
    ]
    f, r = drift(spark, files, rows)
    want = [("f3", "added", "", "more"), ("f3", "removed", "gone", ""), ("f3", "renamed", "old", "new"), ("f3", "retyped", "t", "t")]
    assert report(f, r) == want
    assert report(f.unionByName(f), r.unionByName(r)) == want


def test_renames_ask_for_equal_types_and_a_common_row(spark):
    files = [("f1", "s", 1, ["a", "b"]), ("f2", "s", 2, ["c", "d"])]
    f, r = drift(spark, files, [("f1", 0, "x", {"a": 1, "b": 2.50}), ("f2", 0, "x", {"c": 1.0, "d": 2.5}), ("f2", 1, "y", {"d": 9})])
    assert report(f, r) == [("f2", "added", "", "c"), ("f2", "removed", "a", ""), ("f2", "renamed", "b", "d")]
    f, r = drift(spark, files, [("f1", 0, "x", {"a": 1}), ("f2", 0, "y", {"c": 1})])
    assert [k for _, k, _, _ in report(f, r)] == ["added", "added", "removed", "removed"]


def test_repeated_row_names_must_all_agree_and_do_not_multiply(spark):
    files = [("f1", "s", 1, ["a"]), ("f2", "s", 2, ["b"])]
    rows = [("f1", n, "x", {"a": 1}) for n in range(50)] + [("f2", n, "x", {"b": 1}) for n in range(50)]
    assert [k for _, k, _, _ in report(*drift(spark, files, rows))] == ["renamed"]
    assert [k for _, k, _, _ in report(*drift(spark, files, [*rows, ("f2", 99, "x", {"b": 2})]))] == ["added", "removed"]


def test_bad_payloads_nulls_ties_and_empty_tables(spark):
    files = [("f1", "s", 1, ["a"]), ("f2", "s", 2, ["a"]), ("n", None, 1, None), ("m", "s", None, ["q"])]
    rows = [("f1", 0, "x", '{"a": 1, "b"'), ("f1", 1, None, None), ("f1", 2, "y", "[1]"), ("f1", 3, "y", "5"), ("f1", 4, "y", {"a": "t"}), ("f1", 5, "z", {"a": 1}), ("f2", 0, "x", {"a": 1})]
    f, r = drift(spark, files, rows)
    assert report(f, r) == [("f2", "retyped", "a", "a")]  # of a text and a number the one first seen counts
    assert report(f.where("false"), r.where("false")) == []
    assert report(f, r.where("false")) == []
    clash = r.withColumn("type", F.lit(1)).withColumn("key", F.lit(2)).withColumn("columns", F.lit(3))
    assert report(f.withColumn("before", F.lit("?")), clash) == [("f2", "retyped", "a", "a")]


def test_long_payloads_and_kinds(spark):
    big = {"a": "x" * 300_000, "n": 12345678901234567890123, "e": 1e30, "o": {"k": 1}, "l": [1], "t": True, "i": -4, "d": 5.0, "z": None}
    _, r = drift(spark, [], [("f", 0, "x", big)])
    got = {x.column: x.type for x in sd.tagged_values(r).collect()}
    assert got == {"a": "string", "n": "integer", "e": "decimal", "o": "object", "l": "array", "t": "boolean", "i": "integer", "d": "decimal"}


def test_appearing_alternatives(spark):
    files = [("f1", "s", 1, ["a", "old", "none"]), ("f2", "s", 2, ["a", "new", "none", "added"]), ("f3", "s", 3, ["a", "new"])]
    rows = [("f1", 0, "x", {"a": 1, "old": "p"}), ("f1", 1, "y", {"a": 2, "old": "q"}), ("f2", 0, "x", {"a": 1, "new": "p", "none": True, "added": 1})]
    rows += [("f2", 1, "y", {"a": "stray", "new": "q"}), ("f2", 2, "z", {"a": "stray", "new": 5}), ("f2", 3, "u", {"a": 3}), ("f2", 4, "v", {"a": 4})]
    rows += [("f3", 0, "x", {"a": "only", "new": 1}), ("f3", 1, "y", {"a": 2.5, "new": "q"})]
    f, r = drift(spark, files, rows)
    want = [("f2", "a", "a", "string", 2, 1), ("f2", "new", "old", "integer", 1, 2), ("f2", "none", "none", "boolean", 1, 0), ("f3", "a", "a", "decimal", 1, 1)]
    assert sorted(tuple(x) for x in sd.appearing_alternatives(f.unionByName(f), r.unionByName(r)).collect()) == want
    assert ("f2", "retyped", "a", "a") not in report(f, r)
    assert sd.appearing_alternatives(f.where("false"), r.where("false")).isEmpty()


def test_one_consistent_table(spark):
    files = [("f1", "s", 1, ["old", "v"]), ("f2", "s", 2, ["new", "v"])]
    rows = [("f1", 0, "x", {"old": "p", "v": 1, "not_listed": 1}), ("f2", 0, "x", {"new": "p", "v": 2.5}), ("f2", 1, "y", {"new": "q", "v": "stray"})]
    rows += [("f1", 1, "y", {"v": 3}), ("f2", 2, "z", {"v": 4.5})]
    t = sd.consistent_table(*drift(spark, files, rows))
    got = {(x.file_id, x.row_no, x.column): x for x in t.collect()}
    assert len(got) == 8 and {x.name for x in got.values()} == {"new", "v"}
    stray = got["f2", 1, "v"]
    assert stray.as_string == "stray" and stray.canonical is None and stray.canonical_type == "decimal"
    assert got["f1", 0, "v"].as_integer == 1 and got["f1", 0, "v"].canonical == "1.0" and got["f2", 0, "v"].as_decimal == 2.5
    wide = {(x.file_id, x.row_no): x for x in sd.wide_table(t, "s").collect()}
    assert wide["f1", 0]["new"] == "p" and wide["f2", 0].v == 2.5 and wide["f2", 1].v is None


def test_consistent_table_keeps_every_record(spark):
    files = [("f1", "s", 1, ["a", "empty"]), ("f2", "s", 2, ["a"]), ("n", None, 1, ["a"])]
    rows = [("f1", 0, "x", {"a": 1, "empty": None}), ("f1", 1, "cut", '{"a": 1'), ("f1", 2, "null", None), ("f1", 3, "list", "[1]"), ("f1", 4, "nulls", {"a": None})]
    rows += [("f2", 0, "unlisted", {"b": 2}), ("f2", 1, "y", {"a": 2}), ("n", 0, "no series", {"a": 3}), ("lost", 0, "no file", {"a": 4}), ("f2", None, "no row", {"a": 5})]
    f, r = drift(spark, files, rows)
    t = sd.consistent_table(f, r.unionByName(r))
    got = {(x.file_id, x.row_no): x for x in t.collect()}
    assert t.count() == len(rows) and {k: x.obs_name for k, x in got.items()} == {(i, n): o for i, n, o, _ in rows}
    assert {x.obs_name for x in got.values() if x.column is None} == {"cut", "null", "list", "nulls", "unlisted", "no file"}
    assert got["n", 0].canonical == "3" and got["f1", 1].series_id == "s" and got["f1", 1].canonical is None
    wide = sd.wide_table(t, "s", f)
    assert wide.columns == ["file_id", "row_no", "obs_name", "a", "empty"]
    assert sorted((x.obs_name, x.a, x.empty) for x in wide.collect() if x.a is not None) == [("no row", 5, None), ("x", 1, None), ("y", 2, None)]
    assert wide.count() == 8


def test_components_of_chains_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0} and got[100] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_nested_paths_keep_every_alternative(spark):
    payloads = ['{"a": {"b": 1, "c": [1, "x", {"d": null}]}, "e": 2.5}', '{"a": {"b": "t", "c": []}, "e": {"f": [[true]]}}', '{"a": 3', None, "[1, 2]", '{"a": null}', "{}"]
    rows = [("f", n, f"o{n}", p, None) for n, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "file_id string, row_no int, obs_name string, payload string, loaded_at timestamp").withColumn("path", F.lit("clash"))
    got = {r.path: {(t.type, t.n, t.first_row) for t in r.types} for r in sd.fused_paths(df.where("row_no <> 4")).collect()}
    assert got == {
        "a": {("object", 2, 0)}, "a.b": {("integer", 1, 0), ("string", 1, 1)}, "a.c": {("array", 2, 0)}, "a.c[]": {("integer", 1, 0), ("string", 1, 0), ("object", 1, 0)},
        "e": {("decimal", 1, 0), ("object", 1, 1)}, "e.f": {("array", 1, 1)}, "e.f[]": {("array", 1, 1)}, "e.f[][]": {("boolean", 1, 1)},
    }
    assert sd.fused_paths(df.where("false")).isEmpty()
