from datetime import datetime

from pyspark.sql import functions as F

from lodetrace.operators.snapshots import canonical_json, canonical_list, snapshot_changes, validity_intervals

T = lambda d: datetime(2026, 1, d)
SCHEMA = "snap int, project string, fp string, at timestamp, a string, places array<string>, props string, k0 string, change string"


def events(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, ["project", "fp"], "snap", "at", [F.col("a"), canonical_list(F.col("places")), canonical_json(F.col("props"))])
    return sorted(map(tuple, out.collect()), key=str)


def row(snap, fp, a="x", at=1, project="p", places=("u",), props='{"k":1}'):
    return (snap, project, fp, T(at) if at else None, a, list(places) if places is not None else None, props, "clash", "clash")


def test_added_removed_changed_and_return(spark):
    rows = [row(1, "f"), row(2, "f", "y"), row(4, "f", "y"), row(3, "g"), row(4, "g")]
    assert events(spark, rows) == [(2, "p", "f", "changed"), (3, "p", "f", "removed"), (3, "p", "g", "added"), (4, "p", "f", "added")]


def test_layout_and_order_do_not_count(spark):
    rows = [row(1, "f", places=("u", "v"), props='{"k":1,"m":{"a":2,"b":3}}'), row(2, "f", places=("v", "u"), props='{ "m":{"b":3, "a":2}, "k" : 1}')]
    assert events(spark, rows) == []


def test_nulls_differ_from_values_and_do_not_swap(spark):
    assert events(spark, [row(1, "f", a=None), row(2, "f", a="")]) == [(2, "p", "f", "changed")]
    assert events(spark, [row(1, "f", places=None), row(2, "f", places=())]) == [(2, "p", "f", "changed")]
    assert events(spark, [row(1, "f", props=None), row(2, "f", props=None)]) == []
    assert events(spark, [row(1, "f", props="not json"), row(2, "f", props="not  json")]) == [(2, "p", "f", "changed")]


def test_latest_row_holds_and_ties_are_stable(spark):
    rows = [row(1, "f", "old", 1), row(1, "f", "new", 2), row(1, "f", "none", None), row(2, "f", "new", 1), row(2, "f", "new", 1)]
    assert events(spark, rows) == []
    tie = [row(1, "f", "a", 1), row(1, "f", "b", 1), row(2, "f", "b", 1), row(2, "f", "a", 1)]
    assert events(spark, tie) == events(spark, tie[::-1]) == []


def test_null_keys_and_empty_table(spark):
    assert events(spark, [row(1, None), row(2, "f", project=None)]) == [(2, None, "f", "added")]
    assert events(spark, []) == []


def test_very_long_text(spark):
    assert events(spark, [row(1, "f", "z" * 300_000), row(2, "f", "z" * 299_999 + "y")]) == [(2, "p", "f", "changed")]


def test_intervals(spark):
    df = spark.createDataFrame([row(s, "f", "x" if s < 3 else "y") for s in (1, 2, 3, 5)], SCHEMA)
    got = validity_intervals(df, ["project", "fp"], "snap", "at", [F.col("a")]).orderBy("first").select("first", "last", "before", "after").collect()
    assert [tuple(r) for r in got] == [(1, 2, None, 3), (3, 3, 2, 5), (5, 5, 3, None)]
