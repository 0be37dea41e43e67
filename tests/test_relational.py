from pyspark.sql import functions as F

from lodetrace.operators import advisories, graph, lookalike, relational


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keep_first_last_prefer(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "w"), (None, 5, None), (None, 5, None), ("b", None, "z")], "k string, n int, _o0 string")
    assert rows(relational.keep_first(df, ["k"], F.col("n"))) == [("a", 1, "w"), ("b", None, "z"), (None, 5, None)]
    assert rows(relational.keep_last(df, ["k"], F.col("n"))) == [("a", 2, "x"), ("b", None, "z"), (None, 5, None)]
    assert relational.keep_first(df.limit(0), ["k"], F.col("n")).count() == 0
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("b", 9)], "k string, n int")
    assert rows(relational.prefer(new, old, ["k"])) == [("a", 1), ("b", 9)]


def test_fill_forward_and_top_k(spark):
    df = spark.createDataFrame([("r", i, v, None) for i, v in enumerate([None, "a", None, "b", None])], "g string, i int, v string, other string")
    assert [r.v for r in relational.fill_forward(df, ["g"], ["i"], ["v"]).orderBy("i").collect()] == [None, "a", "a", "b", "b"]
    assert rows(relational.top_k(df.select("g", "i"), ["g"], 2, F.desc("i"))) == [("r", 3), ("r", 4)]


def test_nearest_ancestor(spark):
    places = spark.createDataFrame([("p", x) for x in ("node_modules/a", "node_modules/b", "node_modules/a/node_modules/b", "node_modules/a/node_modules/b/node_modules/c", "node_modules/c")], "scope string, path string")
    wants = spark.createDataFrame([("p", "node_modules/a", "b"), ("p", "node_modules/b", "a"), ("p", "node_modules/a/node_modules/b", "c"), ("p", "node_modules/a", "c"), ("p", "", "a"), ("p", "node_modules/a", "zz"), ("q", "", "a")], "scope string, base string, name string")
    got = {(r.base, r.name): r.path for r in relational.resolve_nearest(wants, places).collect()}
    assert got == {
        ("node_modules/a", "b"): "node_modules/a/node_modules/b", ("node_modules/b", "a"): "node_modules/a", ("node_modules/a/node_modules/b", "c"): "node_modules/a/node_modules/b/node_modules/c",
        ("node_modules/a", "c"): "node_modules/c", ("", "a"): "node_modules/a",
    }


def test_row_numbers_and_prefix_rules(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)][::-1], "k string")
    got = relational.row_numbers(df, "k").collect()
    assert {r.k: r.n for r in got} == {f"k{i:03d}": i for i in range(50)}
    clash = spark.createDataFrame([(2, 7, 8, 9), (1, 7, 8, 9)], "k int, _at int, _part int, __base int")
    assert rows(relational.row_numbers(clash, "k", name="n")) == [(1, 7, 8, 9, 0), (2, 7, 8, 9, 1)]
    # many partitions, and a key that a third of all rows share
    many = spark.range(3_000_000).selectExpr("id", "case when id % 3 = 0 then 7 else hash(id) end as k")
    numbered = relational.row_numbers(many, "k", name="at")
    found = numbered.agg(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at")).first()
    assert tuple(found) == (3_000_000, 3_000_000, 0, 2_999_999)
    later = numbered.select("k", F.col("at").alias("n")).groupBy("k").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    assert later.orderBy("k").selectExpr("lo > lag(hi) over (order by k) as fine").where("not fine").isEmpty()
    names = spark.createDataFrame([("stripe",), ("@aws-sdk/s3",), ("x",), (None,)], "name string")
    assert rows(relational.prefix_rules(names, [("stripe", "Stripe")], [("@aws-sdk/", "AWS"), ("@", "other")])) == [("@aws-sdk/s3", "AWS"), ("stripe", "Stripe"), ("x", None), (None, None)]


def test_snapshot_compare(spark):
    a = spark.createDataFrame([("p", ["x", "y"]), ("q", None)], "k string, m array<string>")
    b = spark.createDataFrame([("p", ["y", "z"]), ("r", ["w"])], "k string, m array<string>")
    assert rows(relational.snapshot_compare(a, b, "k", ["m"])) == [("p", ["z"], ["x"]), ("q", [], []), ("r", ["w"], [])]


def test_lookalikes_equal_all_pairs(spark):
    pop = ["requests", "lodash", "react", "express", "numpy", "q", "left-pad"]
    names = ["reqeusts", "request", "requests", "lodahs", "loadsh", "raect", "reacct", "expres", "exprss", "numpi", "nunpi", "q1", "leftpad", "left--pda", "Lodashh", None, ""]
    got = lookalike.lookalikes(spark.createDataFrame([(n, 1) for n in names], "name string, rank int"), spark.createDataFrame([(p, i) for i, p in enumerate(pop)], "name string, rank int"))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [prev := i] + [prev := min(row[j] + 1, prev + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1)]
        return row[-1]

    want = set()
    for n in set(names) - {None}:
        if n.lower() in pop:
            continue
        hits = [(lev(n.lower(), p), i, p) for i, p in enumerate(pop) if len(p) >= 5 and lev(n.lower(), p) <= (2 if min(len(n), len(p)) >= 7 else 1)]
        if hits:
            want.add((n, min(hits)[2], min(hits)[0]))
    assert set(map(tuple, got.collect())) == want and len(want) > 5


def test_graph_levels_and_merge(spark):
    e = spark.createDataFrame([("g", a, b) for a, b in ["ab", "bc", "ca", "cd"]], "grp string, src string, dst string")
    s = spark.createDataFrame([("g", "a"), ("g", "a")], "grp string, node string")
    assert rows(graph.levels(s, e)) == [("g", "a", 0), ("g", "b", 1), ("g", "c", 2), ("g", "d", 3)]
    assert rows(graph.levels(s, e, most=1)) == [("g", "a", 0), ("g", "b", 1)]
    n = spark.createDataFrame([("p", "k", None, 3, ["b"], None, ["x"]), ("p", "k", True, None, ["a", "b", None], ["y"], None)], "project_id string, package_key string, direct boolean, depth int, scopes array<string>, dependencies array<string>, parents array<string>")
    assert rows(graph.merge_nodes(n)) == [("p", "k", True, 3, ["a", "b"], ["y"], ["x"])]


def test_breach_lookup(spark):
    import hashlib

    h = hashlib.sha1(b"hunter2").hexdigest().upper()
    ranges = spark.createDataFrame([(h[:5], h[5:], 7), ("AAAAA", "B", 1)], "prefix string, suffix string, count bigint")
    assert rows(advisories.breached(spark.createDataFrame([("hunter2",), ("other",), (None,)], "value string"), ranges)) == [("hunter2", 7)]
