import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodetrace.llm import queries
from lodetrace.llm.advisory_groups import advisory_pairs, identifier
from lodetrace.llm.components import _union_cell, connected_groups

SF = "/root/testdata/sf0.001"


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in up if any(x in p and None not in p and p[0] != p[1] for p in pairs)}


def groups(spark, pairs, cell):
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "a string, b string, v string, m int")
    rows = connected_groups(df, cell_pairs=cell).collect()
    got = {r.vertex: r.group for r in rows}
    assert len(got) == len(rows)
    return got


def test_grid_rounds_equal_plain_union_find(spark):
    chain = [(f"n{i:03d}", f"n{(i * 7 + 3) % 60:03d}") for i in range(60)]
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    star = [("hub", f"s{i:03d}") for i in range(80)]
    odd = [("x", "x"), (None, "y"), ("z", None), ("b", "a"), ("a", "b"), ("a", "b"), ("", "e"), ("q" * 5000, "r")]
    pairs = chain + path + star + odd
    assert groups(spark, pairs, 4) == groups(spark, pairs, 50_000) == brute(pairs)


def test_empty(spark):
    assert groups(spark, [], 4) == {} and groups(spark, [("a", "a")], 4) == {}


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=20))
def test_cell(pairs):
    import pandas as pd

    got = _union_cell(pd.DataFrame(pairs, columns=["a", "b"]))
    want = brute(pairs)
    assert all(want.get(v, v) == r for v, r in zip(got["v"], got["r"]))


def test_identifiers(spark):
    v = ["cve-2020-1", " GHSA‑aaaa‑bbbb‑cccc\n", "CVE - 2019 - 22", "n/a", "", None, "CVE-2020-1x", "mal–2024–7", "PYSEC-2020-3"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string")
    got = [r.x for r in df.select("i", identifier(df.v).alias("x")).orderBy("i").collect()]
    assert got == ["CVE-2020-1", "GHSA-AAAA-BBBB-CCCC", "CVE-2019-22", None, None, None, None, "MAL-2024-7", "PYSEC-2020-3"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, spark, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, SF), queries.SQL[name])


def test_every_input_of_the_pairs_can_link(spark):
    """Entries of the exploited-flaw feed name one identifier, which links nothing."""
    pairs = advisory_pairs(spark, SF)
    assert {f.rsplit("/", 1)[1] for f in pairs.inputFiles()} == {"osv_vulnerability.parquet"}
    assert pairs.where("a <> b").count() > 0
