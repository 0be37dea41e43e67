"""Every query of the core against its SQL on the smallest tables."""

import pytest

from lodetrace.plans import catalogue

from conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(name, spark, same_as_sql):
    same_as_sql(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(name, spark):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


#: Queries that list what there could be, whether there is any or not.
ALWAYS = {"a_severity", "a_vulnerabilities", "a_secrets", "j_services", "u_popular_names"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(name, spark, empty_root):
    rows = catalogue.QUERIES[name](spark, empty_root).collect()
    assert bool(rows) == (name in ALWAYS)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_nulls_repeated_rows_and_more_columns(name, spark, null_root):
    df = catalogue.QUERIES[name](spark, null_root)
    assert df.columns == catalogue.QUERIES[name](spark, SF).columns and df.count() >= 0
