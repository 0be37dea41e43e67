import pytest

from lodetrace.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": "origin string, row_id bigint, line_no int", "p2_found": "identifier string, group_id string", "p6_found": "record_id bigint, version string, license_id string", "p7_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark):
    df = queries.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
        assert df.count() == df.distinct().count() > 0
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(name, spark, empty_root):
    assert queries.QUERIES[name](spark, empty_root).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_repeated_rows_and_more_columns(name, spark, null_root):
    df = queries.QUERIES[name](spark, null_root)
    rows = df.collect()
    if name in COLUMNS:
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name] and len(rows) == len(set(rows))
