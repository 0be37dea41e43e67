import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodetrace.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture
def same_as_sql(spark, duck):
    from collections import Counter

    def check(df, sql):
        cols = sorted(df.columns)
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = Counter(str(tuple(dict(zip(names, r))[c] for c in cols)) for r in cur.fetchall())
        got = Counter(str(tuple(r[c] for c in cols)) for r in df.collect())
        assert got == want

    return check


def _altered(spark, root, change):
    for p in Path(SF).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        change(df).coalesce(1).write.parquet(f"{root}/{p.stem}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_root(spark, tmp_path_factory):
    """The tables without rows."""
    return _altered(spark, tmp_path_factory.mktemp("empty"), lambda df: df.limit(0))


@pytest.fixture(scope="session")
def null_root(spark, tmp_path_factory):
    """Forty rows of each table, each twice, and for every column one of them with a null in it; one row of
    nulls only; and more columns than the tables have."""
    from pyspark.sql import functions as F

    def change(df):
        some = df.limit(40)
        out = some.unionByName(some).unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
        for c in df.columns:
            out = out.unionByName(df.limit(1).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        return out.withColumn("_rank", F.lit(1)).withColumn("at", F.lit("x")).withColumn("salt", F.lit(2)).withColumn("piece", F.lit("p"))

    return _altered(spark, tmp_path_factory.mktemp("nulls"), change)
