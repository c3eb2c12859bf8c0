"""Every query over the smallest tables; those with SQL against DuckDB; all inputs as empty tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

from corpusloom import queries, queries_more  # noqa: F401 (adds to the queries)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def normal(df):
    df = df[sorted(df.columns)]

    def one(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([one(x) for x in v])
        return "null" if v is None or pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for f in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).coalesce(1).write.parquet(f"{at}/{f.name}")
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    queries.QUERIES[name](spark, empty).collect()
