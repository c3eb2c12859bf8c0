"""The queries of the ten problems over the smallest tables, against SQL where there is SQL, and over empty tables."""

import os
from pathlib import Path

import pytest

from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
SLOW = {"p10_scores", "p10_rates"}  # the same training again
FORMS = {
    "p1_found": ["tab", "key_a", "key_b"], "p2_found": ["tab", "record_key"], "p3_found": ["tab", "record_key"], "p4_found": ["tab", "record_key", "language"], "p5_found": ["article_id_a", "article_id_b"],
    "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - SLOW))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    if name in FORMS:
        assert df.columns == FORMS[name]
    got = [tuple(r) for r in df.collect()]
    if name in FORMS and name != "p8_ids":
        assert len(set(got)) == len(got)
    sql = queries.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in Path(DATA).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        r = c.execute(sql)
        order = [[x[0] for x in r.description].index(n) for n in df.columns]
        assert sorted(got) == sorted(tuple(row[i] for i in order) for row in r.fetchall())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for f in Path(DATA).glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).coalesce(1).write.parquet(f"{at}/{f.name}")
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    queries.queries()[name](spark, empty).collect()
