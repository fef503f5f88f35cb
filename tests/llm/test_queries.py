import importlib
import re

import duckdb
import pytest
from conftest import duck_rows, spark_rows

from mercato.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees_on_sample_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_return_every_document(spark, name):
    rows = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert rows.count() == docs.count()
