"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__
from relicframe.plans import report_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(report_queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = report_queries.QUERIES[name](spark, SF)
    want = duck.sql(report_queries.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted_rows(found.collect(), found.columns) == sorted_rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["w03_file_names", "w13_chunks_from_log", "w19_embedded_rows"])
def test_query_equals_sql_on_more_rows(spark, name):
    """Ties and odd names that the smallest tables do not hold."""
    connection = duckdb.connect()
    for t in ("pages", "lineitem", "orders"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    found, want = report_queries.QUERIES[name](spark, "/root/testdata/sf0.01"), connection.sql(report_queries.ORACLES[name])
    assert sorted_rows(found.collect(), found.columns) == sorted_rows(want.fetchall(), want.columns)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_forks_return_what_went_in(spark):
    parts = {str(r.p_partkey): (r.p_name, r.p_size) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    rows = report_queries.QUERIES["q35_fork_round_trip"](spark, SF).collect()
    assert {r.file: (r["name"], r.id) for r in rows} == parts and all(r.status == "ok" and r.payload_bytes == len(r["name"]) for r in rows)
