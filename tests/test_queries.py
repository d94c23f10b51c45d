"""Every registered query beside its SQL, at the smallest scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from check_queries import rows  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def test_every_query_has_sql():
    assert set(entry.survey_queries()) == set(entry.survey_sql())


@pytest.mark.parametrize("name", list(entry.survey_queries()))
def test_query_equals_sql(spark, db, name):
    frame = entry.survey_queries()[name](spark, SF)
    cursor = db.execute(entry.survey_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
