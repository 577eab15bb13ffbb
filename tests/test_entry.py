"""The entry module: every query runs over a small scale and agrees with its SQL; nothing outside the optional subpackage needs it."""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for t in compare.TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "similarity", "rank"]


@pytest.mark.parametrize("name", sorted(entry.PLANS.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = compare.rows(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.PLANS.SQL:
        cursor = db.execute(entry.PLANS.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == compare.rows(columns, cursor.fetchall())


def test_only_the_entry_knows_the_optional_subpackage():
    for path in (ROOT / "groundwork").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path
