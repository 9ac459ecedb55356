"""Every query with SQL gives DuckDB's rows on the small tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sievework import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def plain(value):  # noqa: ANN001, ANN201
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, duck, name):  # noqa: ANN001
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    held = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(held.columns) == columns
    places = [held.columns.index(c) for c in columns]
    assert ours == Counter(tuple(plain(r[i]) for i in places) for r in held.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):  # noqa: ANN001
    df = catalogue.queries()[name](spark, DATA)
    assert df.schema == catalogue.queries()[name](spark, DATA).schema
    assert df.count() >= 0


def test_the_entry_gives_findings(spark):  # noqa: ANN001
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
