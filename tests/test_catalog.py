"""Every query with SQL agrees with DuckDB on the smallest tables; the rest runs."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidewright.plans import cases, catalog, intake, records  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.SQL:
        cursor = con.execute(catalog.SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert canon(df.columns, [tuple(r) for r in rows]) == canon(columns, cursor.fetchall())


def test_every_query_of_the_entry_is_tried():
    corpus = {n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
    assert set(__spark_entry__.queries()) - corpus == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) - corpus == set(catalog.SQL)
