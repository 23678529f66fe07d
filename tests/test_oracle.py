"""Every registered query against its DuckDB oracle (values and types), and the
rows-only keys for a stable schema. Runs at sf0.001 for speed; set
BUDGETLENS_ORACLE_DIR=/root/testdata/sf0.01 for the driver's scale
(tools/compare.py runs the same check as a script)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL as _SF_DEFAULT
from tools.compare import TABLES, rows_of, type_class

SF_SMALL = os.environ.get("BUDGETLENS_ORACLE_DIR", _SF_DEFAULT)
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    got = sdf.toPandas()
    want = duck.execute(ORACLES[key]).df()
    assert len(got) == len(want)
    assert sorted(got.columns) == sorted(want.columns)
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    for c in got.columns:
        if not (want[c].isna().all() or got[c].isna().all()):
            assert type_class(stypes[c]) == type_class(want[c].dtype), c
    assert rows_of(got, True) == rows_of(want, True)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:5] == ["State", "District", "Ministry", "Department", "Scheme_Name"]
