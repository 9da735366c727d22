"""Every registered query against its SQL oracle (DuckDB) on the sf0.001 tables, plus the
driver entry point."""

import duckdb
import pytest

import __spark_entry__ as E
from sparkeval.session import TABLES
from tools.oracle_check import _digest

SF = "/root/testdata/sf0.001"
SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "n_matches", "status", "n_chunks", "kept_chars"]
    assert df.count() == 200


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 85


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    rel = con.sql(ORACLES[name])
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert got_types == want_types
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    got, _ = _digest(df.columns, rows)
    want, _ = _digest(cols, res.fetchall())
    assert got == want
