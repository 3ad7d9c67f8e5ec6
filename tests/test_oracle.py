"""Every registered query against its DuckDB oracle on the smallest data."""

import datetime
import decimal
import math

import duckdb
import pytest

from pricelens.plans.registry import all_queries
from pricelens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN", "float": "FLOAT"}
QUERIES = all_queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def _canon(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# Queries without a twin have tests of their own.
@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle is not None))
def test_query_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    df = q.build(spark, SF)
    got = df.collect()
    res = duck.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    assert _canon(df.columns, got) == _canon(dcols, res.fetchall())
    types = {r[0]: r[1] for r in duck.execute("DESCRIBE " + q.oracle).fetchall()}
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) == types[f.name], (name, f.name)
