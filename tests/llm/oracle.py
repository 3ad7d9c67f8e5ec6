"""Run a DuckDB oracle over DataFrames or data folders."""

import duckdb

TABLES = ("documents", "benchmark", "labels", "conversations")


def duck(sf_dir=None, **frames):
    con = duckdb.connect()
    if sf_dir:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return con


def same(df, con, sql):
    """Both results, columns by name, rows sorted."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=repr)
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert cols == [names[i] for i in order]
    assert ours == theirs
    return ours
