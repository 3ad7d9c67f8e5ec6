"""Committed tables, resumed runs, files with broken rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pricelens import jobs
from pricelens.operators.resume import STATE_SCHEMA, run_state, tried_pages
from pricelens.sources import sinks as S
from pricelens.sources.tables import read_csv, split_corrupt

CHART = '<script>VGPC.chart_data = {"used": [[946684800000, %d]]};</script>'
PAGES = "page_id string, http_status int, html string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_replace_append_and_skip_batches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a int, b string"
    df = lambda *x: spark.createDataFrame(list(x), schema)
    assert S.read_committed(spark, path, schema).count() == 0
    assert S.commit_table(df((1, "x")), path, "append", "one")
    assert S.commit_table(df((2, "y")), path, "append", "two")
    assert not S.commit_table(df((9, "again")), path, "append", "two")
    assert rows(S.read_committed(spark, path, schema)) == [(1, "x"), (2, "y")] and S.committed_batches(spark, path) == ["one", "two"]
    # a table may replace itself: what is read stays until the commit
    assert S.commit_table(S.read_committed(spark, path, schema).where("a = 2"), path)
    assert rows(S.read_committed(spark, path, schema)) == [(2, "y")] and S.committed_batches(spark, path) == []
    assert S.commit_table(df((3, None)), path, "append")
    assert set(rows(S.read_committed(spark, path, schema).select("a", F.coalesce("b", F.lit("-"))))) == {(2, "y"), (3, "-")}


def test_a_job_that_dies_halfway_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "a int"
    S.commit_table(spark.range(3).select(F.col("id").cast("int").alias("a")), path, "append", "one")
    dying = spark.range(10, numPartitions=5).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("a"))
    with pytest.raises(Exception):
        S.commit_table(dying, path, "append", "two")
    assert rows(S.read_committed(spark, path, schema)) == [(0,), (1,), (2,)]
    # dies between the data and the manifest
    with monkeypatch.context() as m:
        m.setattr(S.json, "dumps", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            S.commit_table(spark.range(1).select(F.lit(7).alias("a")), path, "append", "two")
    assert rows(S.read_committed(spark, path, schema)) == [(0,), (1,), (2,)]
    assert S.commit_table(spark.range(1).select(F.lit(7).alias("a")), path, "append", "two")
    assert rows(S.read_committed(spark, path, schema)) == [(0,), (1,), (2,), (7,)]


def test_cache_takes_no_half_written_folder(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def compute():
        calls.append(1)
        return spark.range(4)
    os.makedirs(path)
    spark.range(1).write.mode("overwrite").parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert S.cache_or_compute(spark, path, compute).count() == 4
    assert S.cache_or_compute(spark, path, compute).count() == 4 and len(calls) == 1


def test_runs_resume_retry_and_count(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "ingest")
    page = lambda i, html, status=200: (f"p{i}", status, html)
    first = spark.createDataFrame([page(0, CHART % 100), page(1, None, 500), page(2, "<html></html>")], PAGES)
    assert jobs.run_ingest(spark, first, out, "a") == {"scraped": 1, "skipped": 0, "failed": 2, "total": 3}
    assert jobs.run_ingest(spark, first, out, "a") is None
    # page 1 is there now; page 2 stays empty; page 3 is new
    second = spark.createDataFrame([page(0, CHART % 999), page(1, CHART % 200), page(2, "<html></html>"), page(3, CHART % 300)], PAGES)
    # stops after the points were written
    commit = S.commit_table
    with monkeypatch.context() as m:
        m.setattr(jobs, "commit_table", lambda df, path, *a, **k: commit(df, path, *a, **k) if path.endswith("points") else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.run_ingest(spark, second, out, "b")
    assert jobs.run_ingest(spark, second, out, "b") == {"scraped": 2, "skipped": 1, "failed": 1, "total": 4}
    points = S.read_committed(spark, f"{out}/points", "page_id string, condition string, date date, price_usd double")
    assert rows(points.select("page_id", "price_usd")) == [("p0", 1.0), ("p1", 2.0), ("p3", 3.0)]
    assert jobs.run_ingest(spark, second, out, "c") == {"scraped": 0, "skipped": 3, "failed": 1, "total": 4}
    # tried three times: given up
    assert jobs.run_ingest(spark, second, out, "d") == {"scraped": 0, "skipped": 4, "failed": 0, "total": 4}
    state = {r.page_id: (r.status, r.attempts) for r in S.read_committed(spark, f"{out}/state", STATE_SCHEMA).collect()}
    assert state == {"p0": ("done", 1), "p1": ("done", 2), "p2": ("no_data", 3), "p3": ("done", 1)}


def test_state_keeps_pages_that_a_run_does_not_have(spark):
    state = spark.createDataFrame([("old", "no_data", 2), ("gone", "done", 1)], STATE_SCHEMA)
    pages = spark.createDataFrame([("new", 200, CHART % 5), ("old", 404, None)], PAGES)
    got = {r.page_id: (r.status, r.attempts, r.outcome) for r in run_state(pages, state).collect()}
    assert got == {"old": ("fetch_error", 3, "failed"), "gone": ("done", 1, None), "new": ("done", 1, "scraped")}
    assert {r.page_id for r in tried_pages(pages, state).collect()} == {"new", "old"}
    assert run_state(pages.limit(0), state.limit(0)).count() == 0


def test_rows_that_do_not_fit_the_schema(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write('a,n\n"x, ""y""",1\nz,two\nshort\nw,3,4\n,\n')
    schema = StructType([StructField("a", StringType()), StructField("n", IntegerType())])
    good, dead = split_corrupt(read_csv(spark, path, schema))
    assert set(tuple(r) for r in good.collect()) == {('x, "y"', 1), (None, None)}
    assert rows(dead) == [("short", "malformed"), ("w,3,4", "malformed"), ("z,two", "malformed")]
