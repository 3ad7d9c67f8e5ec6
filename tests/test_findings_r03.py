"""Findings of round 3: the work and the rows that a change to a plan must keep."""

import datetime

from pyspark.sql import functions as F

from pricelens.operators.cleaning import build_price_history, per_date_points, record_counts
from pricelens.plans import views as V
from pricelens.plans.cleaning import classified, per_date
from pricelens.plans.features import item_features
from pricelens.plans.trends import annual_real, price_vs_market_query
from pricelens.plans.views import panel_monthly
from pricelens.sources.landed import chart_points, ingest_status
from tests.test_edges import _dim, _items, _points


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_record_counts_are_those_of_the_history(spark):
    """F14 to F17, F19; items that stand twice count twice, as in the history."""
    for items in (_items(spark), _items(spark).union(_items(spark).limit(3))):
        want = build_price_history(per_date_points(_points(spark), items, _dim(spark))).select("item_id", "price_record_count")
        got = record_counts(_points(spark), items, _dim(spark)).select("item_id", "price_record_count")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
        assert "date" not in plan(got).split("HashAggregate")[1].split("\n")[0]


def test_daily_rows_are_not_sorted_for_the_items(spark):
    """F9, F10."""
    text = plan(per_date_points(_points(spark), _items(spark), _dim(spark)))
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def _pages(spark):
    script = "<script>VGPC.chart_data = {};</script>".format
    rows = [("a", 200, script('{"used": [[0,100],[86400000,0]], "foo": [[0,5]], "cib": [[0,7,1],[0,null],[0,250]]}')), ("b", 200, script('{"new": [[0,0]]}')),
            ("c", 200, "<html>no chart</html>"), ("d", 500, None), ("e", 200, script("{broken}")), ("f", 200, script("{}")), ("g", 500, script('{"used": [[0,300]]}')),
            ("h", 200, script('{"used": null, "new": [[0,100]]}')), ("i", 200, None), ("j", 200, "")]
    return spark.createDataFrame(rows, "page_id string, http_status int, html string")


def test_charts_are_parsed_once(spark):
    """F8, F11, F12, F18."""
    pages = _pages(spark).repartition(2)
    points, status = chart_points(pages), ingest_status(pages)
    assert sorted((r.page_id, r.condition, float(r.price_usd)) for r in points.collect()) == \
        [("a", "cib", 2.5), ("a", "loose", 1.0), ("g", "loose", 3.0), ("h", "new", 1.0)]
    assert sorted(map(tuple, status.collect())) == [
        ("b", "empty"), ("c", "no_data"), ("d", "fetch_error"), ("e", "no_data"), ("f", "empty"), ("g", "fetch_error"),
        ("h", "empty"), ("i", "no_data"), ("j", "no_data")]
    for df in (chart_points(pages), ingest_status(pages)):
        assert plan(df).count("regexp_extract") == plan(df).count("from_json") == 1


def _tables(spark, tmp_path):
    """part and lineitem with an item that stands twice, one without lines, one
    without a canonical line, null keys, and lines without a price or a date."""
    parts = [(k, f"part {k}", f"Brand#{k % 3}", "SMALL", 11 + k, 900.0) for k in (1, 2, 3, 4, 8, 8)] + [(None, "lost", "Brand#1", "SMALL", 3, 1.0)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    day = lambda m: datetime.datetime(1996, m, 5)
    lines = [(1, 2.0, 30.0, "N", day(3)), (1, 2.0, 31.0, "N", day(3)), (1, 1.0, 9.0, "A", day(2)), (1, 0.0, 9.0, "N", day(1)), (1, 1.0, 2.0, "N", day(4)),
             (1, 1.0, 5.0, "N", None), (2, 1.0, 5.0, "A", day(1)), (4, 1.0, 5.0, "empty", day(6)), (8, 1.0, 5.0, "N", day(7)), (8, 1.0, 5.0, None, day(5)),
             (None, 1.0, 5.0, "N", day(1)), (77, 1.0, 5.0, "N", day(1))]
    rows = [(n, k, 1, n % 5, q, p, 0.0, 0.0, c, "F", d) for n, (k, q, p, c, d) in enumerate(lines)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp") \
        .coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_classified_reads_the_lines_once(spark, tmp_path):
    """F15, F16: one pass over the lines, no sort for a join; rows as by the history."""
    p = V.Panel(spark, _tables(spark, tmp_path))
    c = classified(p)
    hist = build_price_history(per_date(p)).select("item_id", F.col("price_record_count").alias("want"))
    got = c.join(hist, "item_id", "left").select("item_id", "release_year", "price_record_count", "want").collect()
    assert sorted((r.item_id or 0, r.price_record_count) for r in got) == [(0, None), (1, 3), (2, 0), (3, None), (4, None), (8, 2), (8, 2)]
    assert all(r.price_record_count == r.want for r in got)
    assert {r.item_id: r.release_year for r in got}[1] == 1996
    text = plan(c)
    assert text.count("ReadSchema: struct<l_partkey") == 1 and "SortMergeJoin" not in text


def test_composite_jobs_stage_their_tables(spark, tmp_path):
    """shared tables are read by column and annual prices are worked out once;
    components meet the items without sorts.  An item that stands twice keeps its rows."""
    sf = _tables(spark, tmp_path)
    with V.materialized(spark, sf) as p:
        shared = annual_real(p)
        assert shared is annual_real(p) and "FileScan parquet" in plan(shared) and "Aggregate" not in plan(shared)
        assert sorted(map(tuple, p.panel_m.collect()), key=repr) == sorted(map(tuple, panel_monthly(p.price_points).collect()), key=repr) != []
        assert price_vs_market_query(spark, sf).count() == price_vs_market_query(spark, sf).where("item_id is not null").count() + 1
    df = item_features(spark, sf)
    assert plan(df).count("ShuffledHashJoin") >= 11
    one = df.groupBy("item_id").count().where("item_id in (1, 2, 3)").collect()
    assert sorted(map(tuple, one)) == [(1, 1), (2, 1), (3, 1)]


def test_production_averages_points_of_included_items(spark, tmp_path):
    """F16: other items are left out before the mean, which has an exchange of its
    own behind that join, so that the points of a hot item are combined first."""
    sf = _tables(spark, tmp_path)
    p = object.__new__(V.Panel)
    p.__init__(spark, sf)
    p.materialize, p.included = True, spark.createDataFrame([(1, 1996), (8, 1999), (8, 1999), (None, 1990)], "item_id bigint, release_year int")
    panel = panel_monthly(p._points_of_included())
    top, joined = plan(panel).split("LeftSemi")
    assert "partial_avg" in top and top.index("Exchange hashpartitioning(item_id") < top.index("partial_avg")
    want = panel_monthly(p.price_points).where("item_id in (1, 8)")
    assert sorted(map(tuple, p.panel_m.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) != []
