"""Edge rows (FIXTURES.md §3) through the operators."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.operators.asof import deflate
from pricelens.operators.cleaning import build_price_history, per_date_points
from pricelens.operators.forecast import trend_projection
from pricelens.operators.matching import containment_match, match_titles
from pricelens.operators.series import window_features
from pricelens.operators.training import history_rows

D = dt.date


def _points(spark):
    rows = [
        (1, D(2023, 9, 1), 10.0, "A", 1), (1, D(2023, 10, 1), 12.0, "A", 2), (1, D(2023, 12, 1), 15.0, "A", 3),
        (2, D(2023, 12, 1), 9.0, "A", 4),                                      # one point
        (3, D(2023, 10, 1), 0.0, "A", 5), (3, D(2023, 11, 1), -4.0, "A", 6),   # zero and negative
        (5, D(2023, 11, 1), 7.0, "A", 7), (5, D(2023, 11, 1), 8.0, "A", 8),    # duplicate date: seq 8 wins
        (6, D(2023, 11, 1), 3.0, "no_data", 9), (6, None, None, "fetch_error", 10),   # sentinels
        (7, D(2023, 11, 1), float("nan"), "A", 11), (7, D(2023, 12, 1), 5.0, "A", 12),  # NaN
        (8, D(2023, 11, 1), 6.0, "A", 13),                                     # platform unknown
        (None, D(2023, 11, 1), 6.0, "A", 14),                                  # null key
    ]
    return spark.createDataFrame(rows, "item_id int, date date, price double, condition string, seq int")


def _items(spark):
    rows = [(i, "P1") for i in (1, 2, 3, 4, 5, 6, 7)] + [(8, "P9")]
    return spark.createDataFrame(rows, "item_id int, platform string")


def _dim(spark):
    return spark.createDataFrame([("P1", "A")], "platform string, canonical_condition string")


def test_history_edges(spark):
    h = {r.item_id: r for r in build_price_history(per_date_points(_points(spark), _items(spark), _dim(spark))).collect()}
    assert h[1].price_record_count == 3 and h[1].price_history == "2023-09-01=10.00,2023-10-01=12.00,2023-12-01=15.00"
    assert h[5].price_record_count == 2 and h[5].price_history == "2023-11-01=8.00"     # last wins, both counted
    assert 6 not in h                                                                     # only sentinel rows
    assert h[7].price_history == "2023-12-01=5.00"                                        # NaN dropped
    assert h[8].price_record_count == 0 and h[8].price_history == ""                      # unknown platform
    assert 4 not in h and None not in h                                                   # no history / null key


def test_windows_edges(spark):
    pts = _points(spark).where(F.col("condition") == "A").select("item_id", "date", F.col("price").alias("real"))
    w = {r.item_id: r for r in window_features(pts, "2023-12-31").collect()}
    assert w[1].price_change_6m == 5.0 and w[1].price_velocity_6m is not None       # missing month is fine
    assert w[2].price_change_6m is None and w[2].price_velocity_6m is None           # one point
    assert 3 not in w                                                                # no positive point
    assert w[7].price_change_6m is None                                              # NaN excluded -> one point


def test_deflate_and_missing_index_years(spark):
    cpi = spark.createDataFrame([(2020, 100.0), (2022, 0.0), (2023, 110.0)], "year int, value double")
    df = spark.createDataFrame([(1, 10.0, 2019), (2, 10.0, 2022), (3, 10.0, 2030), (4, None, 2021)],
                               "id int, p double, y int")
    got = {r.id: r.real for r in deflate(df, cpi, 2023, "p", "y").collect()}
    assert got[1] is None and got[2] is None and abs(got[3] - 10.0) < 1e-12 and got[4] is None
    nominal = {r.id: r.real for r in deflate(df, cpi, 2023, "p", "y", on_missing="nominal").collect()}
    assert nominal[1] == 10.0 and nominal[2] == 10.0


def test_history_rows_gap(spark):
    pts = spark.createDataFrame([(1, D(2023, 8, 1), 10.0), (1, D(2023, 10, 1), 11.0), (1, D(2023, 11, 1), 12.0)],
                                "item_id int, date date, price double").withColumn("real", F.col("price"))
    rows = {r.months_ahead: r for r in history_rows(pts, "2024-01-01", 36).collect()}
    assert set(rows) == {-2}                 # Oct has no predecessor within 45 days; Nov follows Oct


def test_year_with_few_prices(spark):
    pts = [(D(y, 6, 1), v) for y, vs in ((2020, (9, 10, 11)), (2021, (11, 12, 13)), (2022, (13, 14, 15)),
                                            (2023, (100, 200))) for v in vs]
    df = spark.createDataFrame([(d, float(v)) for d, v in pts], "date date, real double")
    r = trend_projection(df, "2025-01-01", "2025-01-31").first()
    assert abs(r.projection - 20.083333) < 1e-6                                      # 2023 ignored (2 points)


def test_match_ties(spark):
    left = spark.createDataFrame([(1, "zelda one", "P1")], "item_id int, title string, platform string")
    right = spark.createDataFrame([("zelda onf", "P1", 20, 1.0), ("zelda onx", "P1", 10, 2.0)],
                                  "title string, platform string, seq int, units double")
    m = match_titles(left, right, payload=["units"]).first()
    assert m.match_type == "fuzzy" and m.units == 2.0                                # equal score: first in order
    meta = spark.createDataFrame([(30, "Zelda One", "P1", 1, 2000, 1990, 2010), (20, "zelda one", "P1", 1, 2000, 1990, 2010)],
                                 "id int, name string, platform string, category int, year int, year_lo int, year_hi int")
    c = containment_match(left, meta).first()
    assert c.match_id == 20 and c.match_score == 1.0                                 # same bucket: lowest id
