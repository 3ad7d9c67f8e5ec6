"""Hand-computed cases (FIXTURES.md §2)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import approx
from pricelens.functions import (
    classify_variant, containment_score, corrected_release_year, is_hardware, key_words,
    log_return, log_units, normalize_folded, normalize_plain, parse_price_map, parse_units,
    relation_type, valid_rerelease)
from pricelens.operators.asof import deflate
from pricelens.operators.competition import competition_features
from pricelens.operators.franchise import franchise_features
from pricelens.operators.series import window_features


def test_cpi_asof(spark):
    cpi = spark.createDataFrame([(2021, 270.0), (2022, 290.0), (2024, 310.0), (2025, 320.0)], "year int, value double")
    df = spark.createDataFrame([(1, 100.0, 2021), (2, 100.0, 2023), (3, 50.0, 2026), (4, 100.0, 2020)],
                               "id int, price double, year int")
    got = {r.id: r.real for r in deflate(df, cpi, 2025, "price", "year").collect()}
    assert approx(got[1], 118.518519) and approx(got[2], 110.344828) and approx(got[3], 50.0)
    assert got[4] is None
    nom = {r.id: r.real for r in deflate(df, cpi, 2025, "price", "year", on_missing="nominal").collect()}
    assert nom[4] == 100.0


def test_series_features(spark):
    pts = [(1, dt.date(2023, 9, 1), 10.0), (1, dt.date(2023, 10, 1), 12.0),
           (1, dt.date(2023, 11, 1), 11.0), (1, dt.date(2023, 12, 1), 15.0)]
    df = spark.createDataFrame(pts, "item_id int, date date, real double")
    r = window_features(df, "2023-12-31").collect()[0].asDict()
    assert r["price_velocity_1m"] is None and r["price_volatility_1m"] is None and r["price_change_1m"] is None
    assert approx(r["price_velocity_3m"], 17.7979, 1e-4)
    assert approx(r["price_volatility_3m"], 1.5, 1e-4)
    assert approx(r["price_change_3m"], 3.0) and approx(r["price_pct_change_3m"], 0.25)
    assert approx(r["price_velocity_6m"], 16.7568, 1e-4)
    assert approx(r["price_volatility_6m"], 1.2472, 1e-4)
    assert approx(r["price_pct_change_6m"], 0.5)
    assert approx(r["price_acceleration"], 24.35, 1e-2)
    assert approx(r["price_vs_52w_high"], 1.0) and approx(r["price_vs_52w_low"], 1.5)


def test_franchise(spark):
    items = spark.createDataFrame([(1, "F1", 2000), (2, "F1", 2001), (3, "F1", 2004)],
                                  "item_id int, franchise_ids string, release_year int")
    got = {r[0]: tuple(r[1:]) for r in franchise_features(items).collect()}
    assert got[1] == (3, None, 365.0, 1)
    assert got[2] == (3, 365.0, 1095.0, 1)
    assert got[3] == (3, 1095.0, None, 0)


def test_franchise_ties_and_edges(spark):
    items = spark.createDataFrame([(1, "F1| nan |", 2000), (2, "F1", 2000), (3, "F1", None), (None, "F1", 2001)],
                                  "item_id int, franchise_ids string, release_year int")
    got = {r[0]: tuple(r[1:]) for r in franchise_features(items).collect()}
    # ties ordered by key: item 1 first (no predecessor), item 2 after it (gap 0)
    assert got[1] == (2, None, 0.0, 1)
    assert got[2] == (2, 0.0, None, 1)
    assert 3 not in got


def test_competition(spark):
    items = spark.createDataFrame(
        [(1, "RPG", "P1", 2005, 2.0), (2, "RPG", "P1", 2006, 4.0), (3, "RPG", "P1", 2008, 9.0),
         (4, "RPG", "P2", 2005, 5.0), (5, None, "P1", 2005, 1.0)],
        "item_id int, genre string, platform string, release_year int, units_best double")
    got = {r[0]: tuple(r[1:]) for r in competition_features(items).collect()}
    assert got[1] == (4.0, 1, 5.0, 0.5)
    assert got[2] == (2.0, 1, 5.0, 2.0)
    assert got[3] == (None, 0, None, None)
    assert got[4] == (None, 0, 4.0, None)
    assert got[5] == (None, None, None, None)


def test_scalars(spark):
    df = spark.createDataFrame([("Pokémon: Ruby!",)], "t string")
    r = df.select(normalize_folded("t").alias("a"), normalize_plain("t").alias("b")).first()
    assert r.a == "pokemon ruby" and r.b == "pok mon ruby"
    kw = spark.createDataFrame([("the legend of zelda", "zelda ii")], "a string, b string") \
        .select(key_words("a").alias("ka"), key_words("b").alias("kb"))
    r = kw.select(F.array_sort("ka").alias("ka"), containment_score("ka", "kb").alias("s"),
                  containment_score(F.array().cast("array<string>"), "kb").alias("e")).first()
    assert r.ka == ["legend", "zelda"] and r.s == 0.5 and r.e == 1.0


def test_units_and_tags(spark):
    u = spark.createDataFrame([("1.25m",), ("N/A",), ("<0.01",), ("—",), (None,)], "t string")
    assert [r.v for r in u.select(parse_units("t").alias("v")).collect()] == [1.25, None, None, None, None]
    h = spark.createDataFrame([("USB Charger",), ("Charger vs. Mario",), (None,), ("Game Boy Color - Red",),
                               ("Game Boy Color Games",)], "t string")
    assert [r.v for r in h.select(is_hardware(F.col("t")).alias("v")).collect()] == [True, False, False, True, False]
    v = spark.createDataFrame([("Zelda [Player's Choice]",), ("Backpack Hero",), ("Game [Red]",), ("Zelda",), (None,)], "t string")
    assert [r.v for r in v.select(classify_variant("t").alias("v")).collect()] == \
        ["budget_reprint", "bundle", "variant", "standard", "standard"]


def test_years_and_maths(spark):
    df = spark.createDataFrame([(2003, 2006), (2003, None), (2010, 2008), (None, None)], "y int, f int")
    assert [r.v for r in df.select(corrected_release_year("y", "f").alias("v")).collect()] == [2006, 2003, 2008, None]
    m = spark.createDataFrame([(None, 2.5, 15.0, 11.0)], "na double, g double, a double, b double") \
        .select(log_units("na", "g").alias("u"), log_return("a", "b").alias("r")).first()
    assert approx(m.u, 14.731802) and approx(m.r, 0.310155)


def test_nested(spark):
    df = spark.createDataFrame([("{'2010-01-01': 12.5}",), ("{}",), ("zzz",), ("",)], "s string")
    got = [r.m for r in df.select(parse_price_map("s").alias("m")).collect()]
    assert got[0] == {"2010-01-01": 12.5} and got[1] == {} and got[2] is None and got[3] is None
    rel = spark.createDataFrame([([], [3], [4])], "a array<bigint>, b array<bigint>, c array<bigint>")
    assert rel.select(relation_type("a", "b", "c").alias("t")).first().t == "remaster"
    rd = spark.createDataFrame([([(1000, 2, 21)], [21], 21)],
                               "rd array<struct<date:bigint,region:int,platform:int>>, pl array<bigint>, p int")
    assert rd.select(valid_rerelease("rd", "pl", "p").alias("v")).first().v is False


def test_trend_projection_fixture(spark):
    from pricelens.operators.forecast import trend_projection
    pts = [(dt.date(y, 6, 1), v) for y, base in ((2020, 10.0), (2021, 12.0), (2022, 14.0))
           for v in (base - 1, base, base + 1)]
    df = spark.createDataFrame(pts, "date date, real double")
    r = trend_projection(df, "2025-01-01", "2025-01-31").collect()
    assert len(r) == 1 and approx(r[0].projection, 20.083333)


def test_band_and_confidence(spark):
    from pricelens.functions.numeric import confidence_pct
    from pricelens.operators.forecast import price_band
    df = spark.createDataFrame([(100.0, 0.02, -0.03, 0.05, 4)], "p double, d double, lo double, hi double, m int")
    low, mid, high = price_band(F.col("p"), F.col("d"), F.col("lo"), F.col("hi"), F.col("m"))
    r = df.select(low.alias("l"), mid.alias("m"), high.alias("h")).first()
    assert approx(r.m, 102.020134) and approx(r.l, 94.176453) and approx(r.h, 110.517092)
    c = spark.createDataFrame([(9.0, 12.0, 15.0), (19.0, 18.0, 21.0), (35.0, 40.0, 45.0)], "l double, m double, h double")
    got = [r.c for r in c.select(confidence_pct(F.col("h") - F.col("l"), F.col("m")).alias("c")).collect()]
    assert got == [75.0, 94.4, 87.5]


def test_metrics_fixture(spark):
    from pricelens.operators.forecast import horizon_metrics
    rows = [(1, 10.0, 12.0, 9.0, 15.0, None), (2, 20.0, 18.0, 19.0, 21.0, None), (3, 40.0, 40.0, 35.0, 45.0, None)]
    df = spark.createDataFrame(rows, "months_ahead int, actual_price double, prediction double, lower_bound double, "
                                     "upper_bound double, last_known_price double")
    m = horizon_metrics(df, {"h": (1, 12)}, min_rows=1).first()
    assert approx(m.rmse, 1.63, 1e-9) and approx(m.r2, 0.983, 1e-9) and approx(m.mape_pct, 10.0)
    assert m.interval_coverage_80 == 1.0 and m.catalog_coverage_50pct == 1.0 and m.directional_accuracy is None
    assert horizon_metrics(df, {"h": (1, 12)}).count() == 0        # fewer than 10 rows -> no report
