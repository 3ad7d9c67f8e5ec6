"""Franchise release-cadence features.

A franchise may hold a large share of all items, so nothing here windows over
a franchise's item rows.  Items are first counted per (franchise, year); the
windows (previous / next release year, +-2 year range count, entry count) run
over that table, whose size per franchise is bounded by the number of calendar
years; the result is joined back on (franchise, year).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.text import split_list

DAYS_PER_YEAR_GAP = 365


def franchise_rows(items: DataFrame, key: str = "item_id", ids: str = "franchise_ids",
                   year: str = "release_year") -> DataFrame:
    """One row per (item, franchise): ids split on ``|``, trimmed, empty and
    ``nan`` dropped; rows without a numeric year or item key dropped."""
    y = F.col(year).cast("string").try_cast("double")
    return (items.select(key, F.explode(split_list(ids)).alias("franchise_id"), y.alias("_year"))
            .where(F.col(key).isNotNull() & F.col("_year").isNotNull() & ~F.isnan("_year"))
            .select(key, "franchise_id", F.col("_year").alias("year")))


def franchise_features(items: DataFrame, key: str = "item_id", window_years: int = 2) -> DataFrame:
    rows = franchise_rows(items, key)
    per_year = rows.groupBy("franchise_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    wf = Window.partitionBy("franchise_id")
    wo = wf.orderBy("year")
    stats = (per_year
             .withColumn("entry_count", F.sum("n").over(wf))
             .withColumn("prev_year", F.lag("year").over(wo))
             .withColumn("next_year", F.lead("year").over(wo))
             .withColumn("in_window", F.sum("n").over(wo.rangeBetween(-window_years, window_years)) - 1))
    j = rows.join(stats, ["franchise_id", "year"])
    # Within a year, items are ordered by key: all but the first have a
    # same-year predecessor (gap 0), all but the last a same-year successor.
    since = F.when(F.col(key) > F.col("first_id"), F.lit(0.0)) \
             .otherwise((F.col("year") - F.col("prev_year")) * DAYS_PER_YEAR_GAP)
    until = F.when(F.col(key) < F.col("last_id"), F.lit(0.0)) \
             .otherwise((F.col("next_year") - F.col("year")) * DAYS_PER_YEAR_GAP)
    return j.groupBy(key).agg(
        F.max("entry_count").alias("franchise_entry_count"),
        F.min(since).alias("days_since_last_franchise_release"),
        F.min(until).alias("days_until_next_franchise_release"),
        F.max("in_window").alias("franchise_releases_in_2yr_window"),
    )
