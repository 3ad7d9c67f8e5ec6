"""Per-item price features beyond the trailing windows: yearly means, market
index, release-anchored prices, current price, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.dates import month_grid
from pricelens.functions.numeric import rnd
from pricelens.operators.aggregates import group_median


def annual_means(panel: DataFrame, cutoff: str | None, key: str = "item_id",
                 date: str = "date", value: str = "price") -> DataFrame:
    """Mean price per (item, calendar year) of points on or before ``cutoff``
    (all points, not only positive ones)."""
    p = panel if cutoff is None else panel.where(F.col(date) <= F.lit(cutoff).cast("date"))
    return p.groupBy(key, F.year(date).alias("year")).agg(F.avg(value).alias("mean_price"))


def market_index(annual_real: DataFrame, value: str = "real_price") -> DataFrame:
    """Median over items of the annual real price, per year."""
    return group_median(annual_real, ["year"], value, out="market_index", few_groups=True)     # calendar years


def price_vs_market(annual_real: DataFrame, market: DataFrame, key: str = "item_id",
                    value: str = "real_price", digits: int = 4) -> DataFrame:
    """Mean over an item's years of real price / market index (index > 0).
    The market table has one row per year: broadcast (size bound: calendar)."""
    j = annual_real.join(F.broadcast(market), "year", "inner").where(F.col("market_index") > 0)
    return j.groupBy(key).agg(rnd(F.avg(F.col(value) / F.col("market_index")), digits).alias("price_vs_market_mean"))


def prices_near_offsets(real_panel: DataFrame, items: DataFrame, offsets: dict[int, str], cutoff: str | None,
                        key: str = "item_id", date: str = "date", value: str = "real", max_days: int = 91) -> DataFrame:
    """For every offset (months -> output column) the real price of the point
    nearest to Jan 1 of the release year plus the months (within ``max_days``;
    earliest point on ties), rounded to 2.  NULL when the target lies after the
    cutoff or the release year is NULL.  One join and one aggregate for all
    offsets."""
    targets = {}
    for months in offsets:
        t = F.add_months(F.make_date(F.col("release_year"), F.lit(1), F.lit(1)), months)
        targets[months] = t if cutoff is None else F.when(t <= F.lit(cutoff).cast("date"), t)
    it = items.select(key, *[t.alias(f"_target_{m}") for m, t in targets.items()])
    pts = real_panel.where((F.col("price") > 0) & F.col(value).isNotNull())
    if cutoff is not None:
        pts = pts.where(F.col(date) <= F.lit(cutoff).cast("date"))
    j = pts.join(it.where(F.coalesce(*[f"_target_{m}" for m in offsets]).isNotNull()), key)
    diffs = {m: F.abs(F.datediff(F.col(date), F.col(f"_target_{m}"))) for m in offsets}
    near = {m: F.when(d <= max_days, F.struct(d.alias("d"), F.col(date).alias("t"))) for m, d in diffs.items()}
    return j.groupBy(key).agg(*[rnd(F.min_by(value, near[m]), 2).alias(out) for m, out in offsets.items()])


def latest_real_price(real_panel: DataFrame, cutoff: str | None, key: str = "item_id",
                      date: str = "date", value: str = "real", out: str = "current_real_price") -> DataFrame:
    """Real value of the latest point on or before the cutoff, rounded to 2;
    zero or missing -> NULL."""
    p = real_panel if cutoff is None else real_panel.where(F.col(date) <= F.lit(cutoff).cast("date"))
    last = F.max_by(F.coalesce(F.col(value), F.lit(0.0)), F.col(date))
    r = rnd(last, 2)
    return p.groupBy(key).agg(F.when(r != 0, r).alias(out))


def monthly_targets(real_panel: DataFrame, cutoff: str, test_end: str | None,
                    key: str = "item_id", date: str = "date", value: str = "real") -> DataFrame:
    """Real price at each month start after the cutoff year through the test end
    (default: December two years after the cutoff), positive points only,
    rounded to 2.  The month grid is generated once and joined (no per-item
    explode of a calendar)."""
    c = F.lit(cutoff).cast("date")
    start = F.make_date(F.year(c) + 1, F.lit(1), F.lit(1))
    end = F.lit(test_end).cast("date") if test_end else F.make_date(F.year(c) + 2, F.lit(12), F.lit(1))
    spark = real_panel.sparkSession
    grid = spark.range(1).select(F.explode(month_grid(start, end)).alias(date))
    pts = real_panel.where((F.col("price") > 0) & F.col(value).isNotNull())
    return (pts.join(F.broadcast(grid), date, "left_semi")
            .select(key, F.date_format(date, "yyyy-MM").alias("month"), rnd(value, 2).alias("real_price")))


def first_target(targets: DataFrame, key: str = "item_id") -> DataFrame:
    return targets.groupBy(key).agg(F.min_by("real_price", "month").alias("target_real_price"))


def yearly_trend(annual_real: DataFrame, key: str = "item_id", value: str = "real_price",
                 digits: int = 4) -> DataFrame:
    """Slope of real price over years (>= 3 years) and population std over
    years (>= 2 years)."""
    return annual_real.groupBy(key).agg(
        F.when(F.count(value) >= 3, rnd(F.regr_slope(value, F.col("year").cast("double")), digits)).alias("yearly_velocity"),
        F.when(F.count(value) >= 2, rnd(F.stddev_pop(value), digits)).alias("yearly_volatility"),
    )


