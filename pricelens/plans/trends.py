"""Price-trend queries: inflation-adjusted series features per item."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import DataFrame

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.operators.asof import deflate
from pricelens.operators.features import (
    annual_means, first_target, latest_real_price, market_index, monthly_targets,
    price_vs_market, prices_near_offsets, yearly_trend)
from pricelens.operators.aggregates import group_median
from pricelens.operators.series import window_features, window_features_sql
from pricelens.plans import views as V
from pricelens.plans.registry import register


def real_monthly_panel(p: V.Panel, until: str | None = None, after: str | None = None):
    """Monthly panel (month starts in (after, until]) deflated to reference-year
    money (as-of index lookup)."""
    return deflate(p.panel_between(after, until), p.cpi, V.CPI_REF_YEAR, "price", F.year("date"))


_REAL_PANEL_SQL = f"""
    SELECT m.item_id, m.date, m.price,
           m.price * (SELECT value FROM cpi WHERE year = {V.CPI_REF_YEAR}) / c.value AS real
    FROM (SELECT *, CAST(year(date) AS INTEGER) AS _y FROM panel_m) m
    ASOF LEFT JOIN cpi c ON m._y >= c.year"""


def _offset_sql(months: int) -> str:
    """Nearest real price to Jan 1 of release year + months (<= 91 days)."""
    return f"""
        SELECT item_id, {rnd_sql('arg_min(real, struct_pack(d := diff, t := date))', 2)} AS v FROM (
          SELECT r.item_id, r.date, r.real, abs(r.date - t.target) AS diff
          FROM real_panel r JOIN (
             SELECT item_id, CAST(make_date(release_year, 1, 1) + INTERVAL {months} MONTH AS DATE) AS target
             FROM items WHERE release_year IS NOT NULL) t ON r.item_id = t.item_id
          WHERE t.target <= DATE '{V.CUTOFF}' AND r.date <= DATE '{V.CUTOFF}'
            AND r.price > 0 AND r.real IS NOT NULL) x
        WHERE diff <= 91 GROUP BY item_id"""


def _trends_sql() -> str:
    return V.with_views(window_features_sql("real_panel", V.CUTOFF), ("real_panel", _REAL_PANEL_SQL))


@register("real_price_trends", oracle=_trends_sql, headline=True,
          covers=("C6", "C5", "B6", "B7", "B8", "L1", "L2", "L3", "L4", "L5", "L6", "L7",
                  "E6", "E7", "D17", "D18", "I3", "I6", "J3"))
def real_price_trends(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    return window_features(real_monthly_panel(p, p.scope.cutoff), p.scope.cutoff)


# ----------------------------------------------------------------- yearly view
def annual_real(p: V.Panel) -> DataFrame:
    """Real annual prices up to the cutoff; computed once in a composite job."""
    return p._shared("annual_real", lambda: _annual_real(p))


def _annual_real(p: V.Panel) -> DataFrame:
    ann = annual_means(p.panel_between(until=p.scope.cutoff), None)
    real = deflate(ann, p.cpi, V.CPI_REF_YEAR, "mean_price", "year", out="real_price")
    return real.where(F.col("real_price").isNotNull())


_ANNUAL_SQL = f"""
    SELECT a.item_id, a.year, a.mean_price,
           a.mean_price * (SELECT value FROM cpi WHERE year = {V.CPI_REF_YEAR}) / c.value AS real_price
    FROM (SELECT item_id, CAST(year(date) AS INTEGER) AS year, avg(price) AS mean_price
          FROM panel_m WHERE date <= DATE '{V.CUTOFF}' GROUP BY 1, 2) a
    ASOF JOIN cpi c ON a.year >= c.year"""


@register("annual_real_prices", covers=("D2", "C6", "H7", "B7"),
          oracle=lambda: V.with_views(
              f"SELECT item_id, year, {rnd_sql('mean_price', 4)} AS mean_price, "
              f"{rnd_sql('real_price', 4)} AS real_price FROM annual WHERE real_price IS NOT NULL",
              ("annual", _ANNUAL_SQL)))
def annual_real_prices(spark, sf_dir):
    a = annual_real(V.Panel(spark, sf_dir))
    return a.select("item_id", "year", rnd("mean_price", 4).alias("mean_price"), rnd("real_price", 4).alias("real_price"))


@register("market_index", covers=("D5", "C6"),
          oracle=lambda: V.with_views(
              f"SELECT year, {rnd_sql('median(real_price)', 4)} AS market_index FROM annual "
              f"WHERE real_price IS NOT NULL GROUP BY year", ("annual", _ANNUAL_SQL)))
def market_index_query(spark, sf_dir):
    m = market_index(annual_real(V.Panel(spark, sf_dir)))
    return m.select("year", rnd("market_index", 4).alias("market_index"))


@register("price_vs_market", headline=True, covers=("D8", "L11", "D5", "C6"),
          oracle=lambda: V.with_views(
              f"""SELECT a.item_id, {rnd_sql('avg(a.real_price / m.mi)', 4)} AS price_vs_market_mean
                  FROM annual a JOIN (SELECT year, median(real_price) AS mi FROM annual
                                      WHERE real_price IS NOT NULL GROUP BY year) m ON a.year = m.year
                  WHERE m.mi > 0 AND a.real_price IS NOT NULL GROUP BY a.item_id""",
              ("annual", _ANNUAL_SQL)))
def price_vs_market_query(spark, sf_dir):
    a = annual_real(V.Panel(spark, sf_dir))
    return price_vs_market(a, market_index(a))


@register("yearly_trend", covers=("L18", "D2", "D17", "D18"),
          oracle=lambda: V.with_views(
              f"""SELECT item_id,
                   CASE WHEN count(real_price) >= 3 THEN {rnd_sql('regr_slope(real_price, CAST(year AS DOUBLE))', 4)} END AS yearly_velocity,
                   CASE WHEN count(real_price) >= 2 THEN {rnd_sql('stddev_pop(real_price)', 4)} END AS yearly_volatility
                  FROM annual WHERE real_price IS NOT NULL GROUP BY item_id""",
              ("annual", _ANNUAL_SQL)))
def yearly_trend_query(spark, sf_dir):
    return yearly_trend(annual_real(V.Panel(spark, sf_dir)))


# ------------------------------------------------------ release-anchored view
REFERENCE_YEAR = V.CPI_REF_YEAR


@register("release_prices", headline=True, covers=("L8", "F5", "L9", "L10", "B11", "C5", "C6", "I7", "I3", "I6"),
          oracle=lambda: V.with_views(f"""
    SELECT i.item_id, o12.v AS real_price_at_12m, o60.v AS real_price_at_60m,
           {rnd_sql('pm.real_msrp', 4)} AS real_msrp,
           CASE WHEN o60.v IS NOT NULL AND pm.real_msrp > 0 THEN {rnd_sql('o60.v / pm.real_msrp', 4)} END AS real_msrp_ratio,
           (CASE WHEN i.release_year IS NOT NULL THEN ({REFERENCE_YEAR} - i.release_year) * 12 END) AS months_since_release,
           (CASE WHEN pm.discontinued_year IS NOT NULL THEN ({REFERENCE_YEAR} - pm.discontinued_year) * 12 END) AS months_since_discontinued
    FROM items i
    LEFT JOIN (SELECT d.platform, d.discontinued_year,
                      d.msrp * (SELECT value FROM cpi WHERE year = {V.CPI_REF_YEAR}) / c.value AS real_msrp
               FROM platform_dim d ASOF LEFT JOIN cpi c ON d.launch_year >= c.year) pm ON i.platform = pm.platform
    LEFT JOIN ({_offset_sql(12)}) o12 ON i.item_id = o12.item_id
    LEFT JOIN ({_offset_sql(60)}) o60 ON i.item_id = o60.item_id""", ("real_panel", _REAL_PANEL_SQL)))
def release_prices(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    it = p.items
    cutoff = p.scope.cutoff
    near = prices_near_offsets(real_monthly_panel(p, cutoff), it, {12: "real_price_at_12m", 60: "real_price_at_60m"}, cutoff)
    pm = deflate(p.platform_dim, p.cpi, V.CPI_REF_YEAR, "msrp", "launch_year", out="real_msrp") \
        .select("platform", "discontinued_year", "real_msrp")
    out = (it.join(F.broadcast(pm), "platform", "left")
           .join(near, "item_id", "left"))
    return out.select(
        "item_id", "real_price_at_12m", "real_price_at_60m", rnd("real_msrp", 4).alias("real_msrp"),
        F.when(F.col("real_price_at_60m").isNotNull() & (F.col("real_msrp") > 0),
               rnd(F.col("real_price_at_60m") / F.col("real_msrp"), 4)).alias("real_msrp_ratio"),
        ((F.lit(REFERENCE_YEAR) - F.col("release_year")) * 12).alias("months_since_release"),
        ((F.lit(REFERENCE_YEAR) - F.col("discontinued_year")) * 12).alias("months_since_discontinued"),
    )


# ---------------------------------------------------- current price and genre
@register("current_vs_genre", headline=True, covers=("L13", "D6", "C4", "L14", "L19", "F8", "J3"),
          oracle=lambda: V.with_views(f"""
    SELECT i.item_id, i.genre, coalesce(i.publisher, 'Unknown') AS publisher,
           c.current_real_price, g.genre_median_price,
           CASE WHEN c.current_real_price IS NOT NULL AND g.genre_median_price > 0
                THEN {rnd_sql('c.current_real_price / g.genre_median_price', 4)} END AS price_vs_genre
    FROM items i
    LEFT JOIN cur c ON i.item_id = c.item_id
    LEFT JOIN (SELECT i2.genre, median(c2.current_real_price) AS genre_median_price
               FROM items i2 JOIN cur c2 ON i2.item_id = c2.item_id
               WHERE i2.genre IS NOT NULL GROUP BY i2.genre) g ON i.genre = g.genre""",
    ("real_panel", _REAL_PANEL_SQL),
    ("cur", f"""SELECT item_id, CASE WHEN r <> 0 THEN r END AS current_real_price FROM (
                  SELECT item_id, {rnd_sql('arg_max(coalesce(real, 0.0), date)', 2)} AS r
                  FROM real_panel WHERE date <= DATE '{V.CUTOFF}' GROUP BY item_id) x""")))
def current_vs_genre(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    cur = latest_real_price(real_monthly_panel(p, p.scope.cutoff), p.scope.cutoff)
    it = p.items.select("item_id", "genre", F.coalesce("publisher", F.lit("Unknown")).alias("publisher"))
    with_cur = it.join(cur, "item_id", "left")
    med = group_median(with_cur.where(F.col("genre").isNotNull()), ["genre"], "current_real_price",
                       out="genre_median_price")
    # one row per genre: AQE broadcasts it at run time when it is small and
    # keeps a shuffle join otherwise (genres are data, not a fixed list)
    out = with_cur.join(med, "genre", "left")
    return out.select(
        "item_id", "genre", "publisher", "current_real_price", "genre_median_price",
        F.when(F.col("current_real_price").isNotNull() & (F.col("genre_median_price") > 0),
               rnd(F.col("current_real_price") / F.col("genre_median_price"), 4)).alias("price_vs_genre"))


# ------------------------------------------------------------------- targets
_TARGETS_SQL = f"""
    SELECT item_id, strftime(date, '%Y-%m') AS month, {rnd_sql('real', 2)} AS real_price
    FROM real_panel
    WHERE price > 0 AND real IS NOT NULL
      AND date >= DATE '{int(V.CUTOFF[:4]) + 1}-01-01' AND date <= DATE '{V.TEST_END}'
      AND day(date) = 1"""


@register("monthly_targets", covers=("L17", "K9", "I4", "C6", "B9"),
          oracle=lambda: V.with_views("SELECT * FROM targets", ("real_panel", _REAL_PANEL_SQL),
                                      ("targets", _TARGETS_SQL)))
def monthly_targets_query(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    return monthly_targets(real_monthly_panel(p, V.TEST_END, after=V.CUTOFF), V.CUTOFF, V.TEST_END)


@register("target_summary", covers=("K10", "L17", "D15", "B9", "C6"),
          oracle=lambda: V.with_views(f"""
    SELECT coalesce(f.item_id, t.item_id) AS item_id, f.target_real_price, t.target_price FROM
      (SELECT item_id, arg_min(real_price, month) AS target_real_price FROM targets GROUP BY item_id) f
    FULL OUTER JOIN
      (SELECT item_id, {rnd_sql('avg(real_y)', 2)} AS target_price FROM (
          SELECT a.item_id, a.mean_price * (SELECT value FROM cpi WHERE year = {V.CPI_REF_YEAR}) / c.value AS real_y
          FROM (SELECT item_id, CAST(year(date) AS INTEGER) AS y, avg(price) AS mean_price FROM panel_m
                WHERE date > DATE '{V.CUTOFF}' AND date <= DATE '{V.TEST_END}' AND price > 0 GROUP BY 1, 2) a
          ASOF JOIN cpi c ON a.y >= c.year) z
       WHERE real_y IS NOT NULL GROUP BY item_id) t
    ON f.item_id = t.item_id""", ("real_panel", _REAL_PANEL_SQL), ("targets", _TARGETS_SQL)))
def target_summary(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    cutoff = p.scope.cutoff
    first = first_target(monthly_targets(real_monthly_panel(p, V.TEST_END, after=cutoff), cutoff, V.TEST_END))
    post = p.panel_between(cutoff, V.TEST_END).where(F.col("price") > 0)
    yearly = deflate(annual_means(post, None), p.cpi, V.CPI_REF_YEAR, "mean_price", "year", out="real_y")
    tp = yearly.where(F.col("real_y").isNotNull()).groupBy("item_id").agg(rnd(F.avg("real_y"), 2).alias("target_price"))
    return first.join(tp, "item_id", "full")


YEAR_END_YEARS = (1999, 2000, 2001)


@register("year_end_prices", covers=("D16", "C6"),
          oracle=lambda: V.with_views(f"""
    SELECT i.item_id, y.year,
           {rnd_sql('ye.price * (SELECT value FROM cpi WHERE year = ' + str(V.CPI_REF_YEAR) + ') / c.value', 2)} AS year_end_price
    FROM items i CROSS JOIN (VALUES {', '.join(f'({y})' for y in YEAR_END_YEARS)}) y(year)
    LEFT JOIN (SELECT item_id, CAST(year(date) AS INTEGER) AS yr, arg_max(price, month(date)) AS price
               FROM panel_m WHERE price > 0 AND month(date) IN (10, 11, 12) GROUP BY 1, 2) ye
      ON ye.item_id = i.item_id AND ye.yr = y.year
    ASOF LEFT JOIN cpi c ON y.year >= c.year"""))
def year_end_prices(spark, sf_dir):
    """December price, else November, else October, per requested year."""
    p = V.Panel(spark, sf_dir)
    q4 = p.panel_m.where((F.col("price") > 0) & F.month("date").isin(10, 11, 12))
    ye = q4.groupBy("item_id", F.year("date").alias("year")).agg(F.max_by("price", F.month("date")).alias("price"))
    ye = ye.where(F.col("year").isin(*YEAR_END_YEARS))
    real = deflate(ye, p.cpi, V.CPI_REF_YEAR, "price", "year", out="real")
    # every item gets one row per requested year: the year list is a fixed
    # parameter, so the grid is items x len(years), generated by explode.
    grid = p.items.select("item_id", F.explode(F.array(*[F.lit(y) for y in YEAR_END_YEARS])).alias("year"))
    return grid.join(real, ["item_id", "year"], "left").select("item_id", "year", rnd("real", 2).alias("year_end_price"))


YEAR_OFFSETS = (0, 1, 2, 5)


@register("price_at_year_offset", covers=("K12", "D2", "C6"),
          oracle=lambda: V.with_views(f"""
    SELECT i.item_id, o.off AS year_offset, {rnd_sql('a.real_price', 4)} AS real_price
    FROM items i CROSS JOIN (VALUES {', '.join(f'({o})' for o in YEAR_OFFSETS)}) o(off)
    LEFT JOIN (SELECT * FROM annual WHERE real_price IS NOT NULL) a
      ON a.item_id = i.item_id AND a.year = i.release_year + o.off
    WHERE i.release_year IS NOT NULL""", ("annual", _ANNUAL_SQL)))
def price_at_year_offset(spark, sf_dir):
    """Real annual price at release year + offset (equi-join on the target
    year; the offsets are a fixed parameter list exploded per item)."""
    p = V.Panel(spark, sf_dir)
    a = annual_real(p).select("item_id", "year", "real_price")
    it = p.items.where(F.col("release_year").isNotNull()).select(
        "item_id", "release_year", F.explode(F.array(*[F.lit(o) for o in YEAR_OFFSETS])).alias("year_offset"))
    it = it.withColumn("year", F.col("release_year") + F.col("year_offset"))
    return it.join(a, ["item_id", "year"], "left").select("item_id", "year_offset", rnd("real_price", 4).alias("real_price"))


@register("landed_dates", covers=("I1", "H7"),
          oracle="""
    SELECT l_partkey AS item_id, count(TRY_CAST(t AS DATE)) AS n_parsed, count(*) - count(TRY_CAST(t AS DATE)) AS n_rejected,
           min(TRY_CAST(t AS DATE)) AS first_date
    FROM (SELECT l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%d/%m/%Y')
                                 ELSE strftime(l_shipdate, '%Y-%m-%d') END AS t FROM lineitem) x
    GROUP BY 1""")
def landed_dates(spark, sf_dir):
    """Coercing parse of landed text dates: text that is not an ISO date
    becomes NULL instead of failing the job (landed text derived by Spark
    from the ship dates, every third line in day/month/year form)."""
    from pricelens.functions.dates import to_date_safe
    li = V.Panel(spark, sf_dir).table("lineitem")
    txt = F.when(F.col("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")) \
           .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    d = li.select(F.col("l_partkey").alias("item_id"), to_date_safe(txt).alias("d"))
    return d.groupBy("item_id").agg(F.count("d").alias("n_parsed"),
                                    (F.count(F.lit(1)) - F.count("d")).alias("n_rejected"),
                                    F.min("d").alias("first_date"))


ROLLING = (3, 6, 12)


def _rolling_sql() -> str:
    cols = []
    for n in ROLLING:
        w = f"OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols += [f"CASE WHEN count(price) {w} >= 2 THEN {rnd_sql(f'regr_slope(price, pos) {w} * 12', 4)} END AS slope_last_{n}",
                 f"CASE WHEN count(price) {w} >= 2 THEN {rnd_sql(f'stddev_pop(price) {w}', 4)} END AS std_last_{n}"]
    return f"""SELECT item_id, date, {', '.join(cols)} FROM (
        SELECT item_id, date, price, CAST(row_number() OVER (PARTITION BY item_id ORDER BY date) AS DOUBLE) AS pos
        FROM panel_m WHERE price IS NOT NULL) x"""


@register("rolling_slices", covers=("E12", "N5", "D17", "D18"), oracle=lambda: V.with_views(_rolling_sql()))
def rolling_slices_query(spark, sf_dir):
    """Slope and deviation of the last 3, 6 and 12 monthly prices at every point."""
    from pricelens.operators.series import rolling_slices
    return rolling_slices(V.Panel(spark, sf_dir).panel_m, ROLLING)
