"""Franchise cadence and competition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import log_units, rnd, rnd_sql
from pricelens.operators.competition import competition_features
from pricelens.operators.franchise import franchise_features
from pricelens.plans import views as V
from pricelens.plans.registry import register

_FRAN_SQL = """
    SELECT item_id, max(cnt) AS franchise_entry_count,
           min((year - prev_y) * 365) AS days_since_last_franchise_release,
           min((next_y - year) * 365) AS days_until_next_franchise_release,
           max(in_w) AS franchise_releases_in_2yr_window
    FROM (SELECT item_id, fid, year,
                 count(item_id) OVER (PARTITION BY fid) AS cnt,
                 lag(year) OVER (PARTITION BY fid ORDER BY year, item_id) AS prev_y,
                 lead(year) OVER (PARTITION BY fid ORDER BY year, item_id) AS next_y,
                 count(*) OVER (PARTITION BY fid ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS in_w
          FROM (SELECT item_id, trim(f) AS fid, CAST(release_year AS DOUBLE) AS year
                FROM items, unnest(string_split(franchise_ids, '|')) t(f)) r
          WHERE fid <> '' AND fid <> 'nan' AND year IS NOT NULL AND item_id IS NOT NULL) x
    GROUP BY item_id"""


@register("franchise_features", headline=True, oracle=lambda: V.with_views(_FRAN_SQL),
          covers=("E1", "E2", "E3", "E4", "E5", "D7", "L16", "H5", "J8"))
def franchise_query(spark, sf_dir):
    return franchise_features(V.Panel(spark, sf_dir).items)


def items_with_units(p: V.Panel):
    u = p.units.select("item_id", F.coalesce("units_na", "units_global").alias("units_best"))
    return p.items.join(u, "item_id", "left")


_COMP_SQL = f"""
    SELECT i.item_id,
           CASE WHEN i.release_year IS NOT NULL AND i.genre IS NOT NULL THEN
             (SELECT max(j.units_best) FROM iu j WHERE j.genre = i.genre AND j.platform = i.platform
                AND j.release_year BETWEEN i.release_year - 1 AND i.release_year + 1 AND j.item_id <> i.item_id) END
             AS same_genre_same_platform_top_units_in_window,
           CASE WHEN i.release_year IS NOT NULL AND i.genre IS NOT NULL THEN
             (SELECT count(*) FROM iu j WHERE j.genre = i.genre AND j.platform = i.platform
                AND j.release_year BETWEEN i.release_year - 1 AND i.release_year + 1 AND j.item_id <> i.item_id) END
             AS same_genre_same_platform_release_count_in_window,
           CASE WHEN i.release_year IS NOT NULL AND i.genre IS NOT NULL THEN
             (SELECT max(j.units_best) FROM iu j WHERE j.genre = i.genre AND j.platform <> i.platform
                AND j.release_year BETWEEN i.release_year - 1 AND i.release_year + 1) END
             AS same_genre_cross_platform_top_units_in_window
    FROM iu i"""


@register("competition", headline=True, covers=("C7", "C8", "F3", "L15", "J2", "J3"),
          oracle=lambda: V.with_views(f"""
    SELECT c.*, CASE WHEN c.same_genre_same_platform_top_units_in_window > 0 AND iu.units_best IS NOT NULL
                      AND iu.units_best / c.same_genre_same_platform_top_units_in_window <> 0
                THEN {rnd_sql('iu.units_best / c.same_genre_same_platform_top_units_in_window', 4)} END
                AS units_sold_vs_top_competitor
    FROM comp c JOIN iu ON c.item_id = iu.item_id""",
    ("iu", """SELECT i.*, coalesce(u.units_na, u.units_global) AS units_best
              FROM items i LEFT JOIN units u ON i.item_id = u.item_id"""), ("comp", _COMP_SQL)))
def competition_query(spark, sf_dir):
    return competition_features(items_with_units(V.Panel(spark, sf_dir)))


@register("units_log", covers=("J2",),
          oracle=lambda: V.with_views(f"""
    SELECT item_id, {rnd_sql('ln(1 + coalesce(units_na, units_global) * 1e6)', 6)} AS units_sold_log FROM units"""))
def units_log_query(spark, sf_dir):
    u = V.Panel(spark, sf_dir).units
    return u.select("item_id", rnd(log_units("units_na", "units_global"), 6).alias("units_sold_log"))
