"""Competition set per item: peers of the same genre released within +-1
year, on the same platform (excluding the item) and on other platforms.

Never pairs items.  Units are pre-aggregated per (genre, platform, year) into
count, best value, the key holding it and the best value among the others;
each item then looks at 3 years x (its platform | every platform), a
fan-out bounded by the platform dimension, not by group sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd


def competition_features(items: DataFrame, key: str = "item_id", units: str = "units_best",
                         span: int = 1) -> DataFrame:
    base = items.select(key, "genre", "platform", F.col("release_year").alias("year"), units)
    eligible = base.where(F.col("year").isNotNull() & F.col("genre").isNotNull())
    g = ["genre", "platform", "year"]
    top = eligible.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(units).alias("top1"),
        F.max_by(key, F.struct(F.col(units), F.col(key))).alias("top1_id"))
    second = (eligible.join(top.select(*g, "top1_id"), g)
              .where(F.col(key) != F.col("top1_id"))
              .groupBy(*g).agg(F.max(units).alias("top2")))
    stats = top.join(second, g, "left")

    shifts = F.explode(F.sequence(F.col("year") - span, F.col("year") + span))
    probe = eligible.select(key, "genre", "platform", F.col("year").alias("own_year"), units,
                            shifts.alias("year"))
    # same platform: exclude self (count - 1 in the own year; best of others)
    same = probe.join(stats, ["genre", "platform", "year"])
    own_group = F.col("year") == F.col("own_year")
    best_other = F.when(own_group & (F.col("top1_id") == F.col(key)), F.col("top2")).otherwise(F.col("top1"))
    sp = same.groupBy(key).agg(
        F.max(best_other).alias("same_genre_same_platform_top_units_in_window"),
        (F.sum("n") - 1).alias("same_genre_same_platform_release_count_in_window"))
    # other platforms: join on (genre, year), keep platform <> own
    cross = probe.join(stats.select("genre", F.col("platform").alias("_p"), "year", "top1"), ["genre", "year"]) \
                 .where(F.col("_p") != F.col("platform"))
    cp = cross.groupBy(key).agg(F.max("top1").alias("same_genre_cross_platform_top_units_in_window"))

    out = base.join(sp, key, "left").join(cp, key, "left")
    eligible_row = F.col("year").isNotNull() & F.col("genre").isNotNull()
    top_sp = F.col("same_genre_same_platform_top_units_in_window")
    ratio = F.when((top_sp > 0) & F.col(units).isNotNull(), F.col(units) / top_sp)
    return out.select(
        key,
        top_sp.alias("same_genre_same_platform_top_units_in_window"),
        F.when(eligible_row, F.coalesce(F.col("same_genre_same_platform_release_count_in_window"), F.lit(0)))
         .alias("same_genre_same_platform_release_count_in_window"),
        "same_genre_cross_platform_top_units_in_window",
        F.when(ratio != 0, rnd(ratio, 4)).alias("units_sold_vs_top_competitor"),
    )
