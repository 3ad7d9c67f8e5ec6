"""Cleaning, history building, classification and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.dates import corrected_release_year
from pricelens.functions.nested import series_to_text
from pricelens.functions.text import classify_variant, is_hardware, variant_flag

# Status markers written into `condition` by failed ingests.
SENTINEL_CONDITIONS = ["not_found", "no_data", "empty", "fetch_error"]


def drop_sentinels(points: DataFrame, condition: str = "condition") -> DataFrame:
    """Remove status rows; a NULL condition is kept."""
    return points.where(F.coalesce(~F.col(condition).isin(*SENTINEL_CONDITIONS), F.lit(True)))


def valid_points(points: DataFrame, key: str = "item_id") -> DataFrame:
    """Points of an item with a date and a price, without status rows."""
    return drop_sentinels(points).dropna(subset=["date", "price", key])      # dropna also drops NaN


def _canonical(items: DataFrame, platform_dim: DataFrame, key: str) -> DataFrame:
    """The canonical condition of every item's platform."""
    return items.select(key, "platform").join(
        F.broadcast(platform_dim.select("platform", "canonical_condition")), "platform", "left") \
        .select(key, "canonical_condition")


def per_date_points(points: DataFrame, items: DataFrame, platform_dim: DataFrame,
                    key: str = "item_id", order: str = "seq") -> DataFrame:
    """One row per (item, date) with any valid point: the platform's
    canonical condition, the number of canonical points ``n`` and the price
    of the last canonical point in ``order``.

    Points are reduced to one row per (item, date, condition) with a map-side
    combine first; the canonical condition is joined to that, so the rows of a
    hot item never meet raw in one join key."""
    daily = valid_points(points, key).groupBy(key, "date", "condition").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(rnd2("price"), F.col(order)).alias("_last"))
    # the items are the small side: held as a table, they spare a sort of all daily rows
    daily = daily.join(_canonical(items, platform_dim, key).hint("shuffle_hash"), key, "left")
    is_canon = F.coalesce(F.col("condition") == F.col("canonical_condition"), F.lit(False))
    return daily.groupBy(key, "canonical_condition", "date").agg(
        F.coalesce(F.sum(F.when(is_canon, F.col("_n"))), F.lit(0)).cast("long").alias("n"),
        F.max(F.when(is_canon, F.col("_last"))).alias("price"))


def record_counts(points: DataFrame, items: DataFrame, platform_dim: DataFrame, key: str = "item_id") -> DataFrame:
    """``price_record_count`` of :func:`build_price_history` without the history:
    the points are counted by item and condition on the map side, so neither
    their number nor that of their dates reaches a task."""
    counts = valid_points(points, key).groupBy(key, "condition").agg(F.count(F.lit(1)).alias("_n")) \
        .join(_canonical(items, platform_dim, key), key, "left")
    is_canon = F.col("condition") == F.col("canonical_condition")
    return counts.groupBy(key, "canonical_condition").agg(
        F.coalesce(F.sum(F.when(is_canon, F.col("_n"))), F.lit(0)).cast("long").alias("price_record_count"))


def counted_items(items: DataFrame, points: DataFrame, platform_dim: DataFrame, key: str = "item_id") -> DataFrame:
    """Items with ``first_sale_year`` (of any point) and the
    ``price_record_count`` of :func:`record_counts`, for items whose key stands
    on one platform only.

    The points are read once and combined to one row per item on the map side,
    with a count for each canonical condition (one value per platform at most
    reaches the driver); that row meets the items in one join, without a sort of
    either side for it."""
    names = sorted({r[0] for r in platform_dim.select("canonical_condition").collect()} - {None})
    valid = (F.coalesce(~F.col("condition").isin(*SENTINEL_CONDITIONS), F.lit(True))
             & F.col("date").isNotNull() & F.col("price").isNotNull() & ~F.isnan("price"))
    seen = points.groupBy(key).agg(
        F.year(F.min("date")).alias("first_sale_year"), F.count_if(valid).alias("_valid"),
        *[F.count_if(valid & (F.col("condition") == name)).alias(f"_n{i}") for i, name in enumerate(names)])
    out = items.join(F.broadcast(platform_dim.select("platform", "canonical_condition")), "platform", "left") \
        .join(seen.hint("shuffle_hash"), key, "left")
    canonical = F.coalesce(*[F.when(F.col("canonical_condition") == name, F.col(f"_n{i}")) for i, name in enumerate(names)], F.lit(0).cast("long"))
    # an item that stands twice counts its points twice
    times = F.count(F.lit(1)).over(Window.partitionBy(key))
    return out.select(*items.columns, "first_sale_year", F.when(F.col("_valid") > 0, canonical * times).alias("price_record_count"))


def canonical_daily(per_date: DataFrame, key: str = "item_id") -> DataFrame:
    """Canonical-condition price per (item, date)."""
    return per_date.where(F.col("n") > 0).select(key, "date", "price")


def build_price_history(per_date: DataFrame, key: str = "item_id") -> DataFrame:
    """Per item with at least one valid point: canonical condition of its
    platform, number of canonical points, and the date -> price history of
    canonical points (one value per date, every point counted).  Items
    without canonical points get count 0 and an empty history.  The history
    is bounded by the number of calendar dates, whatever the number of raw
    rows of a hot item."""
    has = F.col("n") > 0
    return per_date.groupBy(key, "canonical_condition").agg(
        F.sum("n").alias("price_record_count"),
        F.count_if(has).alias("history_dates"),
        F.min(F.when(has, F.col("date"))).alias("first_date"),
        F.max(F.when(has, F.col("date"))).alias("last_date"),
        series_to_text(F.collect_list(F.when(has, F.struct("date", "price")))).alias("price_history"),
    )


def rnd2(c):
    from pricelens.functions.numeric import rnd
    return rnd(c, 2)


def classify_items(items: DataFrame, first_sale: DataFrame | None = None, floor_year: int = 2005,
                   key: str = "item_id") -> DataFrame:
    """Hardware tag, variant class and corrected release year (by the column
    ``first_sale_year`` of ``first_sale`` or of the items themselves)."""
    out = items.withColumn("is_hardware", is_hardware(F.col("title"))) \
               .withColumn("variant_type", classify_variant(F.col("title"))) \
               .withColumn("is_variant", variant_flag(F.col("variant_type")))
    if first_sale is not None:
        out = out.join(first_sale, key, "left")
    if "first_sale_year" in out.columns:
        out = out.withColumn(
            "release_year", corrected_release_year("release_year", "first_sale_year", floor_year)).drop("first_sale_year")
    return out


# Fixed value: price records that an item needs.
MIN_RECORDS = 50


def exclusion_reason(min_records: int = MIN_RECORDS, hardware: str = "is_hardware", count: str = "price_record_count"):
    """First failing rule decides: hardware, then too few price records."""
    return (F.when(F.coalesce(F.col(hardware), F.lit(False)), F.lit("hardware"))
            .when(F.coalesce(F.col(count), F.lit(0)) < min_records, F.lit(f"fewer_than_{min_records}_price_records")))


def split_quarantine(df: DataFrame, min_records: int = MIN_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(included, excluded-with-reason) from one pass over the rows."""
    tagged = df.withColumn("exclusion_reason", exclusion_reason(min_records))
    return (tagged.where(F.col("exclusion_reason").isNull()).drop("exclusion_reason"),
            tagged.where(F.col("exclusion_reason").isNotNull()))


def hardware_breakdown(tagged: DataFrame, group: str = "platform") -> DataFrame:
    """Tagged rows per platform with the share of the platform total, largest
    first; platforms without tagged rows are omitted."""
    g = tagged.groupBy(group).agg(F.count_if(F.col("is_hardware")).alias("n_hardware"),
                                  F.count(F.lit(1)).alias("n_total"))
    return g.where(F.col("n_hardware") > 0).withColumn(
        "share", F.col("n_hardware") / F.col("n_total"))


def first_in_order(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key in an explicit order (deterministic
    replacement of "drop duplicates, keep first").  Expressed as an
    aggregate (min of a struct led by the order columns), so it combines
    map-side and a hot key never lands in a single task with all its rows."""
    cols = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)],
                       *[F.col(c) for c in cols])
    best = df.groupBy(*keys).agg(F.min(ordered).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in cols])


MATCH_RANK = {"exact": 0, "fuzzy": 1, "unmatched": 2}


def resolve_duplicate_histories(df: DataFrame, min_records: int, key: str = "item_id",
                                history: str = "price_history") -> DataFrame:
    """Among rows with at least ``min_records`` points whose histories are
    identical, keep the one lowest by (key, match rank, match score desc,
    title length); the others get ``exclusion_reason =
    'duplicate_price_history'``.  Decided per row.

    Grouping is an aggregate on (hash, history) -> (size, best row), so a
    history shared by very many rows is combined map-side."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for k, v in MATCH_RANK.items() for x in (F.lit(k), F.lit(v))]),
                                   F.col("match_type")), F.lit(3))
    order = F.struct(F.col(key).alias("k"), rank.alias("r"), (-F.coalesce(F.col("match_score"), F.lit(0.0))).alias("s"),
                     F.length("title").alias("l"))
    eligible = F.col(history).isNotNull() & (F.coalesce(F.col("price_record_count"), F.lit(0)) >= min_records)
    tagged = df.withColumn("_h", F.when(eligible, F.xxhash64(history))).withColumn("_o", order)
    groups = tagged.where(F.col("_h").isNotNull()).groupBy("_h", history).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_best"))
    j = tagged.join(groups, ["_h", history], "left")
    dup = (F.col("_n") > 1) & (F.col("_o") != F.col("_best"))
    return j.withColumn("exclusion_reason", F.when(dup, F.lit("duplicate_price_history"))) \
            .drop("_h", "_o", "_n", "_best")
