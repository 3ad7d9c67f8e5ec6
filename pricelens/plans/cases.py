"""Cleaning queries over inputs in which every case occurs.

The driver's titles hold no accessory or edition words, its conditions no
status markers, and no two items share a price history.  These queries derive
titles, conditions and histories that do, by a rule on the row's own keys, so
each label and reason is met and checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.text import VARIANT_RULES, classify_variant, is_hardware, variant_flag
from pricelens.operators.cleaning import (
    SENTINEL_CONDITIONS, drop_sentinels, hardware_breakdown, resolve_duplicate_histories)
from pricelens.plans import views as V
from pricelens.plans.cleaning import _POINTS_SQL, _q, hardware_sql, points_with_seq, variant_sql
from pricelens.plans.registry import register

# Endings dealt to the items' titles in turn; more than half are plain.
ACCESSORIES = ["Wireless Controller", "Charger", "Charger vs. Thunder", "Charger vs Thunder", "Memory Card", "AC Adapter", "Link Cable",
               "Game Boy Color - Red", "Game Boy Color", "USB CHARGER", "Cabled", "New Nintendo 3DS"]
EDITIONS = [words[0].title() for _, words in VARIANT_RULES] + [words[-1].upper() for _, words in VARIANT_RULES] + ["[Red Cover]", "[]"]
ENDINGS = [*ACCESSORIES, *EDITIONS, *[""] * 29]


def _literals(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def ended_items(p: V.Panel):
    """Items whose titles end, in turn, with accessory words, edition words or nothing."""
    end = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.pmod("item_id", F.lit(len(ENDINGS))) + 1).cast("int"))
    return p.items.select("item_id", "platform", F.concat_ws(" ", "title", end).alias("title"))


_ENDED_SQL = f"""
    SELECT item_id, platform, title || ' ' || list_extract({_literals(ENDINGS)}, CAST(item_id % {len(ENDINGS)} + 1 AS INTEGER)) AS title
    FROM items"""


@register("title_tags", covers=("B3", "B4", "H9"), oracle=lambda: V.with_views(f"""
    SELECT item_id, {hardware_sql('title')} AS is_hardware, {variant_sql('title')} AS variant_type,
           {variant_sql('title')} <> 'standard' AS is_variant, length(title) AS title_length
    FROM ended""", ("ended", _ENDED_SQL)))
def title_tags(spark, sf_dir):
    """Accessory tag and edition class of titles in which every class occurs."""
    it = ended_items(V.Panel(spark, sf_dir))
    variant = classify_variant(F.col("title"))
    return it.select("item_id", is_hardware(F.col("title")).alias("is_hardware"), variant.alias("variant_type"),
                     variant_flag(variant).alias("is_variant"), F.length("title").cast("long").alias("title_length"))


@register("accessories_by_platform", covers=("D10", "B3"), oracle=lambda: V.with_views(f"""
    SELECT platform, n_hardware, n_total, n_hardware / n_total AS share FROM (
      SELECT platform, count(*) FILTER (WHERE {hardware_sql('title')}) AS n_hardware, count(*) AS n_total
      FROM ended GROUP BY platform) WHERE n_hardware > 0""", ("ended", _ENDED_SQL)))
def accessories_by_platform(spark, sf_dir):
    """Accessories per platform with their share, where there are any."""
    it = ended_items(V.Panel(spark, sf_dir)).withColumn("is_hardware", is_hardware(F.col("title")))
    return hardware_breakdown(it).orderBy(F.desc("n_hardware"), "platform")


_MARKS = [*SENTINEL_CONDITIONS, None]


@register("sentinel_points", covers=("B1", "B2", "D11"), oracle=lambda: V.with_views(f"""
    SELECT condition, count(*) AS n_points FROM (
      SELECT CASE WHEN item_id % 3 = 0 THEN list_extract([{', '.join(_q(m) if m else 'NULL' for m in _MARKS)}], CAST(seq % {len(_MARKS)} + 1 AS INTEGER))
                  ELSE condition END AS condition FROM pts)
    WHERE coalesce(condition NOT IN ({', '.join(_q(s) for s in SENTINEL_CONDITIONS)}), true)
    GROUP BY condition""", ("pts", _POINTS_SQL)))
def sentinel_points(spark, sf_dir):
    """Points per condition after status rows are dropped; a third of the items
    carries status markers and null conditions."""
    marks = F.array(*[F.lit(m).cast("string") for m in _MARKS])
    pts = points_with_seq(V.Panel(spark, sf_dir)).withColumn("condition", F.when(
        F.col("item_id") % 3 == 0, F.element_at(marks, (F.pmod("seq", F.lit(len(_MARKS))) + 1).cast("int"))).otherwise(F.col("condition")))
    return drop_sentinels(pts).groupBy("condition").agg(F.count(F.lit(1)).alias("n_points"))


@register("copied_histories", covers=("D20", "H9"), oracle=lambda: V.with_views(f"""
    WITH h AS (SELECT item_id - item_id % 2 AS pair, count(*) AS n,
                      string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS price_history
               FROM (SELECT DISTINCT item_id - item_id % 2 AS item_id, date FROM pts WHERE date IS NOT NULL) GROUP BY 1),
         t AS (SELECT i.item_id // 4 AS game_id, i.item_id AS row_id, h.price_history, h.n AS price_record_count,
                      struct_pack(k := i.item_id // 4, r := CAST(i.item_id % 4 AS INTEGER),
                                  s := -CAST(i.item_id % 7 AS DOUBLE), l := length(i.title)) AS o
               FROM items i JOIN h ON i.item_id - i.item_id % 2 = h.pair),
         g AS (SELECT price_history, count(*) AS n, min(o) AS best FROM t WHERE price_record_count >= {V.MIN_RECORDS} GROUP BY 1)
    SELECT t.row_id, CASE WHEN g.n > 1 AND t.o <> g.best THEN 'duplicate_price_history' END AS exclusion_reason
    FROM t LEFT JOIN g ON t.price_history = g.price_history AND t.price_record_count >= {V.MIN_RECORDS}""", ("pts", _POINTS_SQL)))
def copied_histories(spark, sf_dir):
    """Duplicate-history resolution where neighbouring items share one history:
    of each pair with enough points the lower (match rank, score, title length)
    stays."""
    p = V.Panel(spark, sf_dir)
    pair = F.col("item_id") - F.col("item_id") % 2
    days = points_with_seq(p).where(F.col("date").isNotNull()).select(pair.alias("pair"), "date").distinct()
    hist = days.groupBy("pair").agg(F.count(F.lit(1)).alias("price_record_count"),
                                    F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ",").alias("price_history"))
    kinds = F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("unmatched"), F.lit("none"))
    rows = p.items.withColumn("pair", pair).join(hist, "pair").select(
        F.floor(F.col("item_id") / 4).cast("long").alias("game_id"), F.col("item_id").alias("row_id"), "title", "price_record_count", "price_history",
        F.element_at(kinds, (F.pmod("item_id", F.lit(4)) + 1).cast("int")).alias("match_type"),
        (F.col("item_id") % 7).cast("double").alias("match_score"))
    return resolve_duplicate_histories(rows, V.MIN_RECORDS, key="game_id").select("row_id", "exclusion_reason")
