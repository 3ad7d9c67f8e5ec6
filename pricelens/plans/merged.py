"""The merged item table: sales match, corrected year, history count, canonical
condition and exclusion reason joined to every item, and run counters over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.functions.text import variant_flag
from pricelens.operators.cleaning import exclusion_reason
from pricelens.operators.matching import match_titles
from pricelens.plans import views as V
from pricelens.plans.cleaning import _CLASSIFIED_SQL, _HISTORY_SQL, _POINTS_SQL, classified
from pricelens.plans.matching import _MATCH_SQL, _sales_cte, sales_listing
from pricelens.plans.registry import register

SALES_COLUMNS = ["sales_url", "units_global_m", "units_na_m"]


def merged_items(p: V.Panel):
    """One row per item.  ``release_year`` is the corrected one: the item
    table's own column is replaced.  Rows to be left out keep their reason."""
    match = match_titles(p.items.select("item_id", "title", "platform"), sales_listing(p), payload=SALES_COLUMNS)
    # one row a platform
    condition = p.platform_dim.select("platform", "canonical_condition")
    out = classified(p).join(match.hint("shuffle_hash"), "item_id", "left").join(F.broadcast(condition), "platform", "left")
    return out.select(
        "item_id", "title", "platform", "release_year", "is_hardware", "variant_type",
        variant_flag("variant_type").alias("is_variant"), "price_record_count", "canonical_condition",
        "match_type", "match_score", *SALES_COLUMNS, exclusion_reason(V.MIN_RECORDS).alias("exclusion_reason"))


_MERGED_SQL = f"""
    SELECT c.item_id, c.title, c.platform, c.release_year, c.is_hardware, c.variant_type,
           c.variant_type <> 'standard' AS is_variant, c.price_record_count, d.canonical_condition,
           m.match_type, m.match_score, m.sales_url, m.units_global_m, m.units_na_m,
           CASE WHEN c.is_hardware THEN 'hardware'
                WHEN coalesce(c.price_record_count, 0) < {V.MIN_RECORDS} THEN 'fewer_than_{V.MIN_RECORDS}_price_records' END AS exclusion_reason
    FROM classified c LEFT JOIN matched m ON c.item_id = m.item_id LEFT JOIN platform_dim d ON c.platform = d.platform"""
_CTES = (("pts", _POINTS_SQL), ("hist", _HISTORY_SQL), ("classified", _CLASSIFIED_SQL), ("sales", _sales_cte()), ("matched", _MATCH_SQL))


@register("merged_items", covers=("C1", "C2", "C3", "I9", "B5", "C9", "C11"), oracle=lambda: V.with_views(_MERGED_SQL, *_CTES))
def merged_items_query(spark, sf_dir):
    return merged_items(V.Panel(spark, sf_dir))


@register("match_report", covers=("A18", "D11", "D12"), oracle=lambda: V.with_views(f"""
    SELECT platform, count(*) AS n_items, count(*) FILTER (WHERE match_type = 'exact') AS n_exact,
           count(*) FILTER (WHERE match_type = 'fuzzy') AS n_fuzzy, count(*) FILTER (WHERE match_type = 'unmatched') AS n_unmatched,
           {rnd_sql("avg(CASE WHEN match_type = 'unmatched' THEN 0.0 ELSE 1.0 END)", 4)} AS match_rate,
           count(*) FILTER (WHERE exclusion_reason IS NOT NULL) AS n_excluded
    FROM merged GROUP BY platform""", *_CTES, ("merged", _MERGED_SQL)))
def match_report(spark, sf_dir):
    """Matched, fuzzy, unmatched and excluded items and the match rate, per platform."""
    kind = lambda k: F.count_if(F.col("match_type") == k)
    return merged_items(V.Panel(spark, sf_dir)).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_items"), kind("exact").alias("n_exact"), kind("fuzzy").alias("n_fuzzy"), kind("unmatched").alias("n_unmatched"),
        rnd(F.avg(F.when(F.col("match_type") == "unmatched", 0.0).otherwise(1.0)), 4).alias("match_rate"),
        F.count_if(F.col("exclusion_reason").isNotNull()).alias("n_excluded"))
