"""Cleaning, classification and quarantine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.functions.text import HARDWARE_PATTERNS, VARIANT_RULES
from pricelens.operators.cleaning import (
    SENTINEL_CONDITIONS, build_price_history, classify_items, counted_items, exclusion_reason, hardware_breakdown, per_date_points)
from pricelens.plans import views as V
from pricelens.plans.registry import register


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------- SQL twins
def hardware_sql(expr: str) -> str:
    """RE2 has no look-around: the negative look-ahead alternative is checked
    on a copy where every 'charger vs.' occurrence is neutralised, positive
    look-aheads become consuming (same truth value for a search)."""
    neg = r"\bcharger\b(?!\s*vs\.)"
    rest = [p.replace(r"(?=\s*[-\[])", r"\s*[-\[]") for p in HARDWARE_PATTERNS if p != neg]
    alt = "|".join(f"(?:{p})" for p in rest)
    return (f"coalesce(regexp_matches({expr}, {_q(alt)}, 'i') OR "
            f"regexp_matches(regexp_replace({expr}, {_q(r'\bcharger(\s*vs\.)')}, '#\\1', 'gi'), {_q(r'\bcharger\b')}, 'i'), false)")


def variant_sql(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    parts = []
    for label, words in VARIANT_RULES:
        cond = " OR ".join(f"contains({low}, {_q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {_q(label)}")
    return (f"CASE {' '.join(parts)} WHEN regexp_matches(coalesce({expr}, ''), '\\[.+\\]') THEN 'variant' "
            f"ELSE 'standard' END")


_POINTS_SQL = f"""
    SELECT l_partkey AS item_id, CAST(l_shipdate AS DATE) AS date,
           {rnd_sql("CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END", 2)} AS price,
           l_returnflag AS condition, l_orderkey * 1000 + l_linenumber AS seq
    FROM lineitem"""

_HISTORY_SQL = f"""
    SELECT item_id, canonical_condition, CAST(sum(n) AS BIGINT) AS price_record_count,
           count(*) FILTER (WHERE n > 0) AS history_dates,
           min(date) FILTER (WHERE n > 0) AS first_date, max(date) FILTER (WHERE n > 0) AS last_date,
           coalesce(string_agg(CAST(date AS VARCHAR) || '=' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), ','
                               ORDER BY date) FILTER (WHERE n > 0), '') AS price_history
    FROM (SELECT p.item_id, c.canonical_condition, p.date,
                 count(*) FILTER (WHERE p.condition = c.canonical_condition) AS n,
                 arg_max(CASE WHEN p.condition = c.canonical_condition THEN {rnd_sql('p.price', 2)} END,
                         CASE WHEN p.condition = c.canonical_condition THEN p.seq END) AS price
          FROM pts p LEFT JOIN (SELECT i.item_id, d.canonical_condition FROM items i
                                LEFT JOIN platform_dim d ON i.platform = d.platform) c ON p.item_id = c.item_id
          WHERE coalesce(p.condition NOT IN ({', '.join(_q(s) for s in SENTINEL_CONDITIONS)}), true)
            AND p.date IS NOT NULL AND p.price IS NOT NULL AND p.item_id IS NOT NULL
          GROUP BY 1, 2, 3) x
    GROUP BY 1, 2"""


def points_with_seq(p: V.Panel):
    """Price points with an explicit input order (order key, line number)."""
    li = p.table("lineitem")
    return li.select(
        F.col("l_partkey").alias("item_id"), F.col("l_shipdate").cast("date").alias("date"),
        rnd(F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("price"),
        F.col("l_returnflag").alias("condition"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"))


def per_date(p: V.Panel):
    """Canonical per-(item, date) table, shared by history and index."""
    return p._shared("per_date", lambda: per_date_points(points_with_seq(p), p.items, p.platform_dim))


def price_history(p: V.Panel):
    return build_price_history(per_date(p))


@register("price_history", headline=True, covers=("D1", "B1", "B2", "F8", "K2", "H7", "C5", "D9"),
          oracle=lambda: V.with_views("SELECT * FROM hist", ("pts", _POINTS_SQL), ("hist", _HISTORY_SQL)))
def price_history_query(spark, sf_dir):
    return price_history(V.Panel(spark, sf_dir))


def classified(p: V.Panel):
    counted = counted_items(p.items, points_with_seq(p), p.platform_dim)
    return classify_items(counted, floor_year=V.YEAR_FLOOR)


_CLASSIFIED_SQL = f"""
    SELECT i.item_id, i.title, i.platform,
           {hardware_sql('i.title')} AS is_hardware,
           {variant_sql('i.title')} AS variant_type,
           coalesce(least(CASE WHEN i.release_year >= {V.YEAR_FLOOR} THEN i.release_year END,
                          CASE WHEN f.fy >= {V.YEAR_FLOOR} THEN f.fy END), i.release_year) AS release_year,
           h.price_record_count
    FROM items i
    LEFT JOIN (SELECT item_id, CAST(year(min(date)) AS INTEGER) AS fy FROM price_points GROUP BY 1) f ON i.item_id = f.item_id
    LEFT JOIN hist h ON i.item_id = h.item_id"""


@register("quarantine", headline=True, covers=("B3", "B4", "B5", "I9", "A14", "G1"),
          oracle=lambda: V.with_views(f"""
    SELECT item_id, is_hardware, variant_type, variant_type <> 'standard' AS is_variant, release_year,
           price_record_count,
           CASE WHEN is_hardware THEN 'hardware'
                WHEN coalesce(price_record_count, 0) < {V.MIN_RECORDS} THEN 'fewer_than_{V.MIN_RECORDS}_price_records'
           END AS exclusion_reason
    FROM classified""", ("pts", _POINTS_SQL), ("hist", _HISTORY_SQL), ("classified", _CLASSIFIED_SQL)))
def quarantine(spark, sf_dir):
    """Included and excluded rows in one table: ``exclusion_reason`` is NULL for
    included rows (write the two sets with two filtered writes)."""
    c = classified(V.Panel(spark, sf_dir))
    return c.select("item_id", "is_hardware", "variant_type", "is_variant", "release_year",
                    "price_record_count", exclusion_reason(V.MIN_RECORDS).alias("exclusion_reason"))


@register("hardware_breakdown", covers=("D10", "B3", "F1"),
          oracle=lambda: V.with_views("""
    SELECT platform, n_hardware, n_total, n_hardware / n_total AS share FROM (
      SELECT platform, count(*) FILTER (WHERE is_hardware) AS n_hardware, count(*) AS n_total
      FROM classified GROUP BY platform) WHERE n_hardware > 0""",
    ("pts", _POINTS_SQL), ("hist", _HISTORY_SQL), ("classified", _CLASSIFIED_SQL)))
def hardware_breakdown_query(spark, sf_dir):
    return hardware_breakdown(classified(V.Panel(spark, sf_dir))).orderBy(F.desc("n_hardware"))


SAMPLE_SIZE = 10


@register("excluded_sample", covers=("E10", "A14", "F1"),
          oracle=lambda: V.with_views(f"""
    SELECT platform, title, n_excluded - {SAMPLE_SIZE} AS remainder FROM (
      SELECT platform, title, count(*) OVER (PARTITION BY platform) AS n_excluded,
             row_number() OVER (PARTITION BY platform ORDER BY title, item_id) AS rn
      FROM classified
      WHERE is_hardware OR coalesce(price_record_count, 0) < {V.MIN_RECORDS}) x
    WHERE rn <= {SAMPLE_SIZE}""",
    ("pts", _POINTS_SQL), ("hist", _HISTORY_SQL), ("classified", _CLASSIFIED_SQL)))
def excluded_sample(spark, sf_dir):
    """First ten excluded titles per platform, alphabetical, and how many more
    there are (a top-k report: the limit is the feature)."""
    c = classified(V.Panel(spark, sf_dir))
    ex = c.where(exclusion_reason(V.MIN_RECORDS).isNotNull())
    from pricelens.operators.topk import top_k_per_group
    counts = ex.groupBy("platform").agg(F.count(F.lit(1)).alias("n_excluded"))
    top = top_k_per_group(ex.select("platform", "title", "item_id"), ["platform"], ["title", "item_id"],
                          SAMPLE_SIZE, salt_key=["item_id"])
    return top.join(counts, "platform").select(
        "platform", "title", (F.col("n_excluded") - SAMPLE_SIZE).alias("remainder"))


@register("catalog_report", covers=("D11", "D12", "D13", "A18"),
          oracle=lambda: V.with_views("""
    SELECT platform, count(*) AS n_items,
           avg(CASE WHEN genre IS NOT NULL THEN 1.0 ELSE 0.0 END) AS genre_rate,
           count(DISTINCT publisher) AS n_publishers
    FROM items GROUP BY platform"""))
def catalog_report(spark, sf_dir):
    it = V.Panel(spark, sf_dir).items
    return it.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(F.col("genre").isNotNull().cast("double")).alias("genre_rate"),
        F.countDistinct("publisher").alias("n_publishers"),
    ).orderBy(F.desc("n_items"))


def _sales_sql():
    from pricelens.plans.matching import _sales_cte
    return _sales_cte()


def _match_for_dup():
    from pricelens.plans.matching import _MATCH_SQL
    return _MATCH_SQL


@register("duplicate_histories", covers=("D20", "H9", "F1"),
          oracle=lambda: V.with_views(f"""
    WITH m AS ({_match_for_dup()}),
         t AS (SELECT h.item_id, h.price_history, h.price_record_count, i.title, m.match_type, m.match_score,
                      struct_pack(k := h.item_id,
                                  r := coalesce(CASE m.match_type WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1
                                                WHEN 'unmatched' THEN 2 END, 3),
                                  s := -coalesce(m.match_score, 0.0), l := length(i.title)) AS o
               FROM hist h JOIN items i ON h.item_id = i.item_id LEFT JOIN m ON h.item_id = m.item_id),
         g AS (SELECT price_history, count(*) AS n, min(o) AS best FROM t
               WHERE price_history IS NOT NULL AND coalesce(price_record_count, 0) >= {V.MIN_RECORDS}
               GROUP BY price_history)
    SELECT t.item_id, CASE WHEN g.n > 1 AND t.o <> g.best THEN 'duplicate_price_history' END AS exclusion_reason
    FROM t LEFT JOIN g ON t.price_history = g.price_history
      AND t.price_history IS NOT NULL AND coalesce(t.price_record_count, 0) >= {V.MIN_RECORDS}""",
    ("pts", _POINTS_SQL), ("hist", _HISTORY_SQL), ("sales", _sales_sql())))
def duplicate_histories(spark, sf_dir):
    """Rows whose price history duplicates another eligible row's."""
    from pricelens.operators.cleaning import resolve_duplicate_histories
    from pricelens.operators.matching import match_titles
    from pricelens.plans.matching import sales_listing
    p = V.Panel(spark, sf_dir)
    m = match_titles(p.items.select("item_id", "title", "platform"), sales_listing(p))
    df = price_history(p).join(p.items.select("item_id", "title"), "item_id") \
        .join(m.select("item_id", "match_type", "match_score"), "item_id", "left")
    return resolve_duplicate_histories(df, V.MIN_RECORDS).select("item_id", "exclusion_reason")
