"""Per-item index (nested export) and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.functions.text import blank_to_empty
from pricelens.operators.cleaning import canonical_daily
from pricelens.operators.index import annual_history, forecast_arrays, monthly_history, resolve_names
from pricelens.operators.documents import rerelease_summary
from pricelens.plans import views as V
from pricelens.plans.cleaning import _HISTORY_SQL, _POINTS_SQL, per_date, price_history
from pricelens.plans.documents import _RR_SQL, game_documents
from pricelens.plans.forecast import _FC_CTES, _SCORED_SQL, scored_forecast
from pricelens.plans.registry import register
from pricelens.plans.trends import _TARGETS_SQL


def item_index(p: V.Panel):
    """Nested per-item index: attributes, monthly / annual history maps,
    ordered forecast entries and resolved re-release names."""
    daily = canonical_daily(per_date(p))
    hm = monthly_history(daily, V.YEAR_FLOOR)
    ha = annual_history(hm)
    hm_map = hm.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "price")))).alias("hm"))
    ha_map = ha.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "price")))).alias("ha"))
    docs = game_documents(p)
    rr = rerelease_summary(docs, docs).select(F.col("id").alias("item_id"), "rerelease_exists", "rerelease_year",
                                             "rerelease_type", "rerelease_ids")
    names = resolve_names(rr.where(F.col("rerelease_ids").isNotNull()), p.items, ids="rerelease_ids",
                          lookup_key="item_id", name="title")
    hist = price_history(p).select("item_id", "canonical_condition", "price_record_count")
    preds = forecast_arrays(scored_forecast(p))
    it = p.items.join(p.units.select("item_id", "units_na"), "item_id", "left")
    out = (it.join(hist, "item_id", "left").join(rr, "item_id", "left").join(names, "item_id", "left")
           .join(hm_map, "item_id", "left").join(ha_map, "item_id", "left").join(preds, "item_id", "left"))
    return out.select(
        F.col("item_id").alias("id"), blank_to_empty("title").alias("title"), blank_to_empty("platform").alias("console"),
        blank_to_empty("genre").alias("genre"), blank_to_empty("publisher").alias("pub"),
        F.col("release_year").alias("year"), blank_to_empty("franchise_ids").alias("franc"),
        rnd("units_na", 2).alias("units"), blank_to_empty("canonical_condition").alias("cond"),
        F.col("price_record_count").alias("records"),
        F.coalesce("rerelease_exists", F.lit(False)).alias("rerel"), F.col("rerelease_year").alias("rerel_yr"),
        blank_to_empty("rerelease_type").alias("rerel_tp"),
        F.coalesce("names", F.array().cast("array<string>")).alias("rerel_names"),
        F.coalesce("hm", F.create_map().cast("map<string,double>")).alias("hm"),
        F.coalesce("ha", F.create_map().cast("map<int,double>")).alias("ha"),
        F.coalesce("preds", F.array()).alias("preds"))


def _dec(c: str, d: int = 2):
    return F.coalesce(F.col(c).cast(f"decimal(18,{d})").cast("string"), F.lit(""))


@register("item_index", headline=True,
          covers=("K11", "D3", "D4", "C13", "C16", "F2", "A17", "H10", "J6"),
          oracle=lambda: V.with_views(f"""
    WITH daily AS (SELECT p.item_id, p.date, arg_max({rnd_sql('p.price', 2)}, p.seq) AS price
                   FROM pts p JOIN items i ON p.item_id = i.item_id JOIN platform_dim d ON i.platform = d.platform
                   WHERE p.condition = d.canonical_condition AND p.date IS NOT NULL AND p.price IS NOT NULL
                   GROUP BY 1, 2),
         hm AS (SELECT item_id, strftime(date, '%Y-%m') AS month, {rnd_sql('avg(price)', 2)} AS price
                FROM daily WHERE year(date) >= {V.YEAR_FLOOR} GROUP BY 1, 2),
         ha AS (SELECT item_id, CAST(substr(month, 1, 4) AS INTEGER) AS year, {rnd_sql('avg(price)', 2)} AS price
                FROM hm GROUP BY 1, 2),
         hmt AS (SELECT item_id, string_agg(month || '=' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY month) AS t
                 FROM hm GROUP BY 1),
         hat AS (SELECT item_id, string_agg(CAST(year AS VARCHAR) || '=' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY year) AS t
                 FROM ha GROUP BY 1),
         pr AS (SELECT item_id, count(*) AS n,
                       string_agg(strftime(prediction_date, '%Y-%m') || ':' || coalesce(CAST(CAST(prediction AS DECIMAL(18,2)) AS VARCHAR), '')
                                  || ':' || coalesce(CAST(CAST(lower_bound AS DECIMAL(18,2)) AS VARCHAR), '')
                                  || ':' || coalesce(CAST(CAST(upper_bound AS DECIMAL(18,2)) AS VARCHAR), '')
                                  || ':' || coalesce(CAST(CAST(confidence_pct AS DECIMAL(18,1)) AS VARCHAR), '')
                                  || ':' || coalesce(CAST(CAST({rnd_sql('actual_price', 2)} AS DECIMAL(18,2)) AS VARCHAR), ''),
                                  ';' ORDER BY months_ahead) AS t
                FROM scored GROUP BY 1),
         rr AS ({_RR_SQL}),
         names AS (SELECT r.id AS item_id, string_agg(i.title, '|' ORDER BY x.pos) AS t
                   FROM rr r, unnest(string_split(r.rerelease_ids, '|')) WITH ORDINALITY AS x(rid, pos)
                   JOIN items i ON i.item_id = CAST(x.rid AS BIGINT)
                   WHERE r.rerelease_ids IS NOT NULL GROUP BY 1),
         phist AS (SELECT item_id, canonical_condition, price_record_count FROM ({_HISTORY_SQL}) hh)
    SELECT i.item_id AS id, coalesce(trim(i.title), '') AS title, coalesce(trim(i.platform), '') AS console,
           coalesce(trim(i.genre), '') AS genre, coalesce(trim(i.publisher), '') AS pub, i.release_year AS year,
           coalesce(trim(i.franchise_ids), '') AS franc, {rnd_sql('u.units_na', 2)} AS units,
           coalesce(trim(h.canonical_condition), '') AS cond, h.price_record_count AS records,
           coalesce(rr.rerelease_exists, false) AS rerel, rr.rerelease_year AS rerel_yr,
           coalesce(trim(rr.rerelease_type), '') AS rerel_tp,
           coalesce(names.t, '') AS rerel_names, coalesce(hmt.t, '') AS hm, coalesce(hat.t, '') AS ha,
           CAST(coalesce(pr.n, 0) AS INTEGER) AS n_preds, coalesce(pr.t, '') AS preds
    FROM items i LEFT JOIN units u ON i.item_id = u.item_id LEFT JOIN phist h ON i.item_id = h.item_id
    LEFT JOIN rr ON i.item_id = rr.id LEFT JOIN names ON i.item_id = names.item_id
    LEFT JOIN hmt ON i.item_id = hmt.item_id LEFT JOIN hat ON i.item_id = hat.item_id
    LEFT JOIN pr ON i.item_id = pr.item_id""",
    ("pts", _POINTS_SQL), *_FC_CTES, ("targets", _TARGETS_SQL), ("scored", _SCORED_SQL)))
def item_index_query(spark, sf_dir):
    """The nested index rendered flat for checking: maps and arrays as
    ordered text (the export writes the nested form as JSON)."""
    with V.materialized(spark, sf_dir) as p:
        idx = item_index(p)
    hm_t = F.array_join(F.transform(F.map_entries("hm"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(18,2)").cast("string"))), ",")
    ha_t = F.array_join(F.transform(F.map_entries("ha"), lambda e: F.concat(
        e["key"].cast("string"), F.lit("="), e["value"].cast("decimal(18,2)").cast("string"))), ",")

    def fmt(e, f, d):
        return F.coalesce(e[f].cast(f"decimal(18,{d})").cast("string"), F.lit(""))
    pr_t = F.array_join(F.transform("preds", lambda e: F.concat_ws(
        ":", e["month"], fmt(e, "mid", 2), fmt(e, "low", 2), fmt(e, "high", 2), fmt(e, "conf", 1), fmt(e, "actual", 2))), ";")
    return idx.select(
        "id", "title", "console", "genre", "pub", "year", "franc", "units", "cond", "records", "rerel", "rerel_yr",
        "rerel_tp", F.array_join("rerel_names", "|").alias("rerel_names"), hm_t.alias("hm"), ha_t.alias("ha"),
        F.size("preds").alias("n_preds"), pr_t.alias("preds"))


SEARCH_TEXT = "red widget"
SEARCH_LIMIT = 30


@register("search", covers=("F6", "F1"),
          oracle=lambda: V.with_views(f"""
    SELECT item_id, title, platform FROM items
    WHERE length('{SEARCH_TEXT}') >= 2 AND contains(lower(concat_ws(' ', title, platform)), '{SEARCH_TEXT}')
    ORDER BY platform, title, item_id LIMIT {SEARCH_LIMIT}"""))
def search(spark, sf_dir):
    """Substring search over title and platform, first 30 hits in index
    order (platform, title, id); queries shorter than 2 characters return
    nothing.  A top-k: the limit is the feature."""
    it = V.Panel(spark, sf_dir).items
    q = SEARCH_TEXT.lower()
    if len(q) < 2:
        return it.select("item_id", "title", "platform").limit(0)
    hits = it.where(F.lower(F.concat_ws(" ", "title", "platform")).contains(q))
    return hits.orderBy("platform", "title", "item_id").limit(SEARCH_LIMIT).select("item_id", "title", "platform")
