"""Training-data queries: row expansion, split, target encoding, weights."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.operators.asof import deflate
from pricelens.operators.features import latest_real_price, monthly_targets
from pricelens.operators.training import (
    apply_target_encoding, fit_target_encoding, history_rows, split_by_item, target_rows, training_data)
from pricelens.plans import views as V
from pricelens.plans.registry import register
from pricelens.plans.trends import _REAL_PANEL_SQL, _TARGETS_SQL, real_monthly_panel

EVAL_START = "2000-01-01"
LOOKBACK = 36


def model_panel(p: V.Panel, after: str | None = None, until: str | None = None):
    """Monthly panel deflated with the model's rule (nominal when no index)."""
    return deflate(p.panel_between(after, until), p.cpi, V.CPI_REF_YEAR, "price", F.year("date"), on_missing="nominal")


_MODEL_PANEL_SQL = f"""
    SELECT m.item_id, m.date, m.price,
           coalesce(m.price * (SELECT value FROM cpi WHERE year = {V.CPI_REF_YEAR}) / c.value, m.price) AS real
    FROM (SELECT *, CAST(year(date) AS INTEGER) AS _y FROM panel_m) m
    ASOF LEFT JOIN cpi c ON m._y >= c.year"""

_HIST_SQL = f"""
    SELECT item_id,
           CAST((year(date) - {EVAL_START[:4]}) * 12 + month(date) - {int(EVAL_START[5:7])} AS INTEGER) AS months_ahead,
           CAST(date_trunc('month', date) AS DATE) AS prediction_date,
           {rnd_sql('ln(real / prev)', 6)} AS log_return, {rnd_sql('prev', 2)} AS prev_real_price
    FROM (SELECT *, CASE WHEN pd = CAST(date - INTERVAL 1 MONTH AS DATE) OR date - pd <= 45 THEN pv END AS prev
          FROM (SELECT *, lag(date) OVER w AS pd, lag(real) OVER w AS pv FROM model_panel
                WHERE price > 0 AND real > 0 WINDOW w AS (PARTITION BY item_id ORDER BY date)) a) b
    WHERE date >= CAST(DATE '{EVAL_START}' - INTERVAL {LOOKBACK} MONTH AS DATE) AND date < DATE '{EVAL_START}'
      AND prev > 0"""


def hist_rows(p: V.Panel):
    # a row's previous point lies at most 45 days before it
    start = datetime.date.fromisoformat(p.scope.start)
    months = start.year * 12 + start.month - 1 - LOOKBACK - 3
    first = datetime.date(months // 12, months % 12 + 1, 1)
    last = start - datetime.timedelta(days=1)
    return history_rows(model_panel(p, first.isoformat(), last.isoformat()), p.scope.start, LOOKBACK)


@register("training_rows", covers=("M1", "E8", "J4", "I5"),
          oracle=lambda: V.with_views("SELECT *, 'history' AS source FROM hist",
                                      ("model_panel", _MODEL_PANEL_SQL), ("hist", _HIST_SQL)))
def training_rows(spark, sf_dir):
    return training_data(hist_rows(V.Panel(spark, sf_dir)), None)


def current_prices(p: V.Panel):
    return latest_real_price(real_monthly_panel(p, V.CUTOFF), V.CUTOFF)


def eval_rows(p: V.Panel, ordinal: bool = False):
    targets = monthly_targets(real_monthly_panel(p, V.TEST_END, after=V.CUTOFF), V.CUTOFF, V.TEST_END)
    return target_rows(targets, current_prices(p), EVAL_START, ordinal=ordinal)


_CUR_SQL = f"""SELECT item_id, CASE WHEN r <> 0 THEN r END AS current_real_price FROM (
                 SELECT item_id, {rnd_sql('arg_max(coalesce(real, 0.0), date)', 2)} AS r
                 FROM real_panel WHERE date <= DATE '{V.CUTOFF}' GROUP BY item_id) x"""

_EVAL_SQL = f"""
    SELECT item_id, CAST((year(pdate) - {EVAL_START[:4]}) * 12 + month(pdate) - {int(EVAL_START[5:7])} + 1 AS INTEGER) AS months_ahead,
           pdate AS prediction_date, {rnd_sql('ln(real_price / prev)', 6)} AS log_return,
           {rnd_sql('prev', 2)} AS prev_real_price, {rnd_sql('real_price', 2)} AS actual_real_price
    FROM (SELECT t.item_id, CAST(t.month || '-01' AS DATE) AS pdate, t.real_price,
                 CASE WHEN row_number() OVER w = 1 THEN c.current_real_price ELSE lag(t.real_price) OVER w END AS prev
          FROM targets t LEFT JOIN cur c ON t.item_id = c.item_id
          WINDOW w AS (PARTITION BY t.item_id ORDER BY t.month)) x
    WHERE prev > 0 AND real_price > 0"""


@register("eval_rows", covers=("M2", "E9", "J4", "L17"),
          oracle=lambda: V.with_views("SELECT * FROM ev", ("real_panel", _REAL_PANEL_SQL),
                                      ("targets", _TARGETS_SQL), ("cur", _CUR_SQL), ("ev", _EVAL_SQL)))
def eval_rows_query(spark, sf_dir):
    return eval_rows(V.Panel(spark, sf_dir))


@register("training_union", covers=("M3", "G1", "B2"),
          oracle=lambda: V.with_views("""
    SELECT *, NULL::DOUBLE AS actual_real_price, 'history' AS source FROM hist WHERE log_return IS NOT NULL
    UNION ALL BY NAME SELECT *, 'target' AS source FROM ev WHERE log_return IS NOT NULL""",
    ("model_panel", _MODEL_PANEL_SQL), ("hist", _HIST_SQL), ("real_panel", _REAL_PANEL_SQL),
    ("targets", _TARGETS_SQL), ("cur", _CUR_SQL), ("ev", _EVAL_SQL)))
def training_union(spark, sf_dir):
    """History rows and target rows in one table, rows without a target dropped
    (what the in-sample training of the production run uses)."""
    p = V.Panel(spark, sf_dir)
    return training_data(hist_rows(p), eval_rows(p), include_eval_rows=True)


@register("item_split", covers=("M5", "G3", "C17"),
          oracle=lambda: V.with_views("""
    SELECT *, CASE WHEN CAST('0x' || substr(md5('42:' || CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10
                   THEN 'validation' ELSE 'train' END AS split FROM hist""",
                                      ("model_panel", _MODEL_PANEL_SQL), ("hist", _HIST_SQL)))
def item_split(spark, sf_dir):
    """Group-aware 90/10 split of training rows by item."""
    rows = split_by_item(hist_rows(V.Panel(spark, sf_dir)))
    train_ids = rows.where(F.col("split") == "train").select("item_id").distinct()
    val = rows.join(train_ids, "item_id", "left_anti")          # validation = all - train
    train = rows.join(train_ids, "item_id", "left_semi")
    return train.unionByName(val)


@register("publisher_encoding", covers=("M6", "C5"),
          oracle=lambda: V.with_views(f"""
    WITH t AS (SELECT h.log_return AS y, i.publisher FROM hist h JOIN items i ON h.item_id = i.item_id
               WHERE h.log_return IS NOT NULL),
         g AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM t),
         per AS (SELECT publisher, count(y) AS n, avg(y) AS m, var_pop(y) AS v FROM t GROUP BY publisher),
         enc AS (SELECT per.publisher,
                        CASE WHEN g.gv > 0 THEN (per.n * g.gv / (per.n * g.gv + per.v)) * per.m
                                               + (1 - per.n * g.gv / (per.n * g.gv + per.v)) * g.gm
                             ELSE g.gm END AS e FROM per, g)
    SELECT i.item_id, i.publisher, {rnd_sql('coalesce(enc.e, (SELECT gm FROM g))', 6)} AS publisher_encoded
    FROM items i LEFT JOIN enc ON i.publisher = enc.publisher""",
    ("model_panel", _MODEL_PANEL_SQL), ("hist", _HIST_SQL)))
def publisher_encoding(spark, sf_dir):
    """Publisher target encoding fitted on history rows, applied to every item
    (unseen publishers get the global mean)."""
    p = V.Panel(spark, sf_dir)
    train = hist_rows(p).join(p.items.select("item_id", "publisher"), "item_id")
    enc = fit_target_encoding(train, "publisher", "log_return")
    out = apply_target_encoding(p.items.select("item_id", "publisher"), enc, "publisher", "publisher_encoded")
    return out.select("item_id", "publisher", rnd("publisher_encoded", 6).alias("publisher_encoded"))
