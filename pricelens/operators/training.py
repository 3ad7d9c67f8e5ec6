"""Training-row expansion, item split and target encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.dates import month_offset
from pricelens.functions.numeric import log_return, rnd

MAX_GAP_DAYS = 45


def history_rows(real_panel: DataFrame, ref_date: str, lookback_months: int = 36, key: str = "item_id",
                 date: str = "date", value: str = "real") -> DataFrame:
    """One training row per positive point in ``[ref - lookback, ref)``: the
    log-return against the previous point (exactly one month earlier, else the
    latest earlier point within 45 days), and the (negative) month offset.
    The previous point is looked up over the whole positive series, before
    the look-back filter."""
    ref = F.lit(ref_date).cast("date")
    pos = real_panel.where((F.col("price") > 0) & (F.col(value) > 0))
    w = Window.partitionBy(key).orderBy(date)
    pos = pos.withColumn("_pd", F.lag(date).over(w)).withColumn("_pv", F.lag(value).over(w))
    prev = F.when((F.col("_pd") == F.add_months(F.col(date), -1)) |
                  (F.datediff(F.col(date), F.col("_pd")) <= MAX_GAP_DAYS), F.col("_pv"))
    rows = pos.where((F.col(date) >= F.add_months(ref, -lookback_months)) & (F.col(date) < ref)) \
              .withColumn("_prev", prev).where(F.col("_prev") > 0)
    return rows.select(
        key, month_offset(F.col(date), ref).alias("months_ahead"),
        F.trunc(date, "MM").alias("prediction_date"),
        log_return(F.col(value), F.col("_prev")).alias("log_return"),
        rnd("_prev", 2).alias("prev_real_price"))


def target_rows(targets: DataFrame, current: DataFrame, start_date: str, key: str = "item_id",
                ordinal: bool = False) -> DataFrame:
    """Rows from monthly targets after the cutoff: log-return against the
    previous target (the current price for the first one).  ``months_ahead``
    is the calendar offset from ``start_date`` (+1), or the ordinal of the
    target with ``ordinal=True``."""
    t = targets.withColumn("prediction_date", F.to_date(F.concat(F.col("month"), F.lit("-01"))))
    w = Window.partitionBy(key).orderBy("month")
    t = t.join(current.select(key, "current_real_price"), key, "left") \
         .withColumn("_rn", F.row_number().over(w)) \
         .withColumn("_lag", F.lag("real_price").over(w))
    prev = F.when(F.col("_rn") == 1, F.col("current_real_price")).otherwise(F.col("_lag"))
    ma = F.col("_rn") if ordinal else month_offset(F.col("prediction_date"), F.lit(start_date).cast("date")) + 1
    t = t.withColumn("_prev", prev).where((F.col("_prev") > 0) & (F.col("real_price") > 0))
    return t.select(key, ma.cast("int").alias("months_ahead"), "prediction_date",
                    log_return(F.col("real_price"), F.col("_prev")).alias("log_return"),
                    rnd("_prev", 2).alias("prev_real_price"), rnd("real_price", 2).alias("actual_real_price"))


def training_data(hist: DataFrame, evals: DataFrame | None, include_eval_rows: bool = False) -> DataFrame:
    """Union by name of history rows (and, if asked, target rows); rows
    without a target dropped.  Default is strictly out-of-sample."""
    out = hist.withColumn("source", F.lit("history"))
    if include_eval_rows and evals is not None:
        out = out.unionByName(evals.withColumn("source", F.lit("target")), allowMissingColumns=True)
    return out.dropna(subset=["log_return"])


def split_by_item(df: DataFrame, key: str = "item_id", val_pct: int = 10, seed: int = 42) -> DataFrame:
    """Group-aware split: every row of an item falls on the same side,
    decided by a seeded hash of the key (no driver-side id list; the hash is
    one that other engines have too).  A NULL key is a group of its own."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < val_pct, "validation").otherwise("train"))


def fit_target_encoding(train: DataFrame, cat: str, target: str) -> DataFrame:
    """Empirical-Bayes target encoding (automatic smoothing): per category
    ``lambda = n * var_all / (n * var_all + var_cat)`` and
    ``enc = lambda * mean_cat + (1 - lambda) * mean_all`` (population
    variances).  Returns ``(cat, encoded, global_mean)``, one row per
    category.  The two global moments are one aggregate row, read once."""
    t = train.where(F.col(target).isNotNull())
    g = t.agg(F.avg(target).alias("gm"), F.var_pop(target).alias("gv")).first()
    gm, gv = g.gm, g.gv
    per = t.groupBy(cat).agg(F.count(target).alias("_n"), F.avg(target).alias("_m"), F.var_pop(target).alias("_v"))
    if gv is None or gv <= 0:
        enc = F.lit(gm)
    else:
        lam = F.col("_n") * F.lit(gv) / (F.col("_n") * F.lit(gv) + F.col("_v"))
        enc = lam * F.col("_m") + (1 - lam) * F.lit(gm)
    return per.select(cat, enc.cast("double").alias("encoded"), F.lit(gm).cast("double").alias("global_mean"))


def fold_target_encodings(train: DataFrame, cat: str, target: str, n_folds: int, fold: str = "fold") -> tuple[DataFrame, list[float]]:
    """:func:`fit_target_encoding` of every fold's complement in one pass:
    ``(cat, encoded)`` with one entry for each fold, and the complements' means.
    A category that a complement lacks is null there."""
    y = F.col(target).cast("double")
    of = [F.when(F.col(fold) != k, y) for k in range(n_folds)]
    moments = lambda x, k: (F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_pop(x).alias(f"v{k}"))
    every = [c for k, x in enumerate(of) for c in moments(x, k)]
    all_rows, per = train.agg(*every).first(), train.groupBy(cat).agg(*every)
    encoded = []
    for k in range(n_folds):
        gm, gv = all_rows[f"m{k}"], all_rows[f"v{k}"]
        lam = F.col(f"n{k}") * F.lit(gv) / (F.col(f"n{k}") * F.lit(gv) + F.col(f"v{k}")) if gv else F.lit(0.0)
        encoded.append(F.when(F.col(f"n{k}") > 0, lam * F.col(f"m{k}") + (1 - lam) * F.lit(gm)).cast("double"))
    return per.select(cat, F.array(*encoded).alias("encoded")), [all_rows[f"m{k}"] for k in range(n_folds)]


def apply_target_encoding(df: DataFrame, encoding: DataFrame, cat: str, out: str,
                          global_mean: float | None = None) -> DataFrame:
    """Encoded value per row; unseen categories get the global mean.  The
    encoding has one row per category; AQE broadcasts it when small."""
    if global_mean is None:
        row = encoding.select("global_mean").first()
        global_mean = row[0] if row else None
    j = df.join(encoding.select(cat, "encoded"), cat, "left")
    return j.withColumn(out, F.coalesce(F.col("encoded"), F.lit(global_mean).cast("double"))).drop("encoded")


def error_weights(errors: DataFrame, key: str = "item_id", err: str = "ape", lo: float = 0.5,
                  hi: float = 3.0) -> DataFrame:
    """Per-item sample weights from errors:
    ``clip(mean_err / max(median(mean_err), 1), lo, hi)``.  The median is a
    single scalar (distinct-value counted, so its buffer is bounded by the
    distinct errors), read once."""
    from pricelens.operators.aggregates import group_median
    per = errors.groupBy(key).agg(F.avg(err).alias("_e"))
    med = group_median(per, [], "_e", out="m").first()
    m = med.m if med and med.m is not None else 1.0
    return per.select(key, F.least(F.greatest(F.col("_e") / F.lit(max(m, 1.0)), F.lit(lo)), F.lit(hi)).alias("weight"))
