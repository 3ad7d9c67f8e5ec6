"""Per-item nested index: history maps, forecast arrays, resolved names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd


def monthly_history(daily: DataFrame, year_floor: int, key: str = "item_id") -> DataFrame:
    """Mean price per month (``yyyy-MM``), rounded to 2, years >= floor."""
    return daily.where(F.year("date") >= year_floor).groupBy(key, F.date_format("date", "yyyy-MM").alias("month")) \
                .agg(rnd(F.avg("price"), 2).alias("price"))


def annual_history(monthly: DataFrame, key: str = "item_id") -> DataFrame:
    """Mean of the rounded monthly means per year, rounded to 2."""
    return monthly.groupBy(key, F.substring("month", 1, 4).cast("int").alias("year")) \
                  .agg(rnd(F.avg("price"), 2).alias("price"))


def resolve_names(ids_text: DataFrame, lookup: DataFrame, key: str = "item_id", ids: str = "ids",
                  lookup_key: str = "id", name: str = "title", order_col: str | None = None) -> DataFrame:
    """``|``-joined ids -> array of names in list order; unknown ids dropped;
    when the lookup has the same id twice, the last row (by ``order_col``)
    wins."""
    ex = ids_text.select(key, F.posexplode(F.split(F.col(ids), r"\|")).alias("_pos", "_id"))
    ex = ex.withColumn("_id", F.col("_id").try_cast("double")).where(F.col("_id").isNotNull()) \
           .withColumn("_id", F.col("_id").cast("bigint"))
    lk = lookup.select(F.col(lookup_key).cast("bigint").alias("_id"), F.col(name).alias("_name"),
                       F.col(order_col or lookup_key).alias("_o"))
    lk = lk.groupBy("_id").agg(F.max_by("_name", "_o").alias("_name"))
    j = ex.join(lk, "_id")
    return j.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_name"))),
                                          lambda x: x["_name"]).alias("names"))


def forecast_arrays(preds: DataFrame, key: str = "item_id", with_actual: bool = True) -> DataFrame:
    """Per item, forecast entries ordered by months_ahead:
    (month, mid, low, high, confidence[, actual])."""
    fields = [F.date_format("prediction_date", "yyyy-MM").alias("month"), F.col("prediction").alias("mid"),
              F.col("lower_bound").alias("low"), F.col("upper_bound").alias("high"),
              F.col("confidence_pct").alias("conf")]
    if with_actual:
        fields.append(rnd("actual_price", 2).alias("actual"))
    ent = F.struct(F.col("months_ahead").alias("m"), *fields)
    return preds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(ent)),
                                              lambda e: e.dropFields("m")).alias("preds"))
