"""Price-index loader with tolerant headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.tables import path_exists

# Accepted header names (case-insensitive, trimmed).
YEAR_NAMES = ("year", "yr")
VALUE_NAMES = ("annual", "avg", "value", "cpi")


def load_cpi(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """``(year INT, value DOUBLE)`` from a CSV whose headers may be padded or
    differently cased; the first matching year / value columns are used.
    Missing file or columns: an error when ``required``, else an empty
    table (the model-side behaviour).  Any other read error is raised."""
    empty = spark.createDataFrame([], "year int, value double")
    if not required and not path_exists(spark, path):
        return empty
    raw = spark.read.option("header", True).csv(path)
    cols = {c.strip().lower(): c for c in raw.columns}
    ycol = next((cols[n] for n in cols if n in YEAR_NAMES), None)
    vcol = next((cols[n] for n in cols if n in VALUE_NAMES), None)
    if ycol is None or vcol is None:
        if required:
            raise ValueError(f"no year/value columns in {raw.columns}")
        return empty
    y = F.col(f"`{ycol}`").try_cast("double")
    return raw.select(y.cast("int").alias("year"), F.col(f"`{vcol}`").try_cast("double").alias("value")) \
              .where(F.col("year").isNotNull() & F.col("value").isNotNull())
