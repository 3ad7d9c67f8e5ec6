"""As-of lookups against a yearly price index (inflation adjustment).

An index value applies to its own year and, forward-filled, to every later
year until the next published value.  The index is a dimension with one row
per calendar year, so its size is bounded by the calendar, not by the data:
it is densified once and broadcast; the panel side is never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_factors(cpi: DataFrame, ref_year: int, year_col: str = "year",
                  value_col: str = "value") -> DataFrame:
    """``(year, factor)`` for every year from the first published one to the
    last, with ``factor = index[ref_year] / index[as-of year]``.

    Returns NULL factors when the reference year is not published or an index
    value is zero.  At most one row per calendar year reaches the driver.
    """
    return _dense_from_index(cpi.sparkSession, _collect_index(cpi, year_col, value_col), ref_year)


def _dense_from_index(spark, idx: dict, ref_year: int) -> DataFrame:
    if not idx:
        return spark.createDataFrame([], "year int, factor double, last_year int")
    ref = idx.get(ref_year)
    lo, hi = min(idx), max(idx)
    out, cur = [], None
    for y in range(lo, hi + 1):
        cur = idx.get(y, cur)
        factor = ref / cur if (ref is not None and cur) else None
        out.append((y, factor, hi))
    return spark.createDataFrame(out, "year int, factor double, last_year int")


def _collect_index(cpi: DataFrame, year_col: str = "year", value_col: str = "value") -> dict:
    """The index as {year: value}, one row per calendar year after the
    aggregate (a year given several times: its largest value)."""
    rows = cpi.select(F.col(year_col).cast("int").alias("y"), F.col(value_col).cast("double").alias("v")) \
              .where(F.col("y").between(1, 9999) & F.col("v").isNotNull() & ~F.isnan("v")) \
              .groupBy("y").agg(F.max("v").alias("v")).collect()
    return {r.y: r.v for r in rows}


def deflate(df: DataFrame, cpi: DataFrame, ref_year: int, value: str, year: Column | str,
            out: str = "real", on_missing: str = "null") -> DataFrame:
    """Add ``out = value * index[ref] / index[as-of(year)]``.

    ``on_missing='null'`` leaves the real value NULL before the first index
    year or without a reference value; ``'nominal'`` keeps the nominal value.
    """
    idx = _collect_index(cpi)
    fac = _dense_from_index(cpi.sparkSession, idx, ref_year)
    hi = max(idx) if idx else None
    ycol = F.col(year) if isinstance(year, str) else year
    key = F.least(ycol, F.lit(hi)) if hi is not None else F.lit(None).cast("int")
    joined = df.withColumn("_cpi_year", key.cast("int")).join(
        F.broadcast(fac.select(F.col("year").alias("_cpi_year"), F.col("factor").alias("_cpi_factor"))),
        on="_cpi_year", how="left")
    real = F.col(value) * F.col("_cpi_factor")
    if on_missing == "nominal":
        real = F.coalesce(real, F.col(value))
    return joined.withColumn(out, real).drop("_cpi_year", "_cpi_factor")


def deflate_sql(value_expr: str, year_expr: str, ref_year: int, src: str, cpi_view: str = "cpi") -> str:
    """SQL twin (DuckDB ``ASOF JOIN``) of :func:`deflate`; returns a SELECT
    over ``src`` adding column ``real``."""
    return f"""
        SELECT s.* EXCLUDE (_y), s.{value_expr} * (SELECT value FROM {cpi_view} WHERE year = {ref_year}) / c.value AS real
        FROM (SELECT *, CAST({year_expr} AS INTEGER) AS _y FROM {src}) s
        ASOF LEFT JOIN {cpi_view} c ON s._y >= c.year"""
