"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space and the complement classes, as Java regular expressions.
# ``bytes.split()`` in Python cuts at exactly the same six characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Bytes of one Arrow batch handed to a Python worker.  Only memory depends on
# it: a document is never cut, results do not change.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table of a data folder (any file system Spark reads)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def prepare(spark: SparkSession) -> None:
    """Bound the memory of Python workers when documents are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    return column.cast(pa.binary()).to_pylist()


def map_rows(df: DataFrame, row_fn: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """Apply ``row_fn(*columns of one row) -> tuple`` to every row, batch by batch.

    String columns arrive as UTF-8 bytes.  ``row_fn`` is a small pure function;
    Spark owns the partitioning and nothing is kept between batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [text_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
                    else c.to_pylist() for c in batch.columns]
            out = [row_fn(*r) for r in zip(*cols)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def blank(column) -> F.Column:
    """Null text counts as empty text."""
    return F.coalesce(column, F.lit(""))


def let(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# Numbers that one step of the running sums below looks back over.
RUN = 128


def running(values: F.Column, start: F.Column, merge) -> F.Column:
    """For each place of an array what ``merge`` makes of all values before it, from ``start``.

    Within a run of 128 values and over the runs' own totals; the work grows with
    the length, not with its square.
    """
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda r: F.slice(values, r * RUN + 1, RUN))
    within = lambda run, before: F.transform(run, lambda _, i: F.aggregate(F.slice(run, F.lit(1), i), before, merge))
    totals = F.transform(runs, lambda run: F.aggregate(run, start, merge))
    found = let(totals, lambda t: F.flatten(F.transform(runs, lambda run, r: let(
        F.aggregate(F.slice(t, F.lit(1), r), start, merge), lambda before: within(run, before)))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<bigint>"))
