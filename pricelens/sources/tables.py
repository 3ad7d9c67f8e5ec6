"""Parquet / CSV scans with explicit schemas, and optional sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table.  Projection and filters applied later are pushed
    into the scan by Catalyst (``ReadSchema`` / ``PushedFilters``)."""
    return spark.read.parquet(table_path(sf_dir, name))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system Spark reads."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths of a glob pattern, sorted, in any file system Spark reads."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return sorted(s.getPath().toString() for s in found or [])


CORRUPT = "_corrupt_record"


def with_corrupt(schema: StructType) -> StructType:
    """The schema with a column for the text of rows that do not fit it."""
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """CSV with a fixed schema; never inferred (inference is a full extra pass).
    A row with too few or too many fields, or a field that is not of its type,
    has its text in ``_corrupt_record``."""
    return spark.read.schema(with_corrupt(schema)).option("header", header).option("mode", "PERMISSIVE") \
        .option("escape", '"').option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a fixed nested schema; broken lines as in :func:`read_csv`."""
    return spark.read.schema(with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def split_corrupt(rows: DataFrame, status: str = "malformed") -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and dead-letter rows (``raw``, ``status``) for the others."""
    whole = [c for c in rows.columns if c != CORRUPT]
    # Spark scans a file for its corrupt rows only together with other columns
    bad = F.col(CORRUPT).isNotNull() & (F.to_json(F.struct(*whole)) != "")
    return rows.where(~bad).select(*whole), rows.where(bad).select(F.col(CORRUPT).alias("raw"), F.lit(status).alias("status"))


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Read ``path`` if it exists, else an empty table with the same schema."""
    if path_exists(spark, path):
        return spark.read.schema(schema).format(fmt).load(path)
    return spark.createDataFrame([], schema)
