"""Sinks and materialisation helpers (overwrite, append, cache-or-compute,
quarantine split, metrics document, nested JSON export)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.sources.tables import path_exists, paths_like, read_optional


def _qualified(spark: SparkSession, path: str) -> str:
    """Full URI of a path, without a trailing slash."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hpath).toUri().getPath().rstrip("/")


def write_overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a table.  Writing over a table the same plan reads is refused
    (``ValueError``): write to a separate output path."""
    target = _qualified(df.sparkSession, path) + "/"
    if any((_qualified(df.sparkSession, f) + "/").startswith(target) for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the table that would replace it")
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_append(df: DataFrame, path: str, schema: StructType | None = None, fmt: str = "parquet") -> None:
    """Append rows under one fixed schema (columns by name, not position)."""
    if schema is not None:
        df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.write.mode("append").format(fmt).save(path)


def cache_or_compute(spark: SparkSession, path: str, compute, fmt: str = "parquet") -> DataFrame:
    """Reuse a materialised stage if it was written to its end, else compute,
    write and re-read it (the re-read plan starts from the files, so lineage is
    cut).  A folder that a stopped job left behind is written anew."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of a table's last commit."""
    found = paths_like(spark, f"{path}/commits/*.json")
    if not found:
        return 0, {"folders": [], "batches": []}
    text = spark.read.text(found[-1], wholetext=True).first()[0]
    return int(found[-1].rpartition("/")[2].removesuffix(".json")), json.loads(text)


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches in a table's last commit."""
    return _manifest(spark, path)[1]["batches"]


def commit_table(df: DataFrame, path: str, mode: str = "overwrite", batch: str | None = None) -> bool:
    """Write rows into a folder of their own and then swap in a manifest that names
    the folders of the table.

    Readers see the last manifest, so a job that stops halfway leaves the table as
    it was.  ``append`` adds a folder; a ``batch`` that the table already has is
    left alone (``False``), so a rerun adds no row twice.  One writer at a time.
    """
    spark = df.sparkSession
    number, manifest = _manifest(spark, path)
    if batch is not None and batch in manifest["batches"]:
        return False
    folder = f"data/{uuid.uuid4()}"
    df.write.parquet(f"{path}/{folder}")
    keep = manifest["folders"] if mode == "append" else []
    known = manifest["batches"] if mode == "append" else []
    text = json.dumps({"folders": [*keep, folder], "batches": [*known, *([batch] if batch is not None else [])]})
    jvm = spark.sparkContext._jvm
    draft, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/commits/.{uuid.uuid4()}", f"{path}/commits/{number + 1:010d}.json"))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} was committed by another writer")
    return True


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table of the last commit; without one an empty table with the schema."""
    _, manifest = _manifest(spark, path)
    if not manifest["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in manifest["folders"]))


def write_quarantine(tagged: DataFrame, included_path: str, excluded_path: str,
                     reason: str = "exclusion_reason") -> tuple[int, int]:
    """Two filtered writes from one tagged table; the excluded table is
    written only when it has rows.  Returns (included, excluded) counts."""
    tagged = tagged.persist()
    try:
        inc = tagged.where(F.col(reason).isNull()).drop(reason)
        exc = tagged.where(F.col(reason).isNotNull())
        inc.write.mode("overwrite").parquet(included_path)
        n_exc = exc.count()
        if n_exc:
            exc.write.mode("overwrite").parquet(excluded_path)
        return inc.sparkSession.read.parquet(included_path).count(), n_exc
    finally:
        tagged.unpersist()


def metrics_document(spark: SparkSession, metrics: dict) -> DataFrame:
    """A one-row DataFrame holding a nested metrics document (write it with
    ``write.json``)."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(metrics)], 1))


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Nested rows as JSON lines (maps, arrays and structs kept nested)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").json(path)


__all__ = ["write_overwrite", "write_append", "cache_or_compute", "commit_table", "committed_batches", "read_committed", "write_quarantine", "metrics_document",
           "write_json", "read_optional"]
