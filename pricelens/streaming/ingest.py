"""Resume-by-key ingestion of landed pages with Structured Streaming.

New landed files (JSON lines ``page_id, http_status, html``) are picked up
from a folder; the checkpoint remembers which files were processed, so a
rerun continues where the last one stopped (and survives executor or driver
loss).  ``trigger(availableNow=True)`` processes everything present and
stops, which makes the stream usable as a scheduled incremental batch.
Points go to an append-only parquet table; failed pages to a status table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.sources.landed import chart_points, ingest_status

PAGE_SCHEMA = "page_id string, http_status int, html string"


def start_page_ingest(spark: SparkSession, landed_dir: str, points_path: str, status_path: str,
                      checkpoint_dir: str, available_now: bool = True, max_files: int | None = None):
    """Start the stream; returns the StreamingQuery (call ``awaitTermination``)."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.json(landed_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # each micro-batch owns the partition batch=<id>: a retried batch
        # overwrites its own output, so the sink is exactly-once
        b = batch.persist()
        try:
            chart_points(b).write.mode("overwrite").parquet(f"{points_path}/batch={batch_id}")
            ingest_status(b).write.mode("overwrite").parquet(f"{status_path}/batch={batch_id}")
        finally:
            b.unpersist()

    w = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
