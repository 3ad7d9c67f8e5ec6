"""Runs over landed pages that resume where the last one ended.

A state table keeps for every page its last status and how often it was tried.
A run takes the pages that are not done and were not tried too often; pages that
failed are tried again by the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.sources.landed import ingest_status

STATE_SCHEMA = "page_id string, status string, attempts int"
DONE = "done"
MAX_ATTEMPTS = 3


def tried_pages(pages: DataFrame, state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The pages that this run has to try: not done, and tried fewer than ``max_attempts`` times."""
    past = state.select(F.col("page_id").alias("_known"), F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    met = pages.join(past, F.col("page_id") == F.col("_known"), "left")
    return met.where(F.col("_known").isNull() | ((F.col("_status") != DONE) & (F.col("_attempts") < max_attempts))).select(*pages.columns)


def run_state(pages: DataFrame, state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Every page of the run or the state with its new ``status`` and ``attempts``, and
    what the run did with it: ``scraped``, ``failed``, ``skipped``, or null if the
    run does not have it."""
    failed = ingest_status(tried_pages(pages, state, max_attempts)).select(F.col("page_id").alias("_failed"), F.col("status").alias("_why"))
    past = state.select(F.col("page_id").alias("_known"), F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    here = pages.select("page_id").distinct().withColumn("_here", F.lit(True))
    met = here.join(past, F.col("page_id") == F.col("_known"), "full").join(failed, F.col("page_id") == F.col("_failed"), "left")
    tried = F.col("_here") & (F.col("_known").isNull() | ((F.col("_status") != DONE) & (F.col("_attempts") < max_attempts)))
    outcome = F.when(F.col("_here").isNull(), F.lit(None).cast("string")).when(~tried, "skipped").when(F.col("_why").isNotNull(), "failed").otherwise("scraped")
    return met.select(
        F.coalesce("page_id", "_known").alias("page_id"),
        F.when(F.coalesce(tried, F.lit(False)), F.coalesce("_why", F.lit(DONE))).otherwise(F.col("_status")).alias("status"),
        (F.coalesce("_attempts", F.lit(0)) + F.when(F.coalesce(tried, F.lit(False)), 1).otherwise(0)).cast("int").alias("attempts"),
        outcome.alias("outcome"))


def counters() -> list[F.Column]:
    """Aggregates over the outcomes of a run; also for ``observe``."""
    return [F.count_if(F.col("outcome") == x).alias(x) for x in ("scraped", "skipped", "failed")] + [F.count("outcome").alias("total")]
