"""Training-corpus pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

1. toxicity: documents that the classifier chain rejects go.
2. jaccard: of every group of near duplicates one document stays.
3. decontaminate: documents with benchmark passages go.
4. secrets: secrets are redacted in the text.
5. mix: documents are drawn to the sources' target weights; the result has the
   documents that the mix takes, how much of each, and the shards of its draws.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm.chosen_path import keep_one_of_each
from pricelens.llm.common import prepare, table
from pricelens.llm.contamination import remove_contaminated
from pricelens.llm.mixing import mix
from pricelens.llm.secrets import redact
from pricelens.llm.toxicity import fit_chain, label_categories, remove_rejected
from pricelens.session import ensure_checkpoint_dir

# The classifier's training and the random draws are beyond SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), label_categories())
    return remove_rejected(docs, chain)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).filter("taken > 0")


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("decontaminate", decontaminate), ("secrets", secrets), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; intermediate tables go to the shared folder."""
    out = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
