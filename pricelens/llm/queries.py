"""The ``opN_*`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


def _oracle(module: str) -> str:
    return importlib.import_module(f"pricelens.llm.{module}").QUERY_SQL


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.tokens import load_vocabulary, token_counts
    return token_counts(table(spark, sf_dir, "documents"), load_vocabulary())


@register("op7_perspective_rotation", _oracle("chat"))
def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.chat import rotate_perspectives
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


@register("op8_suffix_decontamination", _oracle("contamination"))
def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.contamination import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


@register("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.mixing import mix
    drawn = mix(table(spark, sf_dir, "documents"), with_columns=False)
    return drawn.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"), "shard_order")


@register("op3_secret_scan", _oracle("secrets"))
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.secrets import digest
    return digest(table(spark, sf_dir, "documents"))


@register("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents")).drop("licenses")


@register("op1_substring_dedup", _oracle("substrings"))
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.substrings import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("intervals")


@register("op4_toxicity_chain")
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.toxicity import fit_chain, label_categories, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels"), label_categories()))


@register("op6_chosen_path_join")
def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.chosen_path import jaccard_join
    return jaccard_join(table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", _oracle("negatives"))
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.negatives import anchors_of_query, mine_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), anchors_of_query())


@register("op12_vector_codes", _oracle("codes"))
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.codes import code_digest
    return code_digest(table(spark, sf_dir, "embeddings"))


@register("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pricelens.llm.language import language_digest
    return language_digest(table(spark, sf_dir, "documents"))
