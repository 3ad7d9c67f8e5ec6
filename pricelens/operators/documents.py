"""Flattening nested metadata documents and summarising related entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.nested import (
    earliest_release_year, first_publisher, first_rating_label, relation_type, release_year_for_platform,
    rerelease_ids, struct_names, valid_rerelease)
from pricelens.functions.numeric import score_delta


def flatten_documents(docs: DataFrame, platform_col: str = "platform_id") -> DataFrame:
    """One flat row per document: lists become ``|``-joined text (an empty
    genre list -> NULL, an empty franchise list -> '')."""
    genres = F.array_join(struct_names("genres"), "|")
    fr = F.coalesce(F.col("franchises"), F.array())
    return docs.select(
        F.col("id"), F.col(platform_col),
        F.when(genres != "", genres).alias("genre"),
        first_publisher("involved_companies").alias("publisher"),
        first_rating_label("age_ratings").alias("esrb"),
        release_year_for_platform("release_dates", F.col(platform_col)).alias("release_year"),
        F.array_join(F.transform(F.filter(fr, lambda f: f["id"].isNotNull()), lambda f: f["id"].cast("string")), "|")
         .alias("franchise_ids"),
        F.array_join(struct_names(fr), "|").alias("franchise_names"),
        F.col("aggregated_rating").alias("critic_score"), F.col("rating").alias("user_score"),
        F.col("aggregated_rating_count").alias("rating_count"),
        score_delta("aggregated_rating", "rating").alias("critic_user_score_delta"),
        F.coalesce(F.col("category"), F.lit(0)).alias("category"),
        relation_type("remakes", "remasters", "ports").alias("relation_type"),
        F.size(rerelease_ids("remakes", "remasters", "ports")).alias("n_related"),
    )


def rerelease_summary(docs: DataFrame, details: DataFrame, platform_col: str = "platform_id") -> DataFrame:
    """Per document: look up its related entries (remakes, remasters, ports)
    among ``details`` by id, keep the valid ones (a dated region-2 release,
    not only on the original platform) and summarise: primary entry = most
    rated (lowest id on ties), its earliest year and scores, and the valid ids
    in ascending order.  Ids without details are dropped; documents with no
    valid entry get ``rerelease_exists = false``."""
    rel = docs.select("id", F.col(platform_col).alias("_pid"),
                      relation_type("remakes", "remasters", "ports").alias("rerelease_type"),
                      F.explode(rerelease_ids("remakes", "remasters", "ports")).alias("rid"))
    det = details.select(F.col("id").alias("rid"), "name", "release_dates", "platforms",
                         "aggregated_rating", "rating", "aggregated_rating_count")
    j = rel.join(det, "rid").where(valid_rerelease("release_dates", "platforms", "_pid"))
    primary = F.struct(F.coalesce("aggregated_rating_count", F.lit(0)).alias("cnt"), (-F.col("rid")).alias("neg"),
                       "aggregated_rating", "rating", earliest_release_year("release_dates").alias("year"))
    g = j.groupBy("id").agg(
        F.max(primary).alias("_p"), F.first("rerelease_type").alias("rerelease_type"),
        F.array_sort(F.collect_list("rid")).alias("_ids"),
        F.array_sort(F.collect_list(F.struct("rid", "name"))).alias("_names"))
    s = g.select(
        "id", F.lit(True).alias("rerelease_exists"), "rerelease_type",
        F.col("_p.year").alias("rerelease_year"),
        F.col("_p.aggregated_rating").alias("rerelease_critic_score"),
        F.col("_p.rating").alias("rerelease_user_score"),
        score_delta(F.col("_p.aggregated_rating"), F.col("_p.rating")).alias("rerelease_critic_user_delta"),
        F.array_join(F.transform("_ids", lambda x: x.cast("string")), "|").alias("rerelease_ids"),
        F.array_join(F.transform("_names", lambda x: x["name"]), "|").alias("rerelease_names"))
    out = docs.select("id").join(s, "id", "left")
    return out.withColumn("rerelease_exists", F.coalesce("rerelease_exists", F.lit(False)))
