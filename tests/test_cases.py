"""Every label, status and reason occurs in the derived-case queries."""

from pyspark.sql import functions as F

from pricelens.functions.text import VARIANT_RULES
from pricelens.plans.registry import all_queries

SF = "/root/testdata/sf0.01"
Q = all_queries()


def test_every_class_of_title_occurs(spark):
    rows = Q["title_tags"].build(spark, SF).groupBy("variant_type", "is_hardware").count().collect()
    assert {r.variant_type for r in rows} == {label for label, _ in VARIANT_RULES} | {"variant", "standard"}
    assert {r.is_hardware for r in rows} == {True, False}
    share = Q["accessories_by_platform"].build(spark, SF).agg(F.min("n_hardware"), F.max("share"), F.count("*")).first()
    assert share[0] > 0 and share[1] < 1 and share[2] == 7


def test_markers_are_dropped_and_nulls_kept(spark):
    got = {r.condition: r.n_points for r in Q["sentinel_points"].build(spark, SF).collect()}
    assert set(got) == {"A", "N", "R", None} and min(got.values()) > 0


def test_duplicates_occur(spark):
    got = {r.exclusion_reason: r["count"] for r in Q["copied_histories"].build(spark, SF).groupBy("exclusion_reason").count().collect()}
    assert got["duplicate_price_history"] > 500 and got[None] > 500


def test_split_keeps_items_whole(spark):
    rows = Q["item_split"].build(spark, SF)
    per = rows.groupBy("item_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"))
    assert per.filter("n > 1").count() == 0
    share = per.agg(F.avg((F.col("s") == "validation").cast("double"))).first()[0]
    assert 0.05 < share < 0.15
