"""Nested metadata document queries.

Spark derives one nested document per ``part`` row (genres, companies,
ratings, release dates, related entries, franchises); the operators flatten
and summarise them.  The oracles compute the expected flat values directly
from the part columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.nested import ESRB_LABELS
from pricelens.functions.numeric import rnd
from pricelens.operators.documents import flatten_documents, rerelease_summary
from pricelens.plans import views as V
from pricelens.plans.registry import register


def game_documents(p: V.Panel):
    part = p.table("part")
    k, s = F.col("p_partkey"), F.col("p_size")
    pid = (F.pmod(k, F.lit(7)) + 1).cast("int")
    y1 = F.lit(1990) + s % 12

    def epoch(y, m, d):
        return F.unix_timestamp(F.make_timestamp(y, F.lit(m), F.lit(d), F.lit(0), F.lit(0), F.lit(0)))

    def ids(*xs):
        return F.array(*[x.cast("bigint") for x in xs])
    empty = F.array().cast("array<bigint>")
    return part.select(
        k.alias("id"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"), (s % 3).cast("int").alias("category"),
        F.when(s % 2 == 0, F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("Action").alias("name"))))
         .otherwise(F.array(F.struct(F.col("p_type").alias("name")))).alias("genres"),
        F.array(F.struct(F.struct(F.concat(F.lit("Studio "), (s % 5).cast("string")).alias("name")).alias("company"),
                         F.lit(False).alias("publisher")),
                F.struct(F.struct(F.col("p_brand").alias("name")).alias("company"),
                         (k % 5 != 0).alias("publisher"))).alias("involved_companies"),
        F.array(F.struct(F.lit(2).alias("organization"), F.lit(1).alias("rating_category")),
                F.struct(F.lit(1).alias("organization"), (s % 9).cast("int").alias("rating_category"))).alias("age_ratings"),
        F.when(k % 4 != 0, F.array(
            F.struct(epoch(y1, 3, 15).alias("date"), F.lit(1).alias("region"), pid.alias("platform")),
            F.struct(epoch(y1 + 1, 9, 1).alias("date"), F.lit(2).alias("region"), pid.alias("platform"))))
         .otherwise(F.array(F.struct(epoch(y1, 3, 15).alias("date"), F.lit(1).alias("region"), pid.alias("platform"))))
         .alias("release_dates"),
        rnd(F.col("p_retailprice") / 30, 2).alias("rating"), (s * 2.0).alias("aggregated_rating"),
        s.cast("int").alias("aggregated_rating_count"),
        F.when(k % 3 == 0, ids(pid, F.pmod(pid, F.lit(7)) + 1)).otherwise(ids(pid)).alias("platforms"),
        F.when((k % 6 == 0) | (k % 6 == 3), ids(k + 1)).otherwise(empty).alias("remakes"),
        F.when(k % 6 == 1, ids(k + 2)).otherwise(empty).alias("remasters"),
        F.when(k % 6 == 2, ids(k + 1, k + 3)).when(k % 6 == 3, ids(k + 1)).otherwise(empty).alias("ports"),
        F.array(F.struct((s / 10).cast("bigint").alias("id"),
                         F.concat(F.lit("S"), (s / 10).cast("int").cast("string")).alias("name"))).alias("franchises"),
        pid.alias("platform_id"),
    )


_LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ESRB_LABELS.items())
_FLAT_SQL = f"""
    SELECT p_partkey AS id, CAST(p_partkey % 7 + 1 AS INTEGER) AS platform_id,
           p_type || CASE WHEN p_size % 2 = 0 THEN '|Action' ELSE '' END AS genre,
           CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE 'Studio ' || CAST(p_size % 5 AS VARCHAR) END AS publisher,
           CASE p_size % 9 {_LABELS} END AS esrb,
           CAST(1990 + p_size % 12 + CASE WHEN p_partkey % 4 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS release_year,
           CAST(p_size // 10 AS VARCHAR) AS franchise_ids, 'S' || CAST(p_size // 10 AS VARCHAR) AS franchise_names,
           CAST(p_size * 2.0 AS DOUBLE) AS critic_score, CAST(floor(p_retailprice / 30 * 100 + 0.5 + 1e-5) / 100 AS DOUBLE) AS user_score,
           CAST(p_size AS INTEGER) AS rating_count,
           CASE WHEN p_size * 2.0 <> 0 AND CAST(floor(p_retailprice / 30 * 100 + 0.5 + 1e-5) / 100 AS DOUBLE) <> 0
                THEN CAST(floor((p_size * 2.0 - CAST(floor(p_retailprice / 30 * 100 + 0.5 + 1e-5) / 100 AS DOUBLE)) * 100 + 0.5 + 1e-5) / 100 AS DOUBLE) END
             AS critic_user_score_delta,
           CAST(p_size % 3 AS INTEGER) AS category,
           CASE WHEN p_partkey % 6 IN (0, 3) THEN 'remake' WHEN p_partkey % 6 = 1 THEN 'remaster'
                WHEN p_partkey % 6 = 2 THEN 'port' END AS relation_type,
           CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN 1 WHEN p_partkey % 6 = 2 THEN 2 ELSE 0 END AS n_related
    FROM part"""


@register("document_flatten", oracle=_FLAT_SQL,
          covers=("A8", "K4", "K5", "K6", "I10", "I2", "J5", "K7", "G2", "H5"))
def document_flatten(spark, sf_dir):
    return flatten_documents(game_documents(V.Panel(spark, sf_dir)))


_RR_SQL = """
    WITH rel AS (
        SELECT p_partkey AS id, CAST(p_partkey % 7 + 1 AS INTEGER) AS pid,
               CASE WHEN p_partkey % 6 IN (0, 3) THEN 'remake' WHEN p_partkey % 6 = 1 THEN 'remaster'
                    WHEN p_partkey % 6 = 2 THEN 'port' END AS rtype,
               unnest(CASE WHEN p_partkey % 6 IN (0, 3) THEN [p_partkey + 1] WHEN p_partkey % 6 = 1 THEN [p_partkey + 2]
                           WHEN p_partkey % 6 = 2 THEN [p_partkey + 1, p_partkey + 3] ELSE [] END) AS rid
        FROM part),
    det AS (
        SELECT p_partkey AS rid, p_name || ' ' || p_brand AS name, p_partkey % 4 <> 0 AS has_r2,
               CASE WHEN p_partkey % 3 = 0 THEN [p_partkey % 7 + 1, (p_partkey % 7 + 1) % 7 + 1]
                    ELSE [p_partkey % 7 + 1] END AS plats,
               CAST(p_size * 2.0 AS DOUBLE) AS critic, CAST(floor(p_retailprice / 30 * 100 + 0.5 + 1e-5) / 100 AS DOUBLE) AS usr, CAST(p_size AS INTEGER) AS cnt,
               CAST(1990 + p_size % 12 AS INTEGER) AS year
        FROM part),
    v AS (SELECT rel.*, det.* EXCLUDE (rid) FROM rel JOIN det ON rel.rid = det.rid
          WHERE det.has_r2 AND NOT (len(det.plats) > 0 AND list_has_all([rel.pid], det.plats))),
    s AS (SELECT id, any_value(rtype) AS rerelease_type,
                 arg_max(struct_pack(c := critic, u := usr, y := year), struct_pack(n := cnt, r := -rid)) AS p,
                 string_agg(CAST(rid AS VARCHAR), '|' ORDER BY rid) AS rerelease_ids,
                 string_agg(name, '|' ORDER BY rid) AS rerelease_names
          FROM v GROUP BY id)
    SELECT part.p_partkey AS id, s.id IS NOT NULL AS rerelease_exists, s.rerelease_type,
           s.p.y AS rerelease_year, s.p.c AS rerelease_critic_score, s.p.u AS rerelease_user_score,
           CASE WHEN s.p.c <> 0 AND s.p.u <> 0 THEN CAST(floor((s.p.c - s.p.u) * 100 + 0.5 + 1e-5) / 100 AS DOUBLE) END
             AS rerelease_critic_user_delta,
           s.rerelease_ids, s.rerelease_names
    FROM part LEFT JOIN s ON part.p_partkey = s.id"""


@register("rerelease_summary", oracle=_RR_SQL,
          covers=("C14", "B12", "F4", "K8", "I11", "C13", "G2", "K7", "J5"))
def rerelease_summary_query(spark, sf_dir):
    docs = game_documents(V.Panel(spark, sf_dir))
    return rerelease_summary(docs, docs)


@register("rerelease_labels", covers=("H11", "C13"),
          oracle="""
    WITH rr AS (""" + _RR_SQL + """)
    SELECT id, coalesce(split_part(rerelease_names, '|', 1), upper(substr(rerelease_type, 1, 1)) || substr(rerelease_type, 2),
                        'Re-release') || CASE WHEN rerelease_year IS NOT NULL THEN ' (' || CAST(rerelease_year AS VARCHAR) || ')' ELSE '' END
           AS label
    FROM rr WHERE rerelease_exists""")
def rerelease_labels(spark, sf_dir):
    """Display label of an item's re-release: first related name, else the
    capitalised relation type, else 'Re-release', plus the year."""
    from pricelens.functions.text import first_cap_label
    docs = game_documents(V.Panel(spark, sf_dir))
    s = rerelease_summary(docs, docs).where("rerelease_exists")
    names = F.when(F.col("rerelease_names") != "", F.split("rerelease_names", r"\|"))
    return s.select("id", first_cap_label(names, "rerelease_type", "rerelease_year").alias("label"))
