"""The whole item feature table (every per-item feature in one row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.operators.forecast import shift_time_varying
from pricelens.plans import cleaning, documents, franchise, trends
from pricelens.plans.registry import all_queries, register

# (component query, columns it contributes); all keyed by item_id except the
# document queries, keyed by id.
COMPONENTS = [
    ("real_price_trends", None),
    ("release_prices", None),
    ("current_vs_genre", None),
    ("price_vs_market", None),
    ("franchise_features", None),
    ("competition", None),
    ("units_log", None),
    ("quarantine", ["price_record_count", "is_variant", "variant_type", "exclusion_reason"]),
    ("document_flatten", ["critic_score", "user_score", "critic_user_score_delta", "esrb"]),
    ("rerelease_summary", ["rerelease_exists", "rerelease_type", "rerelease_critic_score",
                           "rerelease_user_score", "rerelease_critic_user_delta"]),
    ("target_summary", ["target_real_price"]),
]


def _key(name: str) -> str:
    return "id" if name in ("document_flatten", "rerelease_summary") else "item_id"


def item_features(spark, sf_dir, scope=None):
    """Every feature of every item, as of the scope's cutoff; in a merged scope
    only included items, their corrected years and prices, also in the medians."""
    from pricelens.plans import views as V
    with V.materialized(spark, sf_dir, scope):
        return _item_features(spark, sf_dir)


def _item_features(spark, sf_dir):
    qs = all_queries()
    from pricelens.plans import views as V
    out = V.Panel(spark, sf_dir).items.select("item_id", "title", "platform", "release_year")
    for name, cols in COMPONENTS:
        df = qs[name].build(spark, sf_dir)
        k = _key(name)
        cols = cols or [c for c in df.columns if c not in (k, "genre", "publisher")]
        # held by item, a component needs no sort, nor do the rows it meets
        out = out.join(df.select(F.col(k).alias("item_id"), *cols).hint("shuffle_hash"), "item_id", "left")
    return out.withColumn("market_liquidity_score", F.coalesce("price_record_count", F.lit(0)))


def _oracle() -> str:
    qs = all_queries()
    parts, cols = [], ["i.item_id", "i.title", "i.platform", "i.release_year"]
    for n, (name, keep) in enumerate(COMPONENTS):
        k = _key(name)
        parts.append(f"LEFT JOIN ({qs[name].oracle}) c{n} ON i.item_id = c{n}.{k}")
        if keep:
            cols += [f"c{n}.{c}" for c in keep]
        else:
            cols.append(f"c{n}.* EXCLUDE ({k}{', genre, publisher' if name == 'current_vs_genre' else ''})")
    from pricelens.plans import views as V
    body = (f"SELECT {', '.join(cols)}, coalesce(c7.price_record_count, 0) AS market_liquidity_score "
            f"FROM items i {' '.join(parts)}")
    return V.with_views(body)


register("item_features", oracle=_oracle, headline=True,
         covers=("L20", "L9", "L10", "L11", "L12", "L13", "L14", "L15", "L16", "C1", "C2", "C3", "L19"))(item_features)


@register("production_features", covers=("L20",))
def production_features(spark, sf_dir):
    """The feature table of the production run: all history, included items."""
    from pricelens.plans import views as V
    return item_features(spark, sf_dir, V.PRODUCTION)


SHIFT_MONTHS = 36


def _shift_sql() -> str:
    release, franchise = (all_queries()[n].oracle for n in ("release_prices", "franchise_features"))
    return f"""
    SELECT r.item_id, CAST(m AS INTEGER) AS months_ahead, r.months_since_release + CAST(m AS INTEGER) AS months_since_release,
           r.months_since_discontinued + CAST(m AS INTEGER) AS months_since_discontinued,
           {rnd_sql('f.days_since_last_franchise_release + m * 30.44', 2)} AS days_since_last_franchise_release,
           {rnd_sql('CASE WHEN f.days_until_next_franchise_release IS NOT NULL THEN greatest(f.days_until_next_franchise_release - m * 30.44, 0.0) END', 2)}
             AS days_until_next_franchise_release
    FROM ({release}) r LEFT JOIN ({franchise}) f ON r.item_id = f.item_id, range(1, {SHIFT_MONTHS + 1}) t(m)"""


@register("inference_grid", covers=("M4", "N3"), oracle=_shift_sql)
def inference_grid(spark, sf_dir):
    """Every item's forecast months with the features that move on with the horizon."""
    qs = all_queries()
    base = qs["release_prices"].build(spark, sf_dir).select("item_id", "months_since_release", "months_since_discontinued")
    cadence = qs["franchise_features"].build(spark, sf_dir).select("item_id", "days_since_last_franchise_release", "days_until_next_franchise_release")
    months = F.explode(F.sequence(F.lit(1), F.lit(SHIFT_MONTHS))).alias("months_ahead")
    grid = shift_time_varying(base.join(cadence, "item_id", "left").select("*", months))
    return grid.select("item_id", "months_ahead", "months_since_release", "months_since_discontinued",
                       rnd("days_since_last_franchise_release", 2).alias("days_since_last_franchise_release"), rnd("days_until_next_franchise_release", 2).alias("days_until_next_franchise_release"))


_ = (cleaning, documents, franchise, trends)
