"""Title normalisation and reconciliation queries.

The driver's data has no second catalogue, so the right-hand tables are
derived by Spark from ``part`` (and ``lineitem`` units): a sales listing whose
titles are re-cased / punctuated copies (exact matches), copies with a typo
(fuzzy matches) or absent (unmatched); and a metadata catalogue whose names
share all, most or few key words with the item titles.  Both grow with the
data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.functions.text import (
    STOP_WORDS, key_words, normalize_folded, normalize_plain, UNIT_NULL_TEXTS)
from pricelens.operators.matching import containment_match, match_titles
from pricelens.plans import views as V
from pricelens.plans.registry import register

SALES_BASE_URL = "https://sales.example.org"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _platform_expr():
    return F.element_at(F.array(*[F.lit(p) for p in V.PLATFORMS]), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))


SALES_PAGE_ROWS = 200


def sales_pages(p: V.Panel):
    """Landed sales-table pages: per platform, at most 200 listing rows a page
    inside the results container, plus a header row, a short row, a row whose
    link is not a game page and a row without title (all to be skipped)."""
    part = p.table("part")
    u = p.units
    j = part.join(u, part.p_partkey == u.item_id, "left")
    k = F.col("p_partkey")
    title = (F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit(": "), F.col("p_brand")))
             .when(k % 3 == 1, F.concat(F.col("p_name"), F.lit(" "), F.regexp_replace("p_brand", "Brand#", "Brnd#"))))
    glob = F.when(k % 10 == 0, F.lit("N/A")).otherwise(
        F.concat(rnd(F.col("units_global") / 1000.0, 2).cast("decimal(18,2)").cast("string"), F.lit("m")))
    na = F.when(F.col("units_na").isNull(), F.lit("—")).otherwise(
        F.concat(rnd(F.col("units_na") / 1000.0, 2).cast("decimal(18,2)").cast("string"), F.lit("m")))
    href = F.when(k % 2 == 0, F.concat(F.lit("/game/"), k.cast("string"), F.lit("/"))) \
            .otherwise(F.concat(F.lit(SALES_BASE_URL + "/game/"), k.cast("string"), F.lit("/")))

    def td(x):
        return F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), td(k.cast("string")), td(F.lit('<img src="/b.png">')),
                   td(F.concat(F.lit('<a href="'), href, F.lit('">'), title, F.lit("</a>"))),
                   td(F.lit("Publisher")), td(F.lit("-")), td(glob), td(na), td(F.lit("01st Jan 01")), F.lit("</tr>"))
    listed = j.where(k % 3 != 2).select(_platform_expr().alias("console"),
                                        (k / (7 * SALES_PAGE_ROWS)).cast("bigint").alias("page"), k.alias("seq"), row.alias("row"))
    pages = listed.groupBy("console", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "row"))).alias("rows"))
    skipped = ("<tr><th>Pos</th><th>Game</th></tr>"
               "<tr><td>1</td><td>2</td><td><a href=\"/game/x/\">short</a></td></tr>"
               "<tr><td>1</td><td></td><td><a href=\"/news/1/\">Not a game</a></td><td></td><td></td><td>1.0m</td><td></td><td></td></tr>"
               "<tr><td>1</td><td></td><td><a href=\"/game/2/\"> </a></td><td></td><td></td><td>1.0m</td><td></td><td></td></tr>")
    html = F.concat(F.lit('<html><body><div id="nav"><table><tr><td>menu</td></tr></table></div>'
                          '<div id="generalBody"><table>' + skipped),
                    F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table></div></body></html>"))
    return pages.select("console", "page", html.alias("html"))


def sales_listing(p: V.Panel):
    """Sales rows parsed from the landed pages, with their listing order."""
    from pricelens.sources.landed import sales_table_rows
    rows = sales_table_rows(sales_pages(p), base_url=SALES_BASE_URL)
    seq = F.regexp_extract("sales_url", r"/game/(\d+)/", 1).cast("bigint")
    return rows.select("title", F.col("console").alias("platform"), seq.alias("seq"), "sales_url",
                       "units_global_m", "units_na_m")


_SALES_SQL = f"""
    SELECT title, platform, seq,
           CASE WHEN starts_with(href, 'http') THEN href ELSE '{SALES_BASE_URL}' || href END AS sales_url,
           {{units_g}} AS units_global_m, {{units_n}} AS units_na_m
    FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ': ' || p_brand
                      WHEN p_partkey % 3 = 1 THEN p_name || ' ' || replace(p_brand, 'Brand#', 'Brnd#') END AS title,
                 CASE WHEN p_partkey % 2 = 0 THEN '/game/' || CAST(p_partkey AS VARCHAR) || '/'
                      ELSE '{SALES_BASE_URL}/game/' || CAST(p_partkey AS VARCHAR) || '/' END AS href,
                 list_extract({V._sql_list(V.PLATFORMS)}, CAST(p_partkey % 7 + 1 AS INTEGER)) AS platform,
                 CASE WHEN p_partkey % 10 = 0 THEN 'N/A'
                      ELSE CAST(CAST({rnd_sql('u.units_global / 1000.0', 2)} AS DECIMAL(18,2)) AS VARCHAR) || 'm' END AS ug,
                 CASE WHEN u.units_na IS NULL THEN '—'
                      ELSE CAST(CAST({rnd_sql('u.units_na / 1000.0', 2)} AS DECIMAL(18,2)) AS VARCHAR) || 'm' END AS un,
                 p_partkey AS seq
          FROM part LEFT JOIN units u ON part.p_partkey = u.item_id
          WHERE p_partkey % 3 <> 2) s"""


def units_sql(expr: str) -> str:
    t = f"lower(trim({expr}))"
    nulls = ", ".join(_q(x) for x in UNIT_NULL_TEXTS)
    num = f"regexp_extract({t}, '([0-9.]+)m', 1)"
    return f"CASE WHEN {t} IS NULL OR {t} IN ({nulls}) OR {num} = '' THEN NULL ELSE TRY_CAST({num} AS DOUBLE) END"


def plain_sql(expr: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(lower({expr}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')"


def folded_sql(expr: str) -> str:
    f = f"regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({f}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def key_words_sql(norm: str) -> str:
    stop = ", ".join(_q(w) for w in STOP_WORDS + [""])
    return f"list_filter(list_distinct(string_split(coalesce({norm}, ''), ' ')), lambda x: x NOT IN ({stop}))"


def _sales_cte():
    return _SALES_SQL.replace("{units_g}", units_sql("ug")).replace("{units_n}", units_sql("un"))


@register("sales_listing", covers=("A7", "H4", "H6", "H10"),
          oracle=lambda: V.with_views("SELECT * FROM sales", ("sales", _sales_cte())))
def sales_listing_query(spark, sf_dir):
    return sales_listing(V.Panel(spark, sf_dir))


_MATCH_SQL = f"""
    WITH sn AS (SELECT platform, norm, arg_min(struct_pack(seq := seq, units_global_m := units_global_m,
                                                            units_na_m := units_na_m, sales_url := sales_url), seq) AS r
                FROM (SELECT *, {plain_sql('title')} AS norm FROM sales) GROUP BY platform, norm),
         l AS (SELECT item_id, platform, {plain_sql('title')} AS norm FROM items),
         ex AS (SELECT l.item_id, 'exact' AS match_type, 100.0::DOUBLE AS match_score, sn.r
                FROM l JOIN sn ON l.platform = sn.platform AND l.norm = sn.norm),
         rest AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.platform = l.platform AND sn.norm = l.norm)),
         sc AS (SELECT rest.item_id, sn.r,
                       CASE WHEN greatest(length(rest.norm), length(sn.norm)) > 0
                            THEN 100.0 * (1.0 - levenshtein(rest.norm, sn.norm) / greatest(length(rest.norm), length(sn.norm)))
                            ELSE 100.0 END AS score
                FROM rest JOIN sn ON rest.platform = sn.platform),
         fz AS (SELECT item_id, 'fuzzy' AS match_type, {rnd_sql('max(score)', 1)} AS match_score,
                       arg_max(r, struct_pack(s := score, n := -r.seq)) AS r
                FROM sc WHERE score >= 85 GROUP BY item_id),
         m AS (SELECT * FROM ex UNION ALL SELECT * FROM fz)
    SELECT i.item_id, coalesce(m.match_type, 'unmatched') AS match_type, m.match_score,
           m.r.units_global_m AS units_global_m, m.r.units_na_m AS units_na_m, m.r.sales_url AS sales_url
    FROM items i LEFT JOIN m ON i.item_id = m.item_id"""


@register("title_match", headline=True, covers=("C9", "C10", "C11", "D9", "H2", "F1"),
          oracle=lambda: V.with_views(_MATCH_SQL, ("sales", _sales_cte())))
def title_match(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    m = match_titles(p.items.select("item_id", "title", "platform"), sales_listing(p),
                     payload=["units_global_m", "units_na_m", "sales_url"])
    return m.select("item_id", "match_type", "match_score", "units_global_m", "units_na_m", "sales_url")


@register("weighted_title_match", covers=("C10",))
def weighted_title_match(spark, sf_dir):
    """:func:`title_match` by the weighted ratio: word order, subtitles and parts of titles count."""
    p = V.Panel(spark, sf_dir)
    m = match_titles(p.items.select("item_id", "title", "platform"), sales_listing(p),
                     payload=["units_global_m", "units_na_m", "sales_url"], scorer="weighted")
    return m.select("item_id", "match_type", "match_score", "units_global_m", "units_na_m", "sales_url")


def metadata_catalog(p: V.Panel):
    """Derived metadata entries: names sharing all / most / some key words."""
    part = p.table("part")
    k = F.col("p_partkey")
    name = (F.when(k % 4 == 0, F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")))
            .when(k % 4 == 1, F.concat(F.lit("The "), F.col("p_name"), F.lit(" of "), F.regexp_replace("p_brand", "#", " ")))
            .when(k % 4 == 2, F.concat(F.col("p_name"), F.lit(" brand")))
            .otherwise(F.concat(F.col("p_name"), F.lit(" deluxe"))))
    g = part.select((k + 100000).alias("id"), name.alias("name"), _platform_expr().alias("platform"),
                    F.when(F.col("p_size") % 3 == 0, 0).otherwise(1).alias("category"),
                    (F.lit(1990) + F.col("p_size") % 12).alias("year"))
    rng = p.platform_dim.select("platform", "year_lo", "year_hi")
    return g.join(F.broadcast(rng), "platform", "left")


_META_SQL = f"""
    SELECT p_partkey + 100000 AS id,
           CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_brand
                              WHEN 1 THEN 'The ' || p_name || ' of ' || replace(p_brand, '#', ' ')
                              WHEN 2 THEN p_name || ' brand' ELSE p_name || ' deluxe' END AS name,
           list_extract({V._sql_list(V.PLATFORMS)}, CAST(p_partkey % 7 + 1 AS INTEGER)) AS platform,
           CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS category, 1990 + p_size % 12 AS year
    FROM part"""

_CONTAIN_SQL = f"""
    WITH b AS (SELECT m.*, {folded_sql('m.name')} AS norm, d.year_lo, d.year_hi FROM meta m
               LEFT JOIN platform_dim d ON m.platform = d.platform),
         b2 AS (SELECT *, {key_words_sql('norm')} AS kw,
                       struct_pack(a := CASE WHEN coalesce(category, 99) = 0 THEN 0 ELSE 1 END,
                                   b := CASE WHEN year BETWEEN year_lo AND year_hi THEN 0 ELSE 1 END,
                                   c := coalesce(id, 999999), d := id) AS rk FROM b),
         a AS (SELECT item_id, platform, {folded_sql('title')} AS norm FROM items),
         a2 AS (SELECT *, {key_words_sql('norm')} AS kw,
                       EXISTS (SELECT 1 FROM b2 WHERE b2.platform = a.platform AND b2.norm = a.norm) AS has_bucket FROM a),
         c AS (SELECT a2.item_id, b2.rk,
                      CASE WHEN len(a2.kw) = 0 THEN 1.0 ELSE len(list_intersect(a2.kw, b2.kw)) / len(a2.kw) END AS score
               FROM a2 JOIN b2 ON a2.platform = b2.platform AND (NOT a2.has_bucket OR a2.norm = b2.norm)),
         best AS (SELECT item_id, max(score) AS best FROM c GROUP BY item_id),
         pick AS (SELECT c.item_id, arg_min(struct_pack(rk := c.rk, s := c.score), struct_pack(rk := c.rk, s := c.score)) AS m
                  FROM c JOIN best ON c.item_id = best.item_id
                  WHERE best.best >= 0.6 AND c.score >= best.best - 0.05 GROUP BY c.item_id)
    SELECT i.item_id, pick.m.rk.d AS match_id, pick.m.s AS match_score
    FROM items i LEFT JOIN pick ON i.item_id = pick.item_id"""


@register("containment_match", headline=True, covers=("C12", "E11", "H1", "H3", "G4"),
          oracle=lambda: V.with_views(_CONTAIN_SQL, ("meta", _META_SQL)))
def containment_match_query(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    return containment_match(p.items.select("item_id", "title", "platform"), metadata_catalog(p))


@register("text_normalize", headline=True, covers=("H1", "H2", "H3", "H10"),
          oracle=lambda: f"""
    SELECT doc_id, md5({folded_sql('text')}) AS folded_md5, md5({plain_sql('text')}) AS plain_md5,
           CAST(len({key_words_sql(folded_sql('text'))}) AS INTEGER) AS n_key_words
    FROM documents""")
def text_normalize(spark, sf_dir):
    """Whole-document normalisation (accent folding and plain), key-word count."""
    d = V.Panel(spark, sf_dir).table("documents")
    folded = normalize_folded(F.col("text"))
    return d.select("doc_id", F.md5(folded).alias("folded_md5"), F.md5(normalize_plain(F.col("text"))).alias("plain_md5"),
                    F.size(key_words(folded)).alias("n_key_words"))
