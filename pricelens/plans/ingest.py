"""Ingestion queries over landed documents.

The driver's data holds no landed chart / catalog payloads, so Spark derives
them from ``lineitem`` / ``part`` (one chart page per order line, catalog
pages of at most 150 products); the operators then parse them back.  The
oracles compute the expected rows straight from the source tables, so each
check is a full round trip through the parsers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pricelens.functions.numeric import rnd, rnd_sql
from pricelens.operators.cleaning import first_in_order
from pricelens.operators.resume import STATE_SCHEMA, counters, run_state
from pricelens.plans import views as V
from pricelens.plans.registry import register
from pricelens.session import checkpoint, ensure_checkpoint_dir
from pricelens.sources.cpi import load_cpi
from pricelens.sources.landed import catalog_rows, chart_points, ingest_status, read_game_documents
from pricelens.sources.tables import read_csv, split_corrupt

RUN1_BEFORE = "1998-01-01"   # pages landed before this date were ingested by an earlier run


def chart_pages(p: V.Panel):
    li = p.table("lineitem")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string")
    cents = rnd(F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity") * 100), 0) \
        .cast("bigint").cast("string")
    cib = (rnd(F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity") * 100), 0) + 100) \
        .cast("bigint").cast("string")
    full = F.concat(F.lit('<html><head><script>var x=1;VGPC.chart_data = {"used": [['), ms, F.lit(","), cents,
                    F.lit(']], "cib": [['), ms, F.lit(","), cib, F.lit(']], "new": [['), ms, F.lit(",0],["), ms,
                    F.lit(","), cents, F.lit(',7]], "foo": [['), ms, F.lit(',5]]};</script></head><body></body></html>'))
    empty = F.concat(F.lit('<html><script>VGPC.chart_data = {"new": [['), ms, F.lit(',0]]};</script></html>'))
    fetch_error = (ln == 6) & (k % 5 == 0)
    html = (F.when(fetch_error, F.lit(None).cast("string"))
            .when(ln == 7, F.lit("<html><body>no chart here</body></html>"))
            .when((ln == 5) & (k % 4 == 0), empty)
            .otherwise(full))
    # (order, line, part, ship date) identifies a line; order and line alone do not
    page_id = F.concat_ws("-", k.cast("string"), ln.cast("string"), F.col("l_partkey").cast("string"),
                          F.date_format("l_shipdate", "yyyyMMdd"))
    return li.select(page_id.alias("page_id"), F.col("l_partkey").alias("item_id"),
                     F.col("l_shipdate").cast("date").alias("landed"),
                     F.when(fetch_error, 500).otherwise(200).alias("http_status"), html.alias("html"))


_PAGE_ID = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || "
            "CAST(l_partkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d')")
_CENTS = rnd_sql("CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity * 100 END", 0)
_CHART_ROWS_SQL = f"""
    SELECT page_id, item_id, condition, date, price_usd FROM (
      SELECT {_PAGE_ID} AS page_id, l_partkey AS item_id, CAST(l_shipdate AS DATE) AS date,
             CAST({_CENTS} AS BIGINT) AS cents, l_orderkey, l_linenumber
      FROM lineitem) s,
      LATERAL (SELECT 'loose' AS condition, {rnd_sql('s.cents / 100.0', 2)} AS price_usd WHERE s.cents > 0
               UNION ALL SELECT 'cib', {rnd_sql('(s.cents + 100) / 100.0', 2)} WHERE s.cents + 100 > 0) c
    WHERE NOT (l_linenumber = 6 AND l_orderkey % 5 = 0) AND l_linenumber <> 7
      AND NOT (l_linenumber = 5 AND l_orderkey % 4 = 0)"""


def price_point_rows(points, p: V.Panel):
    """Parsed points in the price-history schema: an (unknown) metadata id as
    a typed NULL column, title and console of the item, the page as URL."""
    it = p.items.select("item_id", "title", F.col("platform").alias("console"))
    return points.join(it, "item_id", "left").select(
        F.lit(None).cast("bigint").alias("metadata_id"), "title", "console", "condition", "date", "price_usd",
        F.col("page_id").alias("pc_url"))


@register("chart_ingest", covers=("A6", "K3", "J1", "I2", "B6", "B10", "C5", "A2"),
          oracle=lambda: V.with_views(f"""
    SELECT CAST(NULL AS BIGINT) AS metadata_id, i.title, i.platform AS console, r.condition, r.date, r.price_usd,
           r.page_id AS pc_url
    FROM ({_CHART_ROWS_SQL}) r LEFT JOIN items i ON r.item_id = i.item_id"""))
def chart_ingest(spark, sf_dir):
    p = V.Panel(spark, sf_dir)
    return price_point_rows(chart_points(chart_pages(p), extra=["item_id"]), p)


@register("ingest_status", covers=("A12",),
          oracle=f"""
    SELECT {_PAGE_ID} AS page_id,
           CASE WHEN l_linenumber = 6 AND l_orderkey % 5 = 0 THEN 'fetch_error'
                WHEN l_linenumber = 7 THEN 'no_data' ELSE 'empty' END AS status
    FROM lineitem
    WHERE (l_linenumber = 6 AND l_orderkey % 5 = 0) OR l_linenumber = 7 OR (l_linenumber = 5 AND l_orderkey % 4 = 0)""")
def ingest_status_query(spark, sf_dir):
    return ingest_status(chart_pages(V.Panel(spark, sf_dir)))


def remaining_work(todo, done, key: str):
    """Keys still to process: anti-join against the keys already written."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


@register("ingest_resume", covers=("A11", "C18"),
          oracle=f"SELECT page_id, condition, date, price_usd FROM ({_CHART_ROWS_SQL}) r "
                 f"WHERE date >= DATE '{RUN1_BEFORE}'")
def ingest_resume(spark, sf_dir):
    """Second run of an incremental ingest: pages already present in the first
    run's output are skipped (failed pages are retried), only new points are
    appended."""
    pages = chart_pages(V.Panel(spark, sf_dir))
    first_run = chart_points(pages.where(F.col("landed") < F.lit(RUN1_BEFORE).cast("date")))
    return chart_points(remaining_work(pages, first_run, "page_id"))


@register("ingest_counters", covers=("A18", "A11"),
          oracle=f"""
    WITH pages AS (SELECT CAST(l_shipdate AS DATE) AS landed,
                          (l_linenumber = 6 AND l_orderkey % 5 = 0) OR l_linenumber = 7 OR (l_linenumber = 5 AND l_orderkey % 4 = 0) AS bad
                   FROM lineitem),
         runs AS (SELECT 1 AS run, 0 AS tried_before, * FROM pages WHERE landed < DATE '{RUN1_BEFORE}'
                  UNION ALL SELECT r, CASE WHEN landed < DATE '{RUN1_BEFORE}' THEN r - 1 ELSE r - 2 END, pages.* FROM pages, range(2, 5) t(r)),
         done AS (SELECT run, CASE WHEN tried_before = 0 OR (bad AND tried_before < 3) THEN CASE WHEN bad THEN 'failed' ELSE 'scraped' END
                                   ELSE 'skipped' END AS outcome FROM runs)
    SELECT CAST(run AS INTEGER) AS run, count(*) FILTER (outcome = 'scraped') AS scraped, count(*) FILTER (outcome = 'skipped') AS skipped,
           count(*) FILTER (outcome = 'failed') AS failed, count(*) AS total FROM done GROUP BY run""")
def ingest_counters(spark, sf_dir):
    """Four runs of a resumed ingest: the first has the pages landed by its time, the
    others all pages; failed ones are tried three times."""
    pages = chart_pages(V.Panel(spark, sf_dir))
    state, out = spark.createDataFrame([], STATE_SCHEMA), None
    for run in (1, 2, 3, 4):
        seen = checkpoint(run_state(pages.where(F.col("landed") < F.lit(RUN1_BEFORE).cast("date")) if run == 1 else pages, state))
        state = seen.drop("outcome")
        row = seen.agg(*counters()).select(F.lit(run).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# Price points as a landed CSV file has them.
LANDED_POINT = StructType([StructField("item_id", LongType()), StructField("title", StringType()), StructField("price", DoubleType()),
                           StructField("year", IntegerType())])


@register("landed_points", covers=("A1", "A12"),
          oracle=lambda: V.with_views(f"""
    SELECT CASE WHEN ok THEN k END AS item_id, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN price END AS price,
           CASE WHEN ok THEN 2001 END AS year, CASE WHEN ok THEN 'ok' ELSE 'malformed' END AS status,
           CASE WHEN ok THEN NULL WHEN k % 10 = 0 THEN CAST(k AS VARCHAR) || ',broken,n/a,2001' ELSE CAST(k AS VARCHAR) || ',short' END AS raw
    FROM (SELECT p_partkey AS k, p_partkey % 10 > 1 AS ok, 'A "quoted", ' || p_name AS title,
                 {rnd_sql('p_retailprice', 2)} AS price FROM part)"""))
def landed_points(spark, sf_dir):
    """A landed CSV file scanned with a fixed schema; rows that do not fit it go to the dead letters."""
    k, title = F.col("p_partkey").cast("string"), F.concat(F.lit('"A ""quoted"", '), F.col("p_name"), F.lit('"'))
    price = rnd("p_retailprice", 2).cast("decimal(18,2)").cast("string")
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat(k, F.lit(",broken,n/a,2001"))).when(F.col("p_partkey") % 10 == 1, F.concat(k, F.lit(",short"))) \
        .otherwise(F.concat_ws(",", k, title, price, F.lit("2001")))
    path = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4()}"
    V.Panel(spark, sf_dir).table("part").select(line).write.text(path)
    good, dead = split_corrupt(read_csv(spark, path, LANDED_POINT, header=False))
    return good.withColumn("status", F.lit("ok")).unionByName(dead, allowMissingColumns=True)


@register("landed_documents", covers=("A8", "A12"),
          oracle="""
    SELECT p_partkey AS id, 'Game ' || p_name AS name, CAST(p_partkey % 4 AS INTEGER) AS category, 'ok' AS status FROM part WHERE p_partkey % 6 <> 0
    UNION ALL SELECT NULL, NULL, NULL, 'malformed' FROM part WHERE p_partkey % 6 = 0""")
def landed_documents(spark, sf_dir):
    """A landed file of JSON documents with broken lines."""
    doc = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("Game "), F.col("p_name")).alias("name"), (F.col("p_partkey") % 4).alias("category")))
    line = F.when(F.col("p_partkey") % 6 == 0, F.substring(doc, 1, 25)).otherwise(doc)
    path = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4()}"
    V.Panel(spark, sf_dir).table("part").select(line).write.text(path)
    good, dead = read_game_documents(spark, path)
    rows = good.select("id", "name", F.col("category").cast("int").alias("category"), F.lit("ok").alias("status"))
    return rows.unionByName(dead.select("status"), allowMissingColumns=True)


@register("landed_index", covers=("A4",),
          oracle=f"""
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {rnd_sql('avg(l_extendedprice)', 2)} AS value FROM lineitem
    WHERE year(l_shipdate) % 3 <> 0 GROUP BY 1""")
def landed_index(spark, sf_dir):
    """A landed price-index file: padded headers in odd case, a column too many, years without a value."""
    yearly = V.Panel(spark, sf_dir).table("lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(rnd(F.avg("l_extendedprice"), 2).alias("v"))
    value = F.when(F.col("y") % 3 == 0, F.lit("n/a")).otherwise(F.col("v").cast("decimal(18,2)").cast("string"))
    path = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4()}"
    yearly.select(F.lit("x").alias("Note"), F.col("y").cast("string").alias(" YEAR "), value.alias(" Annual")).write.option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return load_cpi(spark, path)


@register("page_status", covers=("A6", "A12"),
          oracle="""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           CAST(len(regexp_extract_all(html, '<a href="/')) AS INTEGER) AS n_links, 'no_data' AS status FROM pages""")
def page_status(spark, sf_dir):
    """The landed web pages through the chart parser: titles, site links, and the dead letters of pages without a chart."""
    pages = V.Panel(spark, sf_dir).table("pages")
    dead = ingest_status(pages.withColumn("http_status", F.lit(200))).withColumnRenamed("page_id", "_id")
    seen = pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                        F.regexp_count("html", F.lit('<a href="/')).alias("n_links"))
    return seen.join(dead, F.col("page_id") == F.col("_id"), "left").drop("_id")


PAGE_SIZE = 150


def catalog_pages(p: V.Panel):
    """Landed catalog API pages: per platform, at most 150 products a page."""
    it = p.items.select("item_id", "title", "platform")
    uri = F.lower(F.regexp_replace("platform", " ", "-"))
    prod = F.concat(F.lower(F.regexp_replace(F.regexp_replace("title", "#", ""), " ", "-")), F.lit("-"),
                    F.col("item_id").cast("string"))
    # item_id mod 7 fixes the platform, so 7 * 150 consecutive keys hold 150 of one platform
    page = (F.col("item_id") / (7 * PAGE_SIZE)).cast("bigint")
    g = it.groupBy("platform", page.alias("page")).agg(
        F.collect_list(F.struct(F.col("title").alias("productName"), uri.alias("consoleUri"),
                                prod.alias("productUri"))).alias("products"))
    return g.select(F.col("platform").alias("console"),
                    F.to_json(F.struct("products", F.col("page").cast("string").alias("cursor"))).alias("body"))


@register("catalog_ingest", covers=("A5", "H6", "D9", "A2"),
          oracle=lambda: V.with_views("""
    SELECT title, platform AS console,
           'https://catalog.example.org/game/' || lower(replace(platform, ' ', '-')) || '/'
           || lower(replace(replace(title, '#', ''), ' ', '-')) || '-' || CAST(item_id AS VARCHAR) AS url
    FROM items"""))
def catalog_ingest(spark, sf_dir):
    rows = catalog_rows(catalog_pages(V.Panel(spark, sf_dir)))
    return first_in_order(rows.withColumn("_o", F.col("url")), ["url"], ["_o"]).drop("_o")


@register("event_props", covers=("K1",),
          oracle="""
    SELECT event_id, k AS key, CAST(json_extract(props, '$."' || k || '"') AS DOUBLE) AS value
    FROM events, unnest(json_keys(props)) t(k)""")
def event_props(spark, sf_dir):
    """Map literals stored as text -> (id, key, value) rows (parsed once)."""
    from pricelens.functions.nested import parse_price_map
    ev = V.Panel(spark, sf_dir).table("events")
    return ev.select("event_id", F.explode(parse_price_map(F.col("props"))).alias("key", "value"))
