"""Parsers for landed raw documents (web pages, JSON API payloads).

Fetching is out of scope: these operators start from landed text columns
(e.g. files read with ``spark.read.text`` / ``wholetext`` or JSON lines) and
turn them into typed rows with built-in JSON / regex functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from pricelens.functions.dates import epoch_ms_to_date
from pricelens.functions.numeric import cents_to_dollars
from pricelens.sources.tables import read_json, split_corrupt

# Chart series keys and the condition names they are stored as.
CONDITION_MAP = {
    "used": "loose",
    "cib": "cib",
    "new": "new",
    "graded": "graded",
    "boxonly": "boxonly",
    "manualonly": "manualonly",
}

# Fixed value: the statement that holds a page's chart object.
CHART_PATTERN = r"(?s)VGPC\.chart_data\s*=\s*(\{.*?\});"
CHART_TYPE = "map<string,array<array<bigint>>>"

CATALOG_PAGE = StructType([
    StructField("products", ArrayType(StructType([
        StructField("productName", StringType()),
        StructField("consoleUri", StringType()),
        StructField("productUri", StringType()),
    ]))),
    StructField("cursor", StringType()),
])

_NAME = StructType([StructField("name", StringType())])
GAME_DOCUMENT = StructType([
    StructField("id", LongType()),
    StructField("name", StringType()),
    StructField("category", IntegerType()),
    StructField("genres", ArrayType(_NAME)),
    StructField("involved_companies", ArrayType(StructType([
        StructField("company", _NAME), StructField("publisher", BooleanType())]))),
    StructField("age_ratings", ArrayType(StructType([
        StructField("organization", IntegerType()), StructField("rating_category", IntegerType())]))),
    StructField("release_dates", ArrayType(StructType([
        StructField("date", LongType()), StructField("region", IntegerType()), StructField("platform", IntegerType())]))),
    StructField("rating", DoubleType()),
    StructField("aggregated_rating", DoubleType()),
    StructField("aggregated_rating_count", IntegerType()),
    StructField("platforms", ArrayType(LongType())),
    StructField("remakes", ArrayType(LongType())),
    StructField("remasters", ArrayType(LongType())),
    StructField("ports", ArrayType(LongType())),
    StructField("franchises", ArrayType(StructType([StructField("id", LongType()), StructField("name", StringType())]))),
])


def read_game_documents(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed metadata documents (JSON lines) with the fixed nested schema, and
    dead-letter rows for broken lines."""
    return split_corrupt(read_json(spark, path, GAME_DOCUMENT))


def extract_chart(html_col) -> "F.Column":
    """Embedded chart object of a page as ``MAP<condition, ARRAY<[ms, cents]>>``;
    no embedded object or malformed JSON -> NULL."""
    # of an empty text from_json makes NULL
    return F.from_json(F.regexp_extract(html_col, CHART_PATTERN, 1), CHART_TYPE)


def condition_dim(spark) -> DataFrame:
    return spark.createDataFrame(list(CONDITION_MAP.items()), "chart_key string, condition string")


def chart_points(pages: DataFrame, key: str = "page_id", html: str = "html",
                 extra: list[str] | None = None) -> DataFrame:
    """One row per valid (condition, date, price) point of every page
    (``extra`` page columns are carried along).

    Entries must be ``[epoch_ms, cents]`` pairs with a positive price; series
    keys outside the condition dimension are ignored.  Every page is parsed
    once: a plain explode would have Spark filter the pages by their parsed
    chart first.
    """
    extra = extra or []
    charts = pages.select(key, *extra, extract_chart(F.col(html)).alias("_chart"))
    series = charts.select(key, *extra, F.explode_outer("_chart").alias("chart_key", "_series"))
    series = series.join(F.broadcast(condition_dim(pages.sparkSession)), "chart_key")
    pts = series.select(key, *extra, "condition", F.explode("_series").alias("_e")).where(F.size("_e") == 2)
    pts = pts.where(F.col("_e")[1].isNotNull() & (F.col("_e")[1] > 0))
    return pts.select(key, *extra, "condition", epoch_ms_to_date(F.col("_e")[0]).alias("date"),
                      cents_to_dollars(F.col("_e")[1]).alias("price_usd"))


def ingest_status(pages: DataFrame, key: str = "page_id", html: str = "html",
                  http_status: str = "http_status") -> DataFrame:
    """Dead-letter rows for pages that produced no points: ``fetch_error``
    (non-200), ``no_data`` (no parsable chart), ``empty`` (chart without a
    valid point).  Computed per page, which is parsed once (no shuffle)."""
    chart = F.col("_chart")
    known = F.array(*[F.lit(k) for k in CONDITION_MAP])
    entries = F.flatten(F.map_values(F.map_filter(chart, lambda k, v: F.array_contains(known, k))))
    n_valid = F.size(F.filter(F.coalesce(entries, F.array().cast("array<array<bigint>>")),
                              lambda e: (F.size(e) == 2) & e[1].isNotNull() & (e[1] > 0)))
    status = (F.when(F.col(http_status) != 200, "fetch_error")
              .when(chart.isNull(), "no_data")
              .when(n_valid == 0, "empty"))
    charts = pages.select(key, http_status, extract_chart(F.col(html)).alias("_chart"))
    # a filter stays above a generated column; on a plain one it would parse all pages once more
    return charts.select(key, F.explode_outer(F.array(status)).alias("status")).where(F.col("status").isNotNull())


def catalog_rows(pages: DataFrame, json_col: str = "body", console: str = "console",
                 base_url: str = "https://catalog.example.org/game/") -> DataFrame:
    """Landed catalog JSON pages -> (title, console, url) rows."""
    doc = pages.select(console, F.from_json(F.col(json_col), CATALOG_PAGE).alias("_d"))
    p = doc.select(console, F.explode("_d.products").alias("_p"))
    return p.select(F.col("_p.productName").alias("title"), F.col(console).alias("console"),
                    F.concat(F.lit(base_url), F.col("_p.consoleUri"), F.lit("/"), F.col("_p.productUri")).alias("url"))


# Named character references of HTML that occur in titles and figures; the
# ampersand comes last, so nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "\u2013", "&mdash;": "\u2014",
            "&eacute;": "\u00e9", "&reg;": "\u00ae", "&trade;": "\u2122", "&copy;": "\u00a9", "&amp;": "&"}


def decode_entities(text):
    """HTML character references as characters: decimal, hexadecimal, then the named ones."""
    def character(ref):
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9A-Fa-f]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        # beyond the last code point nothing is decoded
        return F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
    out = F.aggregate(refs, text, lambda acc, ref: F.replace(acc, ref, character(ref)))
    for name, plain in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def _cell_text(cell):
    """Text of an HTML fragment: tags removed, references decoded, whitespace trimmed."""
    return F.trim(decode_entities(F.regexp_replace(cell, r"<[^>]+>", "")))


def _attribute(tag, name: str):
    """Value of an attribute in double, single or no quotes (empty if absent)."""
    value = rf"(?is)<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])


def container_html(html, container: str):
    """What stands inside ``<div id=container>``, up to that element's own end tag.

    The text behind the opening tag is cut at every closing ``div``; it ends
    where as many have closed as were open.
    """
    rest = F.regexp_extract(html, rf"(?is)<div\b[^>]*?\sid\s*=\s*[\"']?{container}(?=[\"'\s>])[^>]*>(.*)", 1)

    def step(state, piece):
        depth = state["depth"] + F.regexp_count(piece, F.lit(r"(?i)<div\b")) - 1
        kept = F.when(state["depth"] > 0, F.concat(state["out"], piece)).otherwise(state["out"])
        return F.struct(F.when(state["depth"] > 0, depth).otherwise(0).alias("depth"), kept.alias("out"))

    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(F.split(rest, r"(?i)</div\s*>"), start, step)["out"]


def sales_table_rows(pages: DataFrame, html: str = "html", console: str = "console",
                     base_url: str = "https://sales.example.org", container: str = "generalBody",
                     min_cells: int = 8) -> DataFrame:
    """Rows of the sales table inside ``<div id="<container>">``: rows with at
    least ``min_cells`` cells whose 3rd cell links to a ``/game/`` page;
    relative links are made absolute, rows without a title are skipped; the
    6th and 7th cells are unit texts (global, north america).  Attributes may
    stand in any order and quotes, nested elements and other containers do not
    matter, and character references are decoded."""
    body = container_html(F.col(html), container)
    trs = pages.select(console, F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))).alias("_tr"))
    cells = trs.select(console, F.regexp_extract_all("_tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1)).alias("_td"))
    cells = cells.where(F.size("_td") >= min_cells)
    link = F.col("_td")[2]
    href = decode_entities(_attribute(F.regexp_extract(link, r"(?is)<a\b[^>]*>", 0), "href"))
    title = _cell_text(F.regexp_extract(link, r"(?is)<a\b[^>]*>(.*?)</a\s*>", 1))
    rows = cells.select(console, href.alias("_href"), title.alias("title"),
                        _cell_text(F.col("_td")[5]).alias("_g"), _cell_text(F.col("_td")[6]).alias("_na"))
    rows = rows.where(F.col("_href").contains("/game/") & (F.col("title") != ""))
    from pricelens.functions.text import parse_units
    url = F.when(F.col("_href").startswith("http"), F.col("_href")).otherwise(F.concat(F.lit(base_url), F.col("_href")))
    return rows.select("title", url.alias("sales_url"), F.col(console).alias("console"),
                       parse_units(F.col("_g")).alias("units_global_m"), parse_units(F.col("_na")).alias("units_na_m"))
