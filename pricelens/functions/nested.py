"""Helpers over arrays, maps, structs and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "parse_price_map", "first_publisher", "first_rating_label", "struct_names",
    "relation_type", "rerelease_ids", "valid_rerelease", "release_year_for_platform",
    "earliest_release_year", "series_to_text", "ESRB_LABELS",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price_map(text) -> Column:
    """Parse a ``{'YYYY-MM-DD': price}`` literal (single or double quotes) into
    ``MAP<STRING, DOUBLE>``; malformed or empty text -> NULL."""
    return F.from_json(_c(text), "map<string,double>", {"mode": "PERMISSIVE"})


def first_publisher(companies) -> Column:
    """Name of the first company flagged publisher, else the first company."""
    ic = _c(companies)
    flagged = F.filter(ic, lambda x: x["publisher"] & x["company"].isNotNull())
    return F.coalesce(F.try_element_at(flagged, F.lit(1))["company"]["name"],
                      F.try_element_at(ic, F.lit(1))["company"]["name"])


# Rating-board codes (organization 1) and their labels.
ESRB_LABELS = {1: "RP", 2: "EC", 3: "E", 4: "E10+", 5: "T", 6: "M", 7: "AO"}


def first_rating_label(ratings, organization: int = 1) -> Column:
    """Label of the first rating of the given organization; the first match
    decides even when its code has no label."""
    first = F.try_element_at(F.filter(_c(ratings), lambda r: r["organization"] == organization), F.lit(1))
    mapping = F.create_map(*[x for k, v in ESRB_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(mapping, first["rating_category"])


def struct_names(arr, field: str = "name") -> Column:
    return F.filter(F.transform(_c(arr), lambda x: x[field]), lambda x: x.isNotNull())


def relation_type(remakes, remasters, ports) -> Column:
    """remake > remaster > port by priority; none -> NULL."""
    def n(a):
        return F.coalesce(F.size(_c(a)), F.lit(0))
    return (F.when(n(remakes) > 0, "remake").when(n(remasters) > 0, "remaster")
            .when(n(ports) > 0, "port"))


def rerelease_ids(remakes, remasters, ports) -> Column:
    """Distinct union of the three related-id lists (order of first sight)."""
    def a(x):
        return F.coalesce(_c(x), F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(a(remakes), a(remasters), a(ports)))


def valid_rerelease(release_dates, platforms, original_platform) -> Column:
    """Has a dated region-2 release, and is not only on the original platform."""
    dated = F.exists(F.coalesce(_c(release_dates), F.array()),
                     lambda r: (r["region"] == 2) & r["date"].isNotNull() & (r["date"] != 0))
    plats = F.coalesce(_c(platforms), F.array().cast("array<bigint>"))
    only_original = (F.size(plats) > 0) & (F.size(F.array_except(plats, F.array(_c(original_platform).cast("bigint")))) == 0)
    return dated & ~only_original


def release_year_for_platform(release_dates, platform_id) -> Column:
    """Year of the first region-2 release on the platform, else of the first
    release on the platform; a missing / zero date on the chosen entry gives
    NULL."""
    rd = F.coalesce(_c(release_dates), F.array())
    on_p = F.filter(rd, lambda r: r["platform"] == _c(platform_id))
    pref = F.filter(on_p, lambda r: r["region"] == 2)
    pick = F.when(F.size(pref) > 0, F.try_element_at(pref, F.lit(1))).otherwise(F.try_element_at(on_p, F.lit(1)))
    ts = pick["date"]
    return F.when(ts.isNotNull() & (ts != 0), F.year(F.timestamp_seconds(ts)))


def earliest_release_year(release_dates) -> Column:
    rd = F.coalesce(_c(release_dates), F.array())
    years = F.transform(F.filter(rd, lambda r: r["date"].isNotNull() & (r["date"] != 0)),
                        lambda r: F.year(F.timestamp_seconds(r["date"])))
    return F.array_min(years)


def series_to_text(points, date_field: str = "date", value_field: str = "price") -> Column:
    """Serialise an array of (date, value) structs, in date order, as
    ``YYYY-MM-DD=value`` pairs joined by commas (values with 2 decimals)."""
    srt = F.array_sort(_c(points))
    return F.array_join(F.transform(srt, lambda x: F.concat(
        x[date_field].cast("string"), F.lit("="),
        x[value_field].cast("decimal(18,2)").cast("string"))), ",")
