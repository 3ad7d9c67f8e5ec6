"""Numeric column helpers (money rounding, guarded ratios, log returns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "rnd", "rnd_sql", "safe_div", "log_return", "clip", "cents_to_dollars",
    "score_delta", "to_double", "to_long", "to_bool_flag", "nan_to_null",
    "log_units", "confidence_pct", "pinball",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, d: int) -> Column:
    """Half-up rounding that is stable at binary ties.

    ``floor(x * 10^d + 0.5 + 1e-5) / 10^d``: the small bias makes a value that
    sits on a decimal tie round the same way no matter in which order an
    aggregate summed it, so results agree across engines and runs.
    """
    scale = float(10 ** d)
    return (F.floor(_c(x) * F.lit(scale) + F.lit(0.5) + F.lit(1e-5)) / F.lit(scale)).cast("double")


def rnd_sql(expr: str, d: int) -> str:
    """The same rounding written as SQL text (used by the DuckDB oracles)."""
    scale = f"1e{d}::double"
    return f"CAST(floor(({expr}) * {scale} + 0.5::double + 1e-5::double) / {scale} AS DOUBLE)"


def safe_div(n, d) -> Column:
    """``n / d`` when the denominator is positive, else NULL (ANSI-safe)."""
    n, d = _c(n), _c(d)
    return F.when(d > 0, n / d)


def log_return(cur, prev, d: int = 6) -> Column:
    """``round(ln(cur/prev), d)`` when both prices are positive."""
    cur, prev = _c(cur), _c(prev)
    return F.when((cur > 0) & (prev > 0), rnd(F.log(cur / prev), d))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def cents_to_dollars(cents) -> Column:
    return rnd(_c(cents) / F.lit(100.0), 2)


def score_delta(critic, user, d: int = 2) -> Column:
    """``round(critic - user, 2)`` only when both are present and non-zero."""
    critic, user = _c(critic), _c(user)
    return F.when((critic != 0) & (user != 0), rnd(critic - user, d))


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def to_double(x) -> Column:
    """Coercing numeric conversion: unparsable text and NaN become NULL."""
    return nan_to_null(_c(x).try_cast("double"))


def to_long(x) -> Column:
    """Integer conversion through DOUBLE so that text like ``'12.0'`` works."""
    d = to_double(x)
    return F.when(d.isNotNull(), F.floor(d)).cast("bigint")


def to_bool_flag(x) -> Column:
    """1 for true / 'true' / 'True', 0 otherwise (NULL included)."""
    return F.when(F.lower(_c(x).cast("string")) == "true", 1).otherwise(0)


def log_units(na, glob) -> Column:
    """``log1p(coalesce(na, global) * 1e6)`` – log of best-known unit count."""
    return F.log1p(F.coalesce(_c(na), _c(glob)) * F.lit(1e6))


def confidence_pct(width, mid) -> Column:
    """clip(round(100 * (1 - width / max(mid, 0.01) / 2), 1), 0, 100)."""
    return clip(rnd(F.lit(100.0) * (F.lit(1.0) - _c(width) / F.greatest(_c(mid), F.lit(0.01)) / F.lit(2.0)), 1), 0.0, 100.0)


def pinball(y, q, alpha: float) -> Column:
    """Quantile (pinball) loss of prediction ``q`` for target ``y``."""
    e = _c(y) - _c(q)
    return F.greatest(F.lit(alpha) * e, F.lit(alpha - 1.0) * e)
