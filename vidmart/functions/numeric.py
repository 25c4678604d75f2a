"""Numeric scalars (T10, M1-M4) and exact rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def to_count(x: Column | str) -> Column:
    """Text/number -> whole count; bad or missing -> 0; "12.0" -> 12 (via double,
    truncating like ``astype(int)``)."""
    return F.coalesce(_c(x).try_cast("double").try_cast("bigint"), F.lit(0)).cast("bigint")


def rate(num: Column | str, den: Column | str) -> Column:
    """num/den as double; NULL when den is 0 (ANSI ``/`` would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def floored_rate(num: Column | str, den: Column | str) -> Column:
    """Serving variant: each count floored at 1 before dividing."""
    return F.greatest(_c(num), F.lit(1)).cast("double") / F.greatest(_c(den), F.lit(1)).cast("double")


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def round_ratio_half_even(num: Column | str, den: Column | str, digits: int) -> Column:
    """Exact half-even rounding of num/den (both integral) to ``digits`` decimals.

    Integer arithmetic decides the tie, so the result does not depend on the
    binary value of an intermediate double (numpy ``round`` semantics for
    the exact ratio). NULL when den is 0 or NULL.
    """
    scale = 10 ** digits
    n = _c(num).cast("bigint") * F.lit(scale)
    d = _c(den).cast("bigint")
    safe_d = F.when(d > 0, d)
    r = F.pmod(n, safe_d)                       # 0 <= r < d
    q = ((n - r) / safe_d).cast("bigint")       # floor(n / d), exact
    up = (F.lit(2) * r > d) | ((F.lit(2) * r == d) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(d > 0, (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale)))


def log1p_cols(cols: list[str]) -> dict[str, Column]:
    return {c: F.log1p(F.col(c).cast("double")) for c in cols}
