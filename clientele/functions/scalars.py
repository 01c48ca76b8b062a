"""Scalar column expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

DAYS_PER_WEEK = 7

# Lower bound (inclusive) and label of the churn-probability bands.
PROBABILITY_BANDS = (
    (0.90, "Very High"),
    (0.80, "High"),
    (0.45, "Medium"),
    (0.10, "Low"),
    (None, "Very_Low"),
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """Whole elapsed 24-hour units from ``earlier`` to ``later``, rounded down (so −1 µs is −1).

    Calendar days, less one when that many days after ``earlier`` is past ``later``: this stays
    free of the session's time zone, which converting to a point in time does not.
    """
    a, b = col(later), col(earlier)
    days = F.date_diff(a.cast("date"), b.cast("date"))
    return (days - (b + F.make_dt_interval(days) > a).cast("int")).cast("long")


def shift_days(ts: str | Column, days: int) -> Column:
    return col(ts) + F.expr(f"INTERVAL '{days}' DAY")


def as_of_literal(ts: datetime) -> Column:
    # As text: a datetime literal would be read in the session's time zone.
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``; NULL when the denominator is 0 or NULL."""
    return F.try_divide(col(num), col(den))


def money(c: str | Column) -> Column:
    """Money as DECIMAL(18,2): its sums do not depend on the order of the rows."""
    return col(c).cast("decimal(18,2)")


def line_total(quantity: str | Column, price: str | Column) -> Column:
    return col(quantity) * col(price)


def parse_ts(text: str | Column, pattern: str | None = None) -> Column:
    """Text to TIMESTAMP_NTZ: ISO text with up to six fraction digits, unreadable text to NULL.

    With a ``pattern`` the text must match it; other text is an error.
    """
    if pattern:
        return F.to_timestamp_ntz(col(text), F.lit(pattern))
    return col(text).try_cast("timestamp_ntz")


def score_text(*scores: str | Column) -> Column:
    """Scores joined into one text, e.g. 5 and 4 to ``"54"``."""
    return F.concat(*[col(s).cast("string") for s in scores])


def map_patterns(text: str | Column, patterns: dict[str, str]) -> Column:
    """Replace a text that matches a pattern as a whole by that pattern's label; others stay."""
    source = col(text)
    out = source
    for pattern, label in reversed(list(patterns.items())):
        out = F.when(source.rlike(f"^(?:{pattern})$"), F.lit(label)).otherwise(out)
    return out


def null_safe_not(mask: Column) -> Column:
    """Negation where an unknown mask counts as false, so the row is kept."""
    return ~F.coalesce(mask, F.lit(False))



def threshold_flag(prob: str | Column, cut: float = 0.5) -> Column:
    """1 above the cut, else 0 (a missing probability is not above it)."""
    return F.coalesce((col(prob) > F.lit(cut)).cast("long"), F.lit(0).cast("long"))


def probability_band(prob: str | Column, bands=PROBABILITY_BANDS) -> Column:
    p = col(prob)
    out = None
    for lower, label in bands:
        if lower is None:
            out = out.when(p.isNotNull(), label)
        else:
            out = (F if out is None else out).when(p >= F.lit(lower), label)
    return out


def interpolate(lo: float, hi: float, frac: float) -> float:
    return lo if frac == 0 or lo == hi else lo + (hi - lo) * frac
