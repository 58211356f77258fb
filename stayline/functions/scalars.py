"""Scalar expressions; all stay inside whole-stage codegen where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.functions.columns import as_col

WORD = r"[\p{L}\p{N}_]+"


def normalize_code(code) -> Column:
    """Upper case without dots, so `i50.1` meets the pattern `^I50`."""
    return F.upper(F.replace(as_col(code), F.lit("."), F.lit("")))


def code_root(code, length: int = 3) -> Column:
    return F.substring(as_col(code), 1, length)


def whole_days(start, end) -> Column:
    """Whole days from start to end, truncated toward zero (-12 h is 0, 30 d 23 h is 30)."""
    return F.timestamp_diff("DAY", as_col(start), as_col(end))


def whole_hours(start, end) -> Column:
    return F.timestamp_diff("HOUR", as_col(start), as_col(end))


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def days_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(86.4e9)


def parse_timestamp(text, fmt: str | None = None) -> Column:
    """Timestamp in the session zone (keep it at UTC); unreadable text becomes NULL."""
    return F.try_to_timestamp(as_col(text), F.lit(fmt)) if fmt else F.try_to_timestamp(as_col(text))


def nonblank(text) -> Column:
    return as_col(text).isNotNull() & F.trim(as_col(text)).rlike(r"\S")


def word_count(text) -> Column:
    """Runs of non-space characters; NULL text gives NULL, blank text 0."""
    return F.size(F.regexp_extract_all(as_col(text), F.lit(r"(?U)\S+"), F.lit(0)))


def negative_to_null(value) -> Column:
    c = as_col(value)
    return F.when(c >= 0, c)


def clip_lower(value, bound: float = 0.0) -> Column:
    """Raise values below the bound; NULL stays NULL (greatest() would not keep it)."""
    c = as_col(value)
    return F.when(c < bound, F.lit(bound)).otherwise(c)


def age_years(birth, at) -> Column:
    return F.floor(F.months_between(F.to_date(as_col(at)), F.to_date(as_col(birth))) / 12).cast("long")


def penalty_class(l1, l2, tol: float = 1e-12) -> Column:
    has1, has2 = as_col(l1) > tol, as_col(l2) > tol
    low1, low2 = as_col(l1) < tol, as_col(l2) < tol
    return (
        F.when(has1 & low2, "L1").when(has2 & low1, "L2").when(has1 & has2, "ElasticNet").otherwise("None")
    )


def ratio(num, den) -> Column:
    """num/den with 0 where the denominator is 0."""
    n, d = as_col(num), as_col(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)
