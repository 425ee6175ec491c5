"""Scalar column expressions (all JVM-side built-ins, no Python UDF).

Driver-side helpers here only fold parameters into literals (month bounds,
validation); they never touch data.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitepulse.schema import STATUS_DONE, STATUS_LABELS, STATUS_NOT_DONE

from sitepulse.fixed import (
    DATE_FORMAT,
    DAY_MONTH_FORMAT,
    KEY_PATTERN,
    MASK_PATTERN,
    MASK_TEXT,
    MONTH_FORMAT,
    SHARE_TEXT,
)

# Text that parses as a plain decimal number (optionally signed, with exponent).
# Hex, NaN, Inf and Spark's '1d' / '1f' suffix forms are rejected on purpose so
# the result does not depend on the engine.
# No backslash: the same text serves in SQL strings, where one would be lost.
NUMBER_PATTERN = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# SQL-text forms of the same expressions: building a wide projection as one
# expression string is one plan call instead of a dozen Column calls.


def recode_status_sql(e: str) -> str:
    """Status code to 0/1: done -> 1, not done -> 0, anything else -> NULL."""
    return f"CASE {e} WHEN {STATUS_DONE} THEN 1 WHEN {STATUS_NOT_DONE} THEN 0 END"


def safe_number_sql(e: str, to: str = "double") -> str:
    """``safe_number`` as SQL text."""
    t = f"trim(CAST({e} AS STRING))"
    return f"CASE WHEN {t} RLIKE '{NUMBER_PATTERN}' THEN try_cast({t} AS {to}) END"


def exact_measure_sql(c: str) -> str:
    """A double as DECIMAL(28, 10), so that sums do not depend on their order.

    NaN counts as missing.  A number too large for the type fails the job:
    it must not leave the sums silently.
    """
    return (
        f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL ELSE"
        f" coalesce(try_cast({c} AS DECIMAL(28, 10)), raise_error('measure does not fit DECIMAL(28,10)')) END"
    )


def split_key_sql(e: str) -> tuple[str, str]:
    """``split_key`` as SQL text."""
    parts = f"split({e}, '-', 2)"
    return f"get({parts}, 0)", f"get({parts}, 1)"


def recode_status(c) -> Column:
    """``recode_status_sql`` as a Column."""
    c = _col(c)
    return F.when(c == STATUS_DONE, F.lit(1)).when(c == STATUS_NOT_DONE, F.lit(0))


def status_label(c) -> Column:
    """0/1 status to its text label; other values stay NULL."""
    c = _col(c)
    out = None
    for code, label in STATUS_LABELS.items():
        out = (F.when if out is None else out.when)(c == code, F.lit(label))
    return out


def safe_number(c, to: str = "double") -> Column:
    """Lenient number parse: NULL instead of an error for non-numbers."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast(to))


def split_key(c) -> tuple[Column, Column]:
    """Split a composite ``Site-ID`` key on its first dash.

    Returns (site part, remainder).  No dash: the whole text and NULL.
    More dashes stay in the remainder.
    """
    parts = F.split(_col(c), "-", 2)
    return F.get(parts, 0), F.get(parts, 1)


def word(c, start: int = 1, end: int | None = None, sep: str = "_") -> Column:
    """Words ``start..end`` (1-based, inclusive; negative counts from the
    end, -1 = last) of a delimited text, rejoined with ``sep``."""
    parts = F.split(_col(c), _regex_quote(sep))
    n = F.size(parts)
    end = start if end is None else end
    lo = F.lit(start) if start > 0 else n + F.lit(start + 1)
    hi = F.lit(end) if end > 0 else n + F.lit(end + 1)
    return F.when((lo >= 1) & (hi <= n) & (lo <= hi), F.array_join(F.slice(parts, lo, hi - lo + 1), sep))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?{}[]\\|()" else ch for ch in s)


def month_bounds(day: dt.date | str) -> tuple[dt.date, dt.date]:
    """First and last day of the calendar month containing ``day``."""
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    last = calendar.monthrange(day.year, day.month)[1]
    return day.replace(day=1), day.replace(day=last)


def as_date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def validate_range(lo, hi) -> tuple[dt.date, dt.date]:
    lo, hi = as_date(lo), as_date(hi)
    if lo > hi:
        raise ValueError(f"empty date range: {lo} > {hi}")
    return lo, hi


def validate_choice(name: str, values: Iterable | None) -> tuple | None:
    """None means 'no filter'; an empty selection is an error, not a query."""
    if values is None:
        return None
    values = tuple(values)
    if not values:
        raise ValueError(f"{name}: an empty selection matches nothing; pass None for no filter")
    return values


def day_text(c, pattern: str = DATE_FORMAT) -> Column:
    return F.date_format(_col(c), pattern)


def day_heading(c) -> Column:
    """Day and month, as heads of daily columns."""
    return day_text(c, DAY_MONTH_FORMAT)


def month_heading(c) -> Column:
    """Month and year, as head of a monthly table."""
    return day_text(c, MONTH_FORMAT)


def number_text(c) -> Column:
    """A number without trailing zeros behind the point (12.50 -> 12.5, 3.00 -> 3)."""
    t = _col(c).cast("string")
    return F.when(t.contains("."), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)


def epoch_seconds_ntz_sql(e: str) -> str:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, from its date and
    clock fields only (no session time zone involved, DST-safe)."""
    return (
        f"CAST(datediff(CAST({e} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400"
        f" + hour({e}) * 3600 + minute({e}) * 60 + second({e})"
    )


def datetime_text(c) -> Column:
    """'dd MMM yyyy hh:mm a' text of a TIMESTAMP_NTZ built from its own
    fields, so no session time zone (or DST gap) can shift it."""
    c = _col(c)
    h = F.hour(c)
    return F.concat(
        F.date_format(F.to_date(c), DATE_FORMAT),
        F.lit(" "),
        F.lpad(((h + 11) % 12 + 1).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.minute(c).cast("string"), 2, "0"),
        F.lit(" "),
        F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM")),
    )


def percent_text(n, num, den) -> Column:
    """``"n (p%)"`` with p = num/den rounded half-up to two decimals.

    Integer arithmetic keeps the text exact on every engine; a zero
    denominator gives the missing-cell text ``"0"``.
    """
    pct = percent_of(num, den)
    return F.when(pct.isNotNull(), F.format_string(SHARE_TEXT, _col(n), pct)).otherwise(F.lit("0"))


def percent_of(num, den) -> Column:
    """num/den in percent as text, rounded half-up to two decimals by exact
    arithmetic (integers, or decimals of up to 10 places as the measure sums
    have); NULL where den is not positive."""
    num, den = _col(num).cast(_WIDE), _col(den).cast(_WIDE)
    q = F.call_function("div", num * 20000 + den, F.nullif(den * 2, F.lit(0)))
    pct = F.concat(
        (q / 100).cast("long").cast("string"),
        F.lit("."),
        F.lpad((q % 100).cast("string"), 2, "0"),
    )
    return F.when(den > 0, pct)


#: All places of a measure sum; 31 digits, so that times 20000 plus another one has 38.
_WIDE = "decimal(31,10)"


def mask_key(c) -> Column:
    """Keep the first and last four characters of a secret."""
    return F.regexp_replace(_col(c), MASK_PATTERN, MASK_TEXT)


def key_is_valid(c) -> Column:
    return F.coalesce(_col(c).rlike(KEY_PATTERN), F.lit(False))


def code_label(c, mapping: dict) -> Column:
    """Small fixed code book lookup (area / kind labels)."""
    c = _col(c)
    out = None
    for code, label in mapping.items():
        out = (F.when if out is None else out.when)(c == code, F.lit(label))
    return out
