"""Timestamp and calendar expressions.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen.  Timestamps are TIMESTAMP_NTZ throughout (the session zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(x) -> Column:
    """Cast to TIMESTAMP_NTZ (``date_trunc`` on NTZ input returns TIMESTAMP)."""
    return _c(x).cast("timestamp_ntz")


def parse_ts(x, fmt: str | None = None) -> Column:
    """Parse a timestamp string and drop any zone (keeps wall-clock time)."""
    c = _c(x)
    if fmt:
        return F.to_timestamp_ntz(c, F.lit(fmt))
    # ISO strings with an offset: drop the offset before parsing, as tz_localize(None)
    stripped = F.regexp_replace(c.cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.to_timestamp_ntz(F.regexp_replace(stripped, "T", " "))


def floor_hour(x) -> Column:
    return ntz(F.date_trunc("hour", _c(x)))


def ceil_hour(x) -> Column:
    """Smallest hour-aligned timestamp >= x."""
    fl = floor_hour(x)
    return F.when(_c(x) == fl, fl).otherwise(fl + F.expr("INTERVAL 1 HOUR"))


def shift_hours(x, hours: int) -> Column:
    """Timestamp +/- a fixed interval."""
    return _c(x) + F.make_dt_interval(hours=F.lit(int(hours)))


def whole_hours_between(start, end) -> Column:
    """truncated whole hours from ``start`` to ``end``."""
    return F.expr("timestampdiff(HOUR, {}, {})".format(_sql(start), _sql(end)))


def fractional_hours_between(start, end) -> Column:
    """fractional hours from ``start`` to ``end``."""
    return F.expr("timestampdiff(MICROSECOND, {}, {})".format(_sql(start), _sql(end))) / 3.6e9


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("pass column names to SQL-built helpers")


def week_label(x) -> Column:
    """pandas ``resample('W')`` label = Sunday that ends the Mon-Sun week."""
    return ntz(F.date_trunc("week", _c(x))) + F.expr("INTERVAL 6 DAYS")


def day_period(x) -> Column:
    return F.to_date(_c(x))


def calendar_columns(ts="ts") -> dict[str, Column]:
    """Hour, ISO week, month, weekday (Monday=0), day of year."""
    c = _c(ts)
    return {
        "hour": F.hour(c).cast("bigint"),
        "week_of_year": F.weekofyear(c).cast("bigint"),
        "month": F.month(c).cast("bigint"),
        "day_of_week": F.weekday(c).cast("bigint"),
        "day_of_year": F.dayofyear(c).cast("bigint"),
    }
