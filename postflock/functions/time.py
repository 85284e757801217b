"""Time expressions. Times are UTC; "now" is always a column so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The form of a raw time text, `Mon Apr 06 22:19:45 PDT 2009`, its zone mark being
# dropped and not applied.
ZONE_MARK = " PDT "
RAW_TIME = r"^(?i:mon|tue|wed|thu|fri|sat|sun)\s+(.+)$"
NO_DATE_HOURS = 9999.0

PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}


def parse_raw_time(text: Column, as_of: Column) -> Column:
    """Time in a raw text; ``as_of`` where it cannot be read."""
    parts = F.split(text, ZONE_MARK)
    joined = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    rest = F.regexp_replace(F.regexp_extract(joined, RAW_TIME, 1), r"\s+", " ")
    parsed = F.when(
        F.size(parts) > 1, F.try_to_timestamp(rest, F.lit("MMM d HH:mm:ss yyyy"))
    )
    return F.coalesce(parsed, as_of)


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def hours_since(as_of: Column, moment: Column) -> Column:
    """Hours from ``moment`` to ``as_of``; a large fixed age where there is no moment."""
    micros = F.unix_micros(as_of) - F.unix_micros(moment)
    return F.coalesce(micros / F.lit(3.6e9), F.lit(NO_DATE_HOURS))


def recency(hours: Column, decay: bool = False) -> Column:
    """Grows from 1 to 2 over a day; with ``decay`` falls from 2 to 1 instead."""
    share = F.least(F.lit(1.0), hours / F.lit(24.0))
    return F.lit(2.0) - share if decay else F.lit(1.0) + share


def period_start(moment: Column, timeframe: str) -> Column:
    """First day of the day, week (Monday) or month."""
    return F.date_trunc(PERIODS.get(timeframe, "month"), moment).cast("date")


def long_stamp(moment: Column) -> Column:
    return F.date_format(moment, "MMMM dd, yyyy, HH:mm")


def long_date(moment: Column) -> Column:
    return F.date_format(moment, "MMMM dd, yyyy")


def iso_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
