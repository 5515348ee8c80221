"""Calendar functions: trading dates, contract labels, release lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Publication lag in days by prefix of a series' symbol; the first match counts, any letter case.
RELEASE_LAGS: tuple[tuple[str, int], ...] = (
    ("EIA_CRUDE_STOCKS", 5), ("EIA_CUSHING_STOCKS", 5), ("EIA_GASOLINE_STOCKS", 5), ("EIA_DISTILLATE_STOCKS", 5), ("EIA_STEO_", 14),
    ("WTI_EIA_SPOT", 1), ("BRENT_EIA_SPOT", 1), ("WTI_EIA_SETTLE", 1), ("BRENT_EIA_SETTLE", 1), ("JODI_", 50), ("WTI_COT_", 3), ("BRENT_COT_", 3),
    ("WTI_BROKER_SETTLE", 1), ("BRENT_BROKER_SETTLE", 1), ("WTI_M", 0), ("BRENT_M", 0), ("WTI", 0), ("Brent", 0),
)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def off_weekend(d: Column) -> Column:
    """Saturday and Sunday to Monday."""
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def score_date(ts: Column, zone: str = "America/New_York", cutoff_hour: int = 16) -> Column:
    """Trading date of a UTC time: local date, the next one from the cutoff on, weekends rolled to Monday."""
    local = F.from_utc_timestamp(ts, zone)
    return off_weekend(F.date_add(F.to_date(local), (F.hour(local) >= cutoff_hour).cast("int")))


def release_lag(symbol: Column, policy: Sequence[tuple[str, int]] = RELEASE_LAGS) -> Column:
    out = F
    low = F.lower(symbol)
    for prefix, lag in policy:
        out = out.when(low.startswith(prefix.lower()), lag)
    return out.otherwise(0)


def released_on(symbol: Column, period: Column) -> Column:
    return F.date_add(F.to_date(period), release_lag(symbol))


def previous_business_day(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1))


def contract_month(label: Column) -> Column:
    """First day of the month that 'Jun-26' or "AUG'26" names, else null."""
    mon = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.regexp_extract(label, r"^\s*([A-Za-z]{3})[-' ]*(\d{2})\s*$", 1)))
    year = F.regexp_extract(label, r"^\s*([A-Za-z]{3})[-' ]*(\d{2})\s*$", 2).try_cast("int")
    return F.when((mon > 0) & year.isNotNull(), F.make_date(2000 + year, mon.cast("int"), F.lit(1)))


def contract_expiry(month: Column) -> Column:
    """Last calendar day of the second month before."""
    return F.last_day(F.add_months(month, -2))


def contract_label(month: Column) -> Column:
    return F.date_format(month, "MMM-yy")


def tenor_number(tenor: Column) -> Column:
    """n of 'M<n>', else null."""
    return F.nullif(F.regexp_extract(tenor, r"^M([0-9]+)$", 1), F.lit("")).try_cast("int")


def circular_days(a: Column, b: Column) -> Column:
    """Distance of two days of the year round the turn of the year."""
    d = F.abs(a - b)
    return F.least(d, 365 - d)


def front_month_index(d: Column, roll_day: int = 20) -> Column:
    """year * 12 + month of the front contract: the next month, after the roll day the one after."""
    return F.year(d) * 12 + F.month(d) + F.when(F.dayofmonth(d) > roll_day, 2).otherwise(1) - 1
