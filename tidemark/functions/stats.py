"""Column expressions shared by the operators: guarded statistics, formats and time rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 252.0


def t_stat(x: str) -> Column:
    """Mean over its standard error; null below two values or without spread."""
    sd, n = F.stddev_samp(x), F.count(x)
    return F.when((n >= 2) & (sd > 0), F.try_divide(F.avg(x), sd / F.sqrt(n)))


def sharpe(x: str, periods: float = YEAR) -> Column:
    sd, n = F.stddev_samp(x), F.count(x)
    return F.when((n >= 2) & (sd > 0), F.try_divide(F.avg(x), sd) * F.sqrt(F.lit(periods)))


def hit_rate(x: str) -> Column:
    return F.avg((F.col(x) > 0).cast("double"))


def present(*columns: str) -> Column:
    """None of the columns is null or NaN."""
    found = F.lit(True)
    for x in columns:
        found = found & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    return found


def finite(x: str) -> Column:
    return present(x) & (F.abs(x) < F.lit(float("inf")))


def ticker_name(c: str) -> Column:
    return F.upper(F.trim(F.col(c)))


def zero_filled(c: str, width: int = 10) -> Column:
    """Pad with zeros and never cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(F.col(c))


def acceptance_time(c: str) -> Column:
    """Fourteen digits or ISO 8601, taken as UTC; anything else is null."""
    s = F.trim(F.col(c))
    digits = F.when(s.rlike("^[0-9]{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")))
    return F.when(F.lower(s).isin("", "nan", "none"), None).otherwise(F.coalesce(digits, F.try_to_timestamp(s)))


def eastern(utc: Column) -> Column:
    """Wall clock of New York for a UTC instant."""
    return F.from_utc_timestamp(utc, "America/New_York")


def iso_utc(utc: Column) -> Column:
    """ISO 8601 of a UTC instant, with microseconds only where there are any."""
    stamp = lambda form: F.date_format(utc, form + "'+00:00'")
    return F.when(F.unix_micros(utc.cast("timestamp")) % 1_000_000 == 0, stamp("yyyy-MM-dd'T'HH:mm:ss")).otherwise(stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def session_bucket(et: Column) -> Column:
    """premarket before 9:30, afterhours from 16:00 on, intraday between; null of null."""
    minute = F.hour(et) * 60 + F.minute(et)
    return F.when(minute < 570, "premarket").when(minute >= 960, "afterhours").when(minute.isNotNull(), "intraday")


def event_key(*parts: Column) -> Column:
    """Stable identifier: the first 16 hexadecimal digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
