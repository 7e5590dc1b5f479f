"""Time expressions: slots, market hours, trading sessions. Timestamps hold UTC."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Names of the session zone that the clocks need.
UTC = ("UTC", "Etc/UTC", "GMT", "Z")
# Bar widths in seconds.
WIDTHS = {"M1": 60, "M5": 300, "M15": 900, "H1": 3600, "H4": 14400, "D1": 86400}

# Local opening hours [from, to) of the trading sessions.
SESSIONS = {
    "asian": ("Asia/Tokyo", 9, 18),
    "london": ("Europe/London", 8, 17),
    "new_york": ("America/New_York", 8, 17),
    "london_close": ("Europe/London", 16, 17),
}
# The market closes on Friday and opens on Sunday at this New York hour.
MARKET_ZONE, MARKET_HOUR = "America/New_York", 17


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _instant(ts: Column | str) -> Column:
    """The clock time as an instant, which is only right where the session's zone is UTC."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in UTC:
        raise ValueError(f"the session's time zone is {zone}; call barloom.session.prepare first")
    return col(ts).cast("timestamp")


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds(_instant(ts))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_instant(ts))


def plus_seconds(ts: Column | str, secs: Column | float) -> Column:
    secs = secs if isinstance(secs, Column) else F.lit(secs)
    return col(ts) + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def slot(ts: Column | str, width: int) -> Column:
    """Number of the `width`-second slot since the epoch."""
    return F.floor(seconds(ts) / width)


def local(ts: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts))


def market_open(ts: Column | str) -> Column:
    there = local(ts, MARKET_ZONE)
    day, hour = F.dayofweek(there), F.hour(there)  # Sunday is 1
    closed = (
        (day == 7)
        | ((day == 6) & (hour >= MARKET_HOUR))
        | ((day == 1) & (hour < MARKET_HOUR))
    )
    return ~closed


def in_session(ts: Column | str, name: str) -> Column:
    zone, start, end = SESSIONS[name]
    hour = F.hour(local(ts, zone))
    return (hour >= start) & (hour < end)
