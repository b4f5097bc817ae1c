"""Named market sessions that follow daylight saving: which bars lie in them, their ranges and their opening ranges.

A session is "HHMM-HHMM:days" on the clock of standard time in UTC; while the session's zone keeps daylight saving, the
clock is ahead by as much, so the session begins earlier in UTC. days are those on which it opens, 1 for Sunday to 7 for
Saturday; without them every day counts. A session whose end isn't after its begin goes on into the next day and
belongs to the day on which it opened. Bars without a time are in no session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hours:
    """begin and end in minutes of the day, days on which the session opens, and the zone whose daylight saving it follows."""

    begin: int
    end: int
    days: tuple[int, ...]
    zone: str

    @classmethod
    def read(cls, text: str, zone: str | None = None) -> Hours:
        found = re.fullmatch(r"([01]\d|2[0-4])([0-5]\d)-([01]\d|2[0-4])([0-5]\d)(?::([1-7]+))?", text)
        if not found:
            raise ValueError(f"not a session: {text}")
        begin, end = int(found[1]) * 60 + int(found[2]), int(found[3]) * 60 + int(found[4])
        if begin >= 1440 or end > 1440:
            raise ValueError(f"no such time of day: {text}")
        return cls(begin, end, tuple(sorted({int(d) for d in found[5] or "1234567"})), zone or "UTC")


# The named sessions, in standard time.
SESSIONS = {
    "London": Hours.read("0800-1630:23456", "Europe/London"),
    "NewYork": Hours.read("1430-2100:23456", "America/New_York"),
    "Tokyo": Hours.read("0000-0600:23456"),
    "HongKong": Hours.read("0130-0800:23456"),
    "Sydney": Hours.read("2200-0600:23456", "Australia/Sydney"),
    "EU Brinks": Hours.read("0800-0900:23456", "Europe/London"),
    "US Brinks": Hours.read("1400-1500:23456", "America/New_York"),
}


def daylight_saving(ts: Column, zone: Column | str) -> Column:
    """Seconds by which the clocks of zone are ahead of its standard time, the lesser offset of January and July."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    utc = ts.cast("timestamp_ntz")
    seconds = lambda x: F.unix_seconds(x.cast("timestamp"))
    offset = lambda x: seconds(F.convert_timezone(F.lit("UTC"), zone, x)) - seconds(x)
    year = F.date_trunc("year", utc).cast("timestamp_ntz")
    july = F.timestamp_add("MONTH", F.lit(6), year).cast("timestamp_ntz")
    return offset(utc) - F.least(offset(year), offset(july))


def in_sessions(bars: DataFrame, sessions: dict[str, Hours] = SESSIONS, time: str = "ts") -> DataFrame:
    """A row for each bar and session that it lies in, with `session` and the day on which it opened, `session_day`."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h.begin).alias("begin"), F.lit(h.end).alias("end"), F.array(*[F.lit(d) for d in h.days]).alias("days"), F.lit(h.zone).alias("zone")) for n, h in sessions.items()])
    # daylight saving is found once for a zone, not for a session
    zones = sorted({h.zone for h in sessions.values()})
    saved = F.create_map(*[x for z in zones for x in (F.lit(z), daylight_saving(F.col(time), z) if z != "UTC" else F.lit(0).cast("long"))])
    df = bars.where(F.col(time).isNotNull()).withColumn("__saved", saved).withColumn("__s", F.explode(each))
    df = df.withColumn("__clock", F.timestamp_seconds(F.unix_seconds(F.col(time).cast("timestamp")) + F.col("__saved")[F.col("__s.zone")]))
    minute = F.hour("__clock") * 60 + F.minute("__clock")
    begin, end, today = F.col("__s.begin"), F.col("__s.end"), F.to_date("__clock")
    day = F.when(begin < end, F.when((minute >= begin) & (minute < end), today)).when(minute >= begin, today).when(minute < end, F.date_sub(today, 1))
    df = df.withColumns({"session": F.col("__s.name"), "session_day": day})
    return df.where(F.col("session_day").isNotNull() & F.array_contains("__s.days", F.dayofweek("session_day"))).drop("__saved", "__s", "__clock")


def session_ranges(bars: DataFrame, sessions: dict[str, Hours] = SESSIONS, by: str = "symbol", time: str = "ts") -> DataFrame:
    """One row for each symbol, session and day: its first bar's time, high and low (the opening range), bars, open, high, low,
    close, volume. Of bars at the same time the one with the greater prices counts as the later."""
    at = F.struct(time, "open", "high", "low", "close")
    rows = in_sessions(bars, sessions, time).groupBy(by, "session", "session_day").agg(
        F.min(at).alias("__first"), F.max(at).alias("__last"), F.count("*").alias("bars"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")
    )
    first, last = F.col("__first"), F.col("__last")
    return rows.select(by, "session", "session_day", first[time].alias("opened"), first["high"].alias("opening_high"), first["low"].alias("opening_low"), "bars", first["open"].alias("open"), "high", "low", last["close"].alias("close"), "volume")


def session_levels(bars: DataFrame, sessions: dict[str, Hours] = SESSIONS, by: str = "symbol", time: str = "ts") -> DataFrame:
    """Each bar in each of its sessions with the session's high and low so far, and whether it leaves the opening range: 1 for a close
    above it, -1 below, 0 inside. A window holds one session of one day."""
    own = Window.partitionBy(by, "session", "session_day").orderBy(time, "open", "high", "low", "close")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    df = in_sessions(bars, sessions, time).withColumns({"session_high": F.max("high").over(so_far), "session_low": F.min("low").over(so_far), "__h": F.first("high").over(so_far), "__l": F.first("low").over(so_far)})
    broken = F.when(F.col("close") > F.col("__h"), 1).when(F.col("close") < F.col("__l"), -1).otherwise(0)
    return df.withColumn("broken", broken).drop("__h", "__l")
