"""Sessions around changes of clocks, over midnight and at weekends, by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidebars.operators import market_hours
from tidebars.operators.market_hours import Hours


def held(spark, sessions, *times):
    rows = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "ts timestamp_ntz")
    return {(r["session"], r["ts"].isoformat(" ", "minutes"), r["session_day"]) for r in market_hours.in_sessions(rows, sessions).collect()}


def test_hours_are_read():
    assert Hours.read("0800-1630:62345", "Europe/London") == Hours(480, 990, (2, 3, 4, 5, 6), "Europe/London")
    assert Hours.read("2200-0600") == Hours(1320, 360, (1, 2, 3, 4, 5, 6, 7), "UTC") and Hours.read("0000-2400").end == 1440
    for bad in ("800-1630", "0800-1660", "2400-0100", "0800-2430", "0800-1630:08", ""):
        with pytest.raises(ValueError):
            Hours.read(bad)


def test_clocks_change(spark):
    sessions = {n: market_hours.SESSIONS[n] for n in ("London", "NewYork")}
    # New York changes on 10 March 2024, London on 31 March
    winter = held(spark, sessions, "2024-03-08 07:30", "2024-03-08 08:00", "2024-03-08 13:30", "2024-03-08 14:30", "2024-03-08 16:30")
    assert winter == {("London", "2024-03-08 08:00", date(2024, 3, 8)), ("London", "2024-03-08 13:30", date(2024, 3, 8)), ("London", "2024-03-08 14:30", date(2024, 3, 8)), ("NewYork", "2024-03-08 14:30", date(2024, 3, 8)), ("NewYork", "2024-03-08 16:30", date(2024, 3, 8))}
    between = held(spark, sessions, "2024-03-12 07:30", "2024-03-12 13:30", "2024-03-12 20:00")
    assert between == {("London", "2024-03-12 13:30", date(2024, 3, 12)), ("NewYork", "2024-03-12 13:30", date(2024, 3, 12))}
    assert held(spark, sessions, "2024-04-02 07:00", "2024-04-02 15:30") == {("London", "2024-04-02 07:00", date(2024, 4, 2)), ("NewYork", "2024-04-02 15:30", date(2024, 4, 2))}


def test_over_midnight_and_weekends(spark):
    sydney = {"Sydney": market_hours.SESSIONS["Sydney"]}
    # daylight saving there until 7 April 2024; a session of Friday goes on into Saturday, none opens on Saturday
    found = held(spark, sydney, "2024-04-05 21:00", "2024-04-06 04:30", "2024-04-06 05:00", "2024-04-06 21:00", "2024-04-07 22:30", "2024-04-08 21:30", "2024-04-08 22:00", "2024-04-09 05:30")
    friday, monday = date(2024, 4, 5), date(2024, 4, 8)
    assert found == {("Sydney", "2024-04-05 21:00", friday), ("Sydney", "2024-04-06 04:30", friday), ("Sydney", "2024-04-08 22:00", monday), ("Sydney", "2024-04-09 05:30", monday)}
    whole = {"all": Hours.read("0900-0900:1")}
    assert held(spark, whole, "2024-04-07 09:00", "2024-04-08 08:59", "2024-04-08 09:00") == {("all", "2024-04-07 09:00", date(2024, 4, 7)), ("all", "2024-04-08 08:59", date(2024, 4, 7))}


def test_ranges_and_levels(spark):
    rows = [("x", "2024-01-02 08:00:00", 5.0, 6.0, 4.0, 5.5, 1.0), ("x", "2024-01-02 09:00:00", 5.0, 9.0, 5.0, 7.0, 2.0), ("x", "2024-01-02 16:00:00", 7.0, 7.0, 1.0, 2.0, 3.0), ("x", "2024-01-02 17:00:00", 1.0, 99.0, 0.0, 1.0, 4.0), ("x", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, at string, open double, high double, low double, close double, volume double").withColumn("ts", F.to_timestamp_ntz("at")).drop("at")
    london = {"London": market_hours.SESSIONS["London"]}
    r = market_hours.session_ranges(bars, london).first().asDict()
    assert r == {"symbol": "x", "session": "London", "session_day": date(2024, 1, 2), "opened": datetime(2024, 1, 2, 8), "opening_high": 6.0, "opening_low": 4.0, "bars": 3, "open": 5.0, "high": 9.0, "low": 1.0, "close": 2.0, "volume": 6.0}
    levels = market_hours.session_levels(bars, london).orderBy("ts").select("session_high", "session_low", "broken").collect()
    assert [tuple(x) for x in levels] == [(6.0, 4.0, 0), (9.0, 4.0, 1), (9.0, 1.0, -1)]
    assert market_hours.session_ranges(bars.limit(0), london).count() == 0
