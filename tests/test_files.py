"""Reading and checking bars, and trades held against hand-made cases."""

import datetime

import pytest

from tidebars.plans import backtest
from tidebars.sources import files

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def at(minute: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_times_of_all_kinds_and_repeated_rows(spark, tmp_path):
    file = tmp_path / "bars.csv"
    file.write_text(' Timestamp ,open,high,low,close,volume\n1704067260,1,2,1,2,5\n1704067260000,2,3,2,3,6\n"2024-01-01 00:00:00",1,1,1,1,\nnot a time,1,1,1,1,1\n1704067320,,1,1,1,1\n')
    last = {r.ts: (r.close, r.volume) for r in files.load_bars(spark, str(file), "x").collect()}
    assert last == {at(0): (1.0, None), at(1): (3.0, 6.0)}
    assert {r.close for r in files.load_bars(spark, str(file), "x", keep="first").collect()} == {1.0, 2.0}


def test_missing_columns_are_named(spark, tmp_path):
    file = tmp_path / "bars.csv"
    file.write_text("time,open,high\n1,1,1\n")
    with pytest.raises(ValueError, match="low, close"):
        files.load_bars(spark, str(file))


def test_violations(spark):
    table = [("a", at(0), 1.0, 2.0, 1.0, 2.0, 1.0), ("a", at(1), 1.0, 1.0, 2.0, 1.0, 1.0), ("a", at(2), 1.0, 2.0, 1.0, 3.0, 1.0), ("a", at(3), 1.0, 2.0, 1.0, None, 1.0), ("a", at(4), 1.0, 2.0, 1.0, 2.0, -1.0)]
    found = {r.ts.minute: r.rule for r in files.violations(spark.createDataFrame(table, BARS)).collect()}
    assert found == {1: "high below low", 2: "close out of range", 3: "missing price", 4: "negative volume"}
    assert files.violations(spark.createDataFrame([], BARS)).count() == 0


def test_line_protocol_leaves_nulls_out_and_escapes(spark):
    table = spark.createDataFrame([("a b", 1, None, at(0)), ("c", 2, 0.5, at(1))], "s string, n long, x double, ts timestamp_ntz")
    assert sorted(r.line for r in files.line_protocol(table, "m", ("s",), ("n", "x")).collect()) == ["m,s=a\\ b n=1i 1704067200000000000", "m,s=c n=2i,x=0.5 1704067260000000000"]


@pytest.mark.parametrize(("low", "high", "reason", "gain"), [(97.0, 100.0, "stop", -2.0), (100.0, 105.0, "target", 4.0), (99.0, 101.0, "end", 0.0)])
def test_exits(spark, low, high, reason, gain):
    table = [("a", at(0), 100.0, 100.0, 100.0, 100.0, 1.0, 1), ("a", at(1), 100.0, high, low, 100.0, 1.0, 0)]
    rules = backtest.Rules(maker_fee=0.0, taker_fee=0.0)
    (trade,) = backtest.trades(spark.createDataFrame(table, BARS + ", signal int"), rules).collect()
    assert trade.reason == reason and trade.pnl_pct == pytest.approx(gain) and trade.bars == 1
