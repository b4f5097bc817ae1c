"""What a review found on larger tables and odd inputs."""

import datetime
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidebars import queries
from tidebars.functions import recurrences
from tidebars.operators import resample, stats
from tidebars.plans import density, regimes

START = datetime.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, segment long"


def test_a_segment_of_one_bar(spark):
    rows = [("a", START + datetime.timedelta(hours=k), 1.0, 2.0, 0.5, 1.0 - k, 3.0, int(k > 2)) for k in range(4)]
    bars = spark.createDataFrame(rows, BARS)
    plain, as_sql = ({r["segment"]: r for r in regimes.segment_matrix(bars, *lone).collect()} for lone in ((), (math.nan,)))
    assert plain[0] == as_sql[0] and plain[0]["direction"] == "down"
    assert plain[1]["slope"] is None and plain[1]["direction"] == "flat"
    assert math.isnan(as_sql[1]["slope"]) and as_sql[1]["direction"] == "up"
    assert as_sql[1]["zone_id"] == "up_medium_medium"


def test_ticks_at_a_price_of_0(spark, tmp_path):
    """Each hour's prices; the query's bars are those of its SQL, zeros counted."""
    hours = [[1.0, 4.0, 2.0], [3.0, 0.0], [0.0, 3.0, 6.0], [0.0, 0.0, 5.0], [0.0], [2.0, 0.0, 0.0], [0.5, 0.25]]
    kinds = ("purchase", "view", "signup", "error", "click")
    rows = [(10 * h + k, START + datetime.timedelta(hours=h, seconds=k // 2), 1, kinds[(h + k) % 5], x, "") for h, prices in enumerate(hours) for k, x in enumerate(prices)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["tick_features"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["tick_features"])
    names = [d[0] for d in want.description]
    found = sorted(map(str, got.select(*names).toPandas().itertuples(index=False, name=None)))
    assert found == sorted(map(str, want.df().itertuples(index=False, name=None)))
    assert [r["trades"] for r in got.orderBy("ts").collect()] == [len(x) for x in hours]


def test_steps_below_0(spark):
    ticks = [("a", START + datetime.timedelta(hours=h, seconds=k), x, 1.0, False, k) for h, prices in enumerate([(-1.0, -2.0), (1.0, -1.0), (0.0, -1.0), (-1.0, 0.0), (1.0, None, 2.0)]) for k, x in enumerate(prices)]
    trades = spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, price double, qty double, is_buyer_maker boolean, id long")
    found = [r["max_tick_return"] for r in resample.tick_features(trades, "1h").orderBy("ts").collect()]
    assert round(found[0], 9) == round(math.log(2), 9) and math.isnan(found[1]) and math.isnan(found[2]) and found[3] == math.inf and found[4] is None


def test_a_conditional_mean_is_held_where_the_bar_does_not_rise(spark):
    prices = [(2.0, 1.0), (1.0, 3.0), (3.0, 2.0), (2.0, 2.0), (2.0, 5.0)]
    bars = spark.createDataFrame([("a", START + datetime.timedelta(hours=k), o, 9.0, 0.5, c, 100.0 + k) for k, (o, c) in enumerate(prices)], BARS.replace(", segment long", ""))

    def means(df):
        return [round(r["conditional_ema"], 9) for r in df.orderBy("ts").collect()]

    every = means(recurrences.by_symbol(bars, recurrences.conditional(), ["conditional_ema"]))
    assert len(set(every)) == 5
    assert means(recurrences.apply(bars, "conditional_ema")) == [every[0], every[1], every[1], every[1], every[4]]
    assert means(recurrences.by_symbol(bars, recurrences.conditional("volume", 102.0), ["conditional_ema"])) == [every[0]] * 3 + every[3:]


def test_quantiles_are_exact_however_they_are_reached(spark, monkeypatch):
    """Groups with ties, nulls, NaN, infinities, one value and none, against percentile; with coarse cuts and with useless ones."""
    r = np.random.default_rng(5)
    groups = {
        "normal": r.normal(0, 1, 3001), "ties": r.integers(0, 4, 2000).astype(float), "tail": 10.0 ** r.uniform(-300, 300, 997), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "nan": np.where(np.arange(50) < 30, np.nan, 1.0), "every nan": np.full(3, math.nan), "inf": np.where(np.arange(40) < 25, math.inf, -math.inf), None: r.normal(5, 2, 500),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), (None, None), ("none", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5).cache()
    shares = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    want = {str(r) for r in table.groupBy("g").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()]).collect()}
    for near in (10, 1000):
        monkeypatch.setattr(stats, "NEAR", near)
        assert {str(r) for r in stats.quantiles(table, ["g"], "x", shares).collect()} == want
    monkeypatch.setattr(F, "percentile_approx", lambda x, shares, near: F.transform(shares, lambda q: q * 3))
    assert {str(r) for r in stats.quantiles(table.withColumn("x", F.col("x")), ["g"], "x", shares).collect()} == want


def test_no_task_counts_all_the_values_of_a_column(spark):
    """The values that are counted one by one are a small part of the column's."""
    table = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).cast("double").alias("x"))
    found = stats.describe(table, "x")
    row = found.first()
    ordered = np.sort((np.arange(200_000) * 7919 % 200_003).astype(float))
    assert [row[n] for n in ("min", "p25", "p50", "p75", "max")] == np.quantile(ordered, [0, 0.25, 0.5, 0.75, 1]).tolist()
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_suggested_eps(spark):
    """Points on a line that lie further apart the further out; the quartile of the exact distances to the k-th nearest, the point itself first."""
    x = np.array([float(k * k) for k in range(30)])
    kth = np.sort(np.abs(x[:, None] - x), axis=1)[:, 2]
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "id long, x double")
    eps, least = density.suggested(table, "id", ["x"])
    assert abs(eps - np.quantile(kth, 0.75)) < 1e-9 and least == 5
    assert density.suggested(table.where("id < 0"), "id", ["x"]) == (0.0, 5)
