"""Recorded answers of exchanges, streams and class-weighted backtests, made from the driver's events and bars."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.operators import resample
from tidebars.plans import backtest, hidden
from tidebars.queries.regimes import _B, _ZONED, _zoned
from tidebars.queries.tables import bars, bars_sql, lag, read, round_sql, rounded, ticks
from tidebars.sources import exchange, files
from tidebars.streaming import bars as streams
from tidebars.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _millis(ts: Column | str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def _text(*x: str) -> list[Column]:
    return [F.col(c).cast("string") for c in x]


_PRICES = ["open", "high", "low", "close", "volume"]


@query(f"{_B} SELECT symbol, ts, trades, {round_sql(*_PRICES)}, round(volume * 2 + 1.3e-9, 6) + 0.0 AS quote_volume FROM b")
def kline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages overlap: each bar is in an older page with another close too."""
    page = lambda close, at: bars(spark, sf_dir).select("symbol", F.lit(at).alias("at"), F.to_json(F.array(F.array(_millis("ts").cast("string"), *_text("open", "high", "low"), close.cast("string"), F.col("volume").cast("string"), F.lit("0"), (F.col("volume") * 2).cast("string"), F.col("trades").cast("string"), F.lit("0"), F.lit("x"), F.lit("0")))).alias("value"))
    found = exchange.klines(page(F.col("close") + 1, 0).unionByName(page(F.col("close"), 1)), F.col("symbol"), order="at")
    return rounded(found.select("symbol", "ts", "trades", *_PRICES, "quote_volume"))


@query("SELECT 'ALL' AS symbol, event_id AS id, date_trunc('millisecond', ts) AS ts, value AS price, value AS quantity, CASE WHEN event_type IN ('error', 'view') THEN 0.0 ELSE value END AS buy_volume, CASE WHEN event_type IN ('error', 'view') THEN value ELSE 0.0 END AS sell_volume, 2 AS fills FROM events")
def agg_trade_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("event_id").alias("a"), F.col("value").cast("string").alias("p"), F.col("value").cast("string").alias("q"), F.col("event_id").alias("f"), (F.col("event_id") + 1).alias("l"), _millis("ts").alias("T"), F.col("event_type").isin("error", "view").alias("m"))
    answers = read(spark, sf_dir, "events").select(F.to_json(F.array(one)).alias("value"))
    return exchange.agg_trades(answers.unionByName(answers), "ALL").drop("is_buyer_maker")


@query("SELECT 'ALL' AS symbol, date_trunc('millisecond', ts) AS ts, event_id AS update_id, 1 AS bids, 2 AS asks, value AS best_bid, value + 1 AS best_ask FROM events")
def depth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda *x: F.array(*[c.cast("string") for c in x])
    v = F.col("value")
    one = F.struct(_millis("ts").cast("string").alias("fetched_at"), F.col("event_id").alias("lastUpdateId"), F.array(level(v, F.lit(2)), level(F.lit("bad"), F.lit(1))).alias("bids"), F.array(level(v + 1, F.lit(3)), level(v + 2, F.lit(1))).alias("asks"))
    found = exchange.depth(read(spark, sf_dir, "events").select(F.to_json(one).alias("value")), "ALL")
    return found.select("symbol", "ts", "update_id", F.size("bids").alias("bids"), F.size("asks").alias("asks"), F.col("bids")[0]["price"].alias("best_bid"), F.col("asks")[0]["price"].alias("best_ask"))


@query(f"{_B} SELECT symbol, ts, {round_sql('close')} FROM b")
def funding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bars(spark, sf_dir).select(F.col("symbol").alias("of"), F.to_json(F.struct(_millis("ts").alias("fundingTime"), F.col("close").cast("string").alias("fundingRate"))).alias("value"))
    return rounded(exchange.funding(lines, F.col("of")).withColumnRenamed("funding_rate", "close"))


@query(f"{_B} SELECT symbol, ts, {round_sql('volume')} FROM b")
def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(_millis("ts").alias("time"), F.col("volume").cast("string").alias("openInterest"))
    pages = bars(spark, sf_dir).groupBy(F.col("symbol").alias("of"), F.to_date("ts")).agg(F.to_json(F.collect_list(row)).alias("value"))
    return rounded(exchange.open_interest(pages, F.col("of")).withColumnRenamed("open_interest", "volume"))


@query("SELECT 'ALL' AS symbol, event_id AS id, date_trunc('millisecond', ts) AS ts, CASE WHEN event_type IN ('error', 'view') THEN 'long' WHEN event_type = 'click' THEN NULL ELSE 'short' END AS liquidation_type, value AS price, value AS liquidation_quantity FROM events")
def forced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("error", "view"), "SELL").when(F.col("event_type") == "click", "?").otherwise("BUY")
    one = F.struct(F.col("event_id").alias("orderId"), side.alias("side"), F.col("value").cast("string").alias("price"), F.col("value").cast("string").alias("origQty"), _millis("ts").alias("time"))
    return exchange.liquidations(read(spark, sf_dir, "events").select(F.to_json(F.array(one)).alias("value")), "ALL")


@query(f"{_B} SELECT symbol, ts, {round_sql(*_PRICES)} FROM b")
def nested_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timeOpen"), F.struct(F.struct(*_PRICES).alias("USD")).alias("quote"))
    lines = bars(spark, sf_dir).select(F.col("symbol").alias("of"), F.to_json(F.struct(F.struct(F.array(q).alias("quotes")).alias("data"))).alias("value"))
    return rounded(exchange.quotes(lines, F.col("of")))


@query(f"{_B} SELECT symbol, ts, {round_sql('close')} FROM b WHERE ts > TIMESTAMP '2024-01-10 00:00:00' OR symbol = 'view'")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = bars(spark, sf_dir).select("symbol", "ts", "close")
    kept = spark.createDataFrame([(s, "2024-01-10 00:00:00") for s in ("click", "error", "purchase", "signup")], "symbol string, at string").select("symbol", F.to_timestamp_ntz("at").alias("ts"))
    return rounded(exchange.newer(every, kept))


@query(f"{_B}, d AS ({bars_sql('1 day')}) SELECT symbol, ts, '1h' AS timeframe, {round_sql(*_PRICES)} FROM b UNION ALL SELECT symbol, ts, '1d', {round_sql(*_PRICES)} FROM d")
def timeframe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {t: session.scratch(spark, f"bars-{t}") for t in ("1h", "1d", "1w")}
    for t in ("1h", "1d"):
        files.save(resample.ticks_to_bars(ticks(spark, sf_dir), t).select("symbol", "ts", *_PRICES), paths[t], "csv")
    for t in ("1h", "1d"):  # the reader takes the kind from the suffix, which these folders lack
        paths[t] = _as_csv(spark, paths[t])
    return rounded(exchange.timeframes(spark, paths))


def _as_csv(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.csv"))
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new)
    return f"{path}.csv"


# --- streams

_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 minutes' FROM events)"
_HOUR = "time_bucket(INTERVAL '1 hour', ts)"


def _stream(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    kind = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("symbol", F.col("event_type"))
    return rounded(streams.run_available(of(events), session.scratch(spark, "stream"), session.scratch(spark, "offsets")))


@query(f"SELECT event_type AS symbol, {_HOUR} AS ts, {round_sql('last_price', 'buy_volume', 'sell_volume')}, trades FROM (SELECT event_type, {_HOUR} AS ts, sum(value) AS buy_volume, sum(value / 2) AS sell_volume, count(*) AS trades, last(value ORDER BY ts, event_id) AS last_price FROM events GROUP BY 1, 2) WHERE ts + INTERVAL '1 hour' <= {_CLOSED}")
def stream_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: streams.stream_flow(e.select("symbol", "ts", F.col("value").alias("price"), F.col("value").alias("buy_volume"), (F.col("value") / 2).alias("sell_volume"), F.col("event_id").alias("id")), "1h"))


@query("SELECT event_type AS symbol, ts, event_id, value FROM events WHERE event_type <> 'error'")
def stream_closed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a candle of a symbol of its own, which comes twice; those of errors aren't closed."""
    twice = lambda e: e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    of = lambda e: streams.closed_candles(twice(e).select(F.concat_ws("-", "event_type", "event_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", (F.col("event_type") != "error").alias("is_closed")))
    found = _stream(spark, sf_dir, of)
    return found.select(F.split("symbol", "-")[0].alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")


@query(f"SELECT symbol, ts, snapshots, {round_sql('bid_3', 'ask_3', 'bid_60', 'ask_60', 'imbalance_3')} FROM (SELECT event_type AS symbol, {_HOUR} AS ts, count(*) AS snapshots, last(value ORDER BY ts, event_id) AS bid_3, 2.0 AS ask_3, last(value ORDER BY ts, event_id) + 5 AS bid_60, 6.0 AS ask_60, (last(value ORDER BY ts, event_id) - 2) / (last(value ORDER BY ts, event_id) + 2) AS imbalance_3 FROM events GROUP BY 1, 2) WHERE ts + INTERVAL '1 hour' <= {_CLOSED}")
def stream_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books about a price of 100: one level near it and one far off on either side."""
    level = lambda p, q: F.struct(F.lit(p).alias("price"), q.cast("double").alias("qty"))
    book = lambda e: e.select("symbol", "ts", F.array(level(99.0, F.col("value")), level(60.0, F.lit(5))).alias("bids"), F.array(level(101.0, F.lit(2)), level(140.0, F.lit(4))).alias("asks"))
    return _stream(spark, sf_dir, lambda e: streams.stream_depth(book(e), "1h", (0.03, 0.6))).drop("imbalance_60")


@query(f"SELECT symbol, ts, {round_sql('long_liquidations', 'short_liquidations', 'total_liquidations')} FROM (SELECT 'ALL' AS symbol, {_HOUR} AS ts, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS long_liquidations, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS short_liquidations, sum(value) AS total_liquidations FROM events GROUP BY 2) WHERE ts + INTERVAL '1 hour' <= {_CLOSED}")
def stream_liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "long").when(F.col("event_type") == "view", "short")
    return _stream(spark, sf_dir, lambda e: streams.stream_liquidations(e.select(F.lit("ALL").alias("symbol"), "ts", kind.alias("liquidation_type"), F.col("value").alias("liquidation_quantity")), "1h"))


@query(f"WITH w AS (SELECT event_type AS symbol, {_HOUR} - back * INTERVAL '1 hour' AS w, value FROM events, (VALUES (0), (1)) v(back)), g AS (SELECT symbol, w AS ts, avg(value) AS mean_price, sum(value) AS volume, count(*) AS trades FROM w GROUP BY 1, 2) SELECT symbol, ts, trades, {round_sql('mean_price', 'volume')} FROM g WHERE ts + INTERVAL '2 hours' <= {_CLOSED}")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: streams.stream_sliding(e.select("symbol", "ts", F.col("value").alias("price"), F.col("value").alias("qty")), "2h", "1h"))


@query(f"""WITH o AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS begins FROM events), s AS (SELECT *, sum(begins) OVER (PARTITION BY symbol ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM o),
g AS (SELECT symbol, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, sum(value) AS volume, count(*) AS trades FROM s GROUP BY symbol, session) SELECT symbol, start, stop, trades, {round_sql('volume')} FROM g WHERE stop <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda e: streams.stream_sessions(e.select("symbol", "ts", F.col("value").alias("qty")), "30m"))


_SPIKES = hidden.States(np.array([0.8, 0.2]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[30.0], [120.0]]), np.array([[900.0], [3600.0]]))


@query(f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, event_id AS id, value AS price FROM events), w AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) > INTERVAL '1 day' AS anew FROM e),
h AS (SELECT *, count(*) FILTER (anew) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS seg FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY ts, id) AS i, avg(price) OVER (PARTITION BY symbol, seg ORDER BY ts, id ROWS 19 PRECEDING) AS mean, -0.5 * ((price - 30) ** 2 / 900 + ln(2 * pi() * 900)) AS l0, -0.5 * ((price - 120) ** 2 / 3600 + ln(2 * pi() * 3600)) AS l1 FROM h),
d AS MATERIALIZED (SELECT *, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM n),
f(symbol, seg, i, f0, f1) AS (SELECT symbol, seg, i, 0.8 * b0 / (0.8 * b0 + 0.2 * b1), 0.2 * b1 / (0.8 * b0 + 0.2 * b1) FROM d WHERE i = 1 UNION ALL
SELECT symbol, seg, i, u / (u + v), v / (u + v) FROM (SELECT d.symbol, d.seg, d.i, (0.9 * f0 + 0.3 * f1) * b0 AS u, (0.1 * f0 + 0.7 * f1) * b1 AS v FROM f JOIN d ON d.symbol = f.symbol AND d.seg = f.seg AND d.i = f.i + 1)),
q AS (SELECT d.symbol, ts, id, mean, f1 AS chance FROM d JOIN f USING (symbol, seg, i) WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= {_CLOSED}) SELECT symbol, ts, id, {round_sql('mean', 'chance')} FROM q""")
def stream_live_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of calm and spiking values, run over the stream with its state kept by symbol; a day of silence begins anew."""
    with live.store(spark):
        out = _stream(spark, sf_dir, lambda e: live.live_states(e.select("symbol", "ts", F.col("event_id").alias("id"), F.col("value").alias("price")), _SPIKES))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "id", "mean", "chance")


# --- backtests


@query(f"""{_ZONED}, r AS (SELECT symbol, close / nullif({lag('close')}, 0) - 1 AS r, {lag('zone')} AS p FROM z), g AS (SELECT symbol, avg(p * r) AS strategy_mean, stddev_pop(p * r) AS strategy_std, exp(sum(ln(1 + greatest(coalesce(p * r, 0), -0.999999)))) - 1 AS strategy_growth, avg(r) AS holding_mean, stddev_pop(r) AS holding_std, exp(sum(ln(1 + greatest(coalesce(r, 0), -0.999999)))) - 1 AS holding_growth FROM r GROUP BY 1),
q AS (SELECT *, strategy_mean / nullif(strategy_std, 0) AS strategy_sharpe, holding_mean / nullif(holding_std, 0) AS holding_sharpe FROM g) SELECT symbol, {round_sql(*[f'{n}_{x}' for n in ('strategy', 'holding') for x in ('mean', 'std', 'growth', 'sharpe')])} FROM q""")
def regime_on_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.on_off(_zoned(spark, sf_dir), "zone"))


_MEASURES = ["total_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "avg_trade_pnl", "avg_holding_period", "trend_capture_ratio", "reversal_accuracy", "volume_confirmation_rate", "volatility_adaptation", "level_accuracy", "time_based_consistency"]


@query(f"""{_B}, r AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near FROM b),
d AS (SELECT *, {lag('r')} AS was, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sd FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), h AS (SELECT symbol, quantile_cont(sd, 0.7) AS upper FROM d GROUP BY 1),
t AS (SELECT event_id, event_type AS symbol, {_HOUR} AS ts, value - 50 AS pnl, (value - 50) / 100 AS pct, minute(ts) * 3600 AS holding FROM events),
j AS (SELECT t.*, coalesce(abs(r) > 1.5 * sd, false) AS trend, coalesce(r * was < 0, false) AS turn, coalesce(sd > upper, false) AS wild, CASE WHEN i >= 3 AND i < n - 2 THEN (volume > near)::INT END AS fuller, 10000 + sum(pnl) OVER w AS equity FROM t LEFT JOIN d USING (symbol, ts) JOIN h USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM j),
o AS (SELECT symbol, CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, 1 - stddev_pop(m) / (abs(avg(m)) + 1e-8)) END AS time_based_consistency FROM (SELECT symbol, hour(ts) AS h, avg(pnl) AS m FROM t GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT symbol, count(*) AS trades, sum(pnl) / 10000 AS total_return, avg(pct) / stddev_pop(pct) * sqrt(24192) AS sharpe_ratio, max((peak - equity) / peak) AS max_drawdown, avg((pnl > 0)::INT) AS win_rate, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, avg(pnl) AS avg_trade_pnl, avg(holding) AS avg_holding_period,
coalesce(abs(sum(pnl) FILTER (trend) / sum(pnl)), 0) AS trend_capture_ratio, coalesce(avg((pnl > 0)::INT) FILTER (turn), 0) AS reversal_accuracy, coalesce(avg(fuller), 0) AS volume_confirmation_rate, coalesce(sum(pnl) FILTER (wild), 0) / abs(sum(pnl) FILTER (NOT wild)) AS volatility_adaptation, avg((pnl > 0)::INT) AS level_accuracy FROM k GROUP BY 1),
n AS (SELECT *, greatest(0, least(1, total_return + 0.5)) AS tr, greatest(0, least(1, (sharpe_ratio + 1) / 3)) AS sh, greatest(0, least(1, 1 - max_drawdown / 0.5)) AS dd, win_rate AS wr, least(1, profit_factor / 3) AS pf, greatest(0, least(1, (avg_trade_pnl + 100) / 200)) AS ap, greatest(0, least(1, 1 - avg_holding_period / 86400 / 7)) AS hp FROM g JOIN o USING (symbol)),
q AS (SELECT *, 'trend_following' AS class, 0.25 * tr + 0.2 * sh + 0.15 * dd + 0.08 * wr + 0.1 * pf + 0.05 * ap + 0.12 * least(1, trend_capture_ratio) + 0.05 * hp AS score FROM n UNION ALL SELECT *, 'oscillators' AS class, 0.2 * tr + 0.15 * sh + 0.2 * dd + 0.2 * wr + 0.1 * pf + 0.05 * ap + 0.1 * reversal_accuracy AS score FROM n UNION ALL SELECT *, 'volume_based' AS class, 0.15 * tr + 0.15 * sh + 0.15 * dd + 0.15 * wr + 0.15 * pf + 0.25 * volume_confirmation_rate AS score FROM n UNION ALL SELECT *, 'volatility' AS class, 0.2 * tr + 0.2 * sh + 0.25 * dd + 0.1 * wr + 0.1 * pf + 0.15 * greatest(0, least(1, volatility_adaptation)) AS score FROM n UNION ALL SELECT *, 'levels_zones' AS class, 0.25 * tr + 0.15 * sh + 0.15 * dd + 0.25 * wr + 0.1 * pf + 0.1 * level_accuracy AS score FROM n UNION ALL SELECT *, 'systemic' AS class, 0.25 * tr + 0.2 * sh + 0.2 * dd + 0.15 * wr + 0.1 * pf + 0.1 * time_based_consistency AS score FROM n) SELECT symbol, trades, class, {round_sql(*_MEASURES, 'score')} FROM q""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a trade that its hour's bar begins, held for as many hours as its minute says."""
    start = F.window("ts", "1 hour")["start"].cast("timestamp_ntz")
    gain = F.col("value") - 50
    found = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), start.alias("entry_ts"), gain.alias("pnl"), (gain / 100).alias("pnl_pct"), (F.minute("ts") * 3600).alias("holding"))
    return rounded(backtest.class_scores(backtest.trade_measures(found, bars(spark, sf_dir), order=("entry_ts", "event_id"))))
