"""Joins, sets, ranks and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.frames import before, mean
from tidebars.operators import relational, stats
from tidebars.queries.regimes import _B, _ZONED, _zoned
from tidebars.queries.tables import bars, lag, over, read, roll, round_sql, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# --- relations


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi(read(spark, sf_dir, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query("SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 'nation', n_nationkey, NULL FROM nation")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = [read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(f"{t[0]}_nationkey").alias("nation"), F.col(f"{t[0]}_acctbal").alias("balance")) for t in ("customer", "supplier")]
    return relational.union_all(*people, read(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("nation")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(read(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_custkey"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 5, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.best(read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query(f"{_B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS f, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS l FROM b) SELECT symbol, ts, close, 'head' AS \"end\" FROM n WHERE f <= 3 UNION ALL SELECT symbol, ts, close, 'tail' FROM n WHERE l <= 3")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ends(bars(spark, sf_dir).select("symbol", "ts", "close"), 3)


@query(f"{_ZONED} SELECT symbol, ts, close FROM z WHERE zone = 1 OR zone = -1")
def regime_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.in_regimes(bars(spark, sf_dir).select("symbol", "ts", "close"), _zoned(spark, sf_dir), "zone", 1, -1)


@query(f"{_B}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b), y AS (SELECT symbol, ts AS ts_2, close AS close_2, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b WHERE close > open) SELECT symbol, ts, close, ts_2, close_2 FROM x JOIN y USING (symbol, k)")
def positional_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = bars(spark, sf_dir)
    return relational.side_by_side(every.select("symbol", "ts", "close"), every.where("close > open").select("symbol", "ts", "close"))


@query(f"{_B} SELECT symbol, ts FROM b WHERE close > open INTERSECT SELECT symbol, ts FROM b WHERE volume > 300")
def index_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = bars(spark, sf_dir)
    return relational.common_times(every.where("close > open"), every.where("volume > 300"))


@query(f"{_ZONED}, g AS (SELECT zone, avg(volume) AS mean_volume FROM z GROUP BY 1), r AS (SELECT zone, mean_volume, row_number() OVER (ORDER BY mean_volume, zone) AS rank FROM g) SELECT zone, rank, {round_sql('mean_volume')} FROM r")
def rank_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.ordinal_rank(_zoned(spark, sf_dir), "zone", "volume"))


@query(f"{_B} SELECT event_id, e2.event_type AS symbol, b.close AS entry_close, b.volume AS entry_volume FROM events e2 LEFT JOIN b ON b.symbol = e2.event_type AND b.ts = time_bucket(INTERVAL '1 hour', e2.ts)")
def trade_bar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    return relational.with_bars(trades, bars(spark, sf_dir), "ts", "1 hour", "close", "volume").select("event_id", "symbol", "entry_close", "entry_volume")


@query(f"""{_B}, f AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n, sum(price) AS total FROM e WHERE price > 50 GROUP BY 1, 2), q AS (SELECT symbol, ts, close, coalesce(f.n, 0) AS big_n, coalesce(f.total, 0.0) AS big_total FROM b LEFT JOIN f USING (symbol, ts))
SELECT symbol, ts, big_n, {round_sql('close', 'big_total')} FROM q""")
def combine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "events").where("value > 50").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(relational.combine(bars(spark, sf_dir).select("symbol", "ts", "close"), {"big": big}))


@query("SELECT event_id, CASE WHEN value > 0 AND value <= 30 THEN 'low' WHEN value > 30 AND value <= 70 THEN 'middle' WHEN value > 70 AND value <= 100 THEN 'high' END AS zone FROM events")
def cut_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", relational.cut(F.col("value"), [0, 30, 70, 100], ["low", "middle", "high"]).alias("zone"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 END AS side FROM events")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", relational.mapped(F.col("event_type"), {"purchase": 1, "signup": 1, "error": -1}).alias("side"))


@query("SELECT event_id, value + 1.5 AS total, 2 AS n FROM events")
def json_list_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", 1.5]"))
    listed = read(spark, sf_dir, "events").select("event_id", relational.json_list(cell).alias("list"))
    return listed.select("event_id", F.aggregate("list", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("list").alias("n"))


# --- statistics


@query(f"{_ZONED}, p AS (SELECT {lag('zone')} AS was, zone AS now FROM z), g AS (SELECT was, now, count(*) AS n FROM p WHERE was IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY was) AS share FROM g) SELECT was, now, n, {round_sql('share')} FROM q")
def transition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.transition_shares(_zoned(spark, sf_dir), "zone"))


@query(f"SELECT event_type, n, {round_sql('share')} FROM (SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1)")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.value_shares(read(spark, sf_dir, "events"), "event_type"))


@query("SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_frequent(read(spark, sf_dir, "events"), "event_type", "user_id")


@query(f"{_B}, q AS (SELECT symbol, corr(close, volume) AS corr_close_volume, corr(high, low) AS corr_high_low FROM b GROUP BY 1) SELECT symbol, {round_sql('corr_close_volume', 'corr_high_low')} FROM q")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlations(bars(spark, sf_dir), "symbol", [("close", "volume"), ("high", "low")]))


@query(f"""{_B}, d AS (SELECT day(ts) AS day, avg(close) AS close, sum(volume) AS volume FROM b GROUP BY 1), l AS (SELECT day, 'close' AS metric, close AS value FROM d UNION ALL SELECT day, 'volume', volume FROM d),
g AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, regr_slope(value, day) AS trend, count(value) AS n FROM l GROUP BY 1), q AS (SELECT *, 1 / (1 + coalesce(std / nullif(abs(mean), 0), 0)) AS stability FROM g) SELECT metric, n, {round_sql('mean', 'std', 'trend', 'stability')} FROM q""")
def metric_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = bars(spark, sf_dir).groupBy(F.day("ts").alias("day")).agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    return rounded(stats.metric_trends(daily, "day", ["close", "volume"]))


_DESCRIBED = ["o_totalprice", "o_custkey"]


@query(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM orders" for c in _DESCRIBED)
    + "), g AS (SELECT \"column\", count(value) AS count, count(*) - count(value) AS nulls, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM l GROUP BY 1) "
    + f"SELECT \"column\", count, nulls, {round_sql('mean', 'std', 'min', 'p25', 'p50', 'p75', 'max')} FROM g"
)
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(read(spark, sf_dir, "orders"), *_DESCRIBED))


@query(f"""{_B}, w AS (SELECT ts, {roll('avg', 'close', 20)} AS slow, {lag('close', 3)} AS back FROM b), l AS (SELECT 'slow' AS "column", slow AS v FROM w UNION ALL SELECT 'back', back FROM w UNION ALL SELECT 'ts', CASE WHEN ts IS NOT NULL THEN 1.0 END FROM w),
q AS (SELECT "column", count(*) - count(v) AS nulls, 0 AS nans, (count(*) - count(v)) / count(*) AS share FROM l GROUP BY 1) SELECT "column", nulls, nans, {round_sql('share')} FROM q""")
def null_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumns({"slow": mean("close", 20), "back": before("close", 3)})
    return rounded(stats.nulls(df, "slow", "back", "ts"))


@query(f"{_B}, q AS (SELECT symbol, count(*) AS bars, count(CASE WHEN volume > 300 THEN 1 END) AS covered, count(CASE WHEN volume > 300 THEN 1 END) / count(*) AS coverage FROM b GROUP BY 1) SELECT symbol, bars, covered, {round_sql('coverage')} FROM q")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.coverage(bars(spark, sf_dir).withColumn("big", F.when(F.col("volume") > 300, F.col("volume"))), "big"))


@query(f"{_B}, q AS (SELECT symbol, quantile_cont(volume, 0.3) AS volume_q30, quantile_cont(volume, 0.7) AS volume_q70 FROM b GROUP BY 1) SELECT symbol, {round_sql('volume_q30', 'volume_q70')} FROM q")
def global_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.global_quantiles(bars(spark, sf_dir), "volume", [0.3, 0.7]))


_SIDES = (("bull", 1), ("bear", -1), ("side", 0))


@query(
    f"{_ZONED}, r AS (SELECT symbol, zone, close / nullif({lag('close')}, 0) - 1 AS r, {lag('zone')} AS was FROM z), g AS (SELECT symbol, count(*) AS bars, "
    + ", ".join(f"coalesce(avg(r) FILTER (zone = {k}), 0) AS {n}_return, coalesce(stddev_samp(r) FILTER (zone = {k}), 0) AS {n}_std" for n, k in _SIDES)
    + ", coalesce(count(*) FILTER ((zone = 1 AND r > 0) OR (zone = -1 AND r < 0)) / nullif(count(*) FILTER (zone <> 0), 0), 0) AS trend_efficiency, count(*) FILTER (was = zone) / count(*) AS persistence FROM r WHERE r IS NOT NULL GROUP BY 1), "
    + "q AS (SELECT *, bull_return - bear_return AS return_spread, greatest(bull_std, bear_std, side_std) - least(bull_std, bear_std, side_std) AS volatility_separation, abs(bull_return - bear_return) / (1 + side_std) AS economic_value FROM g) "
    + "SELECT symbol, bars, " + round_sql(*[f"{n}_{x}" for n, _ in _SIDES for x in ("return", "std")], "return_spread", "trend_efficiency", "persistence", "volatility_separation", "economic_value") + " FROM q"
)
def label_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.label_economics(_zoned(spark, sf_dir), "zone"))


@query(f"{_ZONED}, m AS (SELECT symbol, zone, avg(volume) AS m FROM z GROUP BY 1, 2), q AS (SELECT symbol, max(m) - min(m) AS separation, count(*) AS labels FROM m GROUP BY 1) SELECT symbol, labels, {round_sql('separation')} FROM q")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.separation(_zoned(spark, sf_dir), "zone", "volume"))


@query(f"{_ZONED}, m AS (SELECT symbol, zone, CASE WHEN {lag('zone')} <> zone THEN 1 ELSE 0 END AS moved FROM z), q AS (SELECT symbol, count(*) AS bars, sum(moved)::BIGINT AS switches, 1000 * sum(moved) / count(*) AS switches_per_1000, count(*) FILTER (zone = 0) / count(*) AS uncertain_share FROM m GROUP BY 1) SELECT symbol, bars, switches, {round_sql('switches_per_1000', 'uncertain_share')} FROM q")
def switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.switching(_zoned(spark, sf_dir), "zone", 0))


@query(f"{_ZONED}, f AS (SELECT secondary, coalesce(last_value(close) OVER {over(1, 10)} / nullif(close, 0) - 1, 0) AS g FROM z), q AS (SELECT count(*) AS events, avg(g) AS mean_growth, quantile_cont(g, 0.5) AS median_growth, count(*) FILTER (g > 0) / nullif(count(*), 0) AS false_rate FROM f WHERE secondary = -2) SELECT events, {round_sql('mean_growth', 'median_growth', 'false_rate')} FROM q")
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.event_study(_zoned(spark, sf_dir), F.col("secondary") == -2, True, 10))


@query(f"{_ZONED}, r AS (SELECT symbol, close / nullif({lag('close')}, 0) - 1 AS r, {lag('zone')} AS p FROM z), x AS (SELECT symbol, size, p * r - abs(p) * size * 0.001 AS net FROM r, (VALUES (1.0::DOUBLE), (5.0), (10.0)) AS s(size) WHERE r IS NOT NULL AND p IS NOT NULL), q AS (SELECT symbol, size, count(*) AS bars, avg(net) AS mean_return, stddev_samp(net) AS std_return FROM x GROUP BY 1, 2) SELECT symbol, size, bars, {round_sql('mean_return', 'std_return')} FROM q")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.capacity(_zoned(spark, sf_dir), "zone", [1, 5, 10]), "mean_return", "std_return")


@query(f"WITH l AS ({ORACLE_SQL['label_economics']}), q AS (SELECT symbol, 0.35 * least(1, greatest(0, economic_value)) + 0.25 * least(1, greatest(0, volatility_separation)) + 0.2 * least(1, greatest(0, trend_efficiency)) + 0.2 * least(1, greatest(0, return_spread)) AS score FROM l) SELECT symbol, {round_sql('score')} FROM q")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"economic_value": 0.35, "volatility_separation": 0.25, "trend_efficiency": 0.2, "return_spread": 0.2}
    return rounded(stats.composite(rounded(stats.label_economics(_zoned(spark, sf_dir), "zone")), weights).select("symbol", "score"))


@query(f"""WITH t AS (SELECT event_type AS symbol, value - 50 AS g FROM events), q AS (SELECT symbol, count(*) AS trades, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(g) AS mean_gain, sum(CASE WHEN g > 0 THEN g ELSE 0 END) / nullif(-sum(CASE WHEN g < 0 THEN g ELSE 0 END), 0) AS profit_factor,
avg(g) / nullif(stddev_pop(g), 0) * sqrt(24192) AS sharpe FROM t GROUP BY 1) SELECT symbol, trades, {round_sql('win_rate', 'mean_gain', 'profit_factor', 'sharpe')} FROM q""")
def trade_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.col("value") - 50).alias("pnl_pct"))
    return rounded(stats.trade_sharpe(trades))
