"""Splits, searches, models and their metrics over hourly bars of the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.functions import indicators as ind
from tidebars.plans import hidden, learn, optimise, search, validation
from tidebars.queries.regimes import _B, _ZONED, _zoned
from tidebars.queries.tables import bars, lag, over, roll, round_sql, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- splits

_COUNTED = f"{_B}, c AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1)"


def _fold_sql(folds: str, **bounds: str) -> str:
    columns = ", ".join(f"({v})::BIGINT AS {k}" for k, v in bounds.items())
    return f"{_COUNTED}, f AS (SELECT symbol, fold::INTEGER AS fold, {columns} FROM (SELECT *, unnest({folds}) AS fold FROM c) WHERE ({bounds['test_to']}) <= n AND ({bounds['train_to']}) > ({bounds['train_from']}) AND ({bounds['test_to']}) > ({bounds['test_from']})) "


_PURGED = _fold_sql("range(5)", train_from="0", train_to="(fold + 1) * (n // 6)", test_from="(fold + 1) * (n // 6) + 5", test_to="(fold + 1) * (n // 6) + 5 + n // 6 - 5")
_IN_FOLDS = ", r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row FROM b), p AS (SELECT r.*, fold, CASE WHEN row >= train_from AND row < train_to THEN 'train' WHEN row >= test_from AND row < test_to THEN 'test' END AS part FROM r JOIN f USING (symbol))"


@query(_PURGED + "SELECT * FROM f")
def split_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.purged(bars(spark, sf_dir), 5, 5, 5)


@query(_fold_sql("range(greatest((n - 300) // 50, 0) + 1)", train_from="fold * 50", train_to="fold * 50 + 200", test_from="fold * 50 + 200", test_to="fold * 50 + 300") + "SELECT * FROM f")
def split_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rolling(bars(spark, sf_dir), 200, 100, 50)


@query(_fold_sql("range(5)", train_from="0", train_to="n - floor(n * 0.2::DOUBLE) - (4 - fold) * floor(floor(n * 0.2::DOUBLE) / 5)", test_from="n - floor(n * 0.2::DOUBLE) - (4 - fold) * floor(floor(n * 0.2::DOUBLE) / 5)", test_to="n - (4 - fold) * floor(floor(n * 0.2::DOUBLE) / 5)") + "SELECT * FROM f")
def split_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.time_series_cv(bars(spark, sf_dir), 5, 0.2)


@query(_fold_sql("range(3)", train_from="0", train_to="n - (3 - fold) * (n // 4)", test_from="n - (3 - fold) * (n // 4)", test_to="n - (2 - fold) * (n // 4)") + "SELECT * FROM f")
def split_successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.successive(bars(spark, sf_dir), 3)


@query(f"{_COUNTED}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row, n FROM b JOIN c USING (symbol)) SELECT symbol, ts, CASE WHEN row < floor(n * 0.7::DOUBLE) THEN 'train' WHEN row < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM r")
def split_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.proportions(bars(spark, sf_dir)).select("symbol", "ts", "part")


@query(f"{_PURGED}{_IN_FOLDS}, g AS (SELECT symbol, fold, part, count(*) AS rows, avg(close) AS mean_close, stddev_samp(close) AS std_close FROM p WHERE part IS NOT NULL GROUP BY 1, 2, 3) SELECT symbol, fold, part, rows, {round_sql('mean_close', 'std_close')} FROM g")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir)
    return rounded(validation.by_fold(validation.assign(df, validation.purged(df)), {"mean_close": F.avg("close"), "std_close": F.stddev_samp("close")}))


def _uniform_sql(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}|' || draw || '|' || symbol || '|' || epoch(ts)::BIGINT), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"


_NOISY = f"{_B}, d AS (SELECT b.*, unnest(range(1, 6)) AS draw FROM b), x AS (SELECT *, 1 + 0.01::DOUBLE * (sqrt(-2 * ln({_uniform_sql(0)})) * cos(2 * pi() * ({_uniform_sql(1)}))) AS f FROM d)"


@query(f"{_NOISY}, q AS (SELECT symbol, ts, draw::INTEGER AS draw, open * f AS open, high * f AS high, low * f AS low, close * f AS close FROM x) SELECT symbol, ts, draw, {round_sql('open', 'high', 'low', 'close')} FROM q")
def monte_carlo_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.noisy(bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close"), 5, 0.01))


@query(f"{_NOISY}, m AS (SELECT draw, avg(close * f) AS mean_close, stddev_samp(close * f) AS std_close FROM x GROUP BY 1), l AS (SELECT 'mean_close' AS metric, mean_close AS v FROM m UNION ALL SELECT 'std_close', std_close FROM m), g AS (SELECT metric, count(*) AS draws, stddev_samp(v) AS std, avg(v) AS mean FROM l GROUP BY 1), q AS (SELECT metric, draws, std, 1 / (1 + std) AS robustness, std / nullif(abs(mean), 0) AS cv FROM g) SELECT metric, draws, {round_sql('std', 'robustness', 'cv')} FROM q")
def robustness_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = validation.noisy(bars(spark, sf_dir), 5, 0.01).groupBy("draw").agg(F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("std_close"))
    return rounded(validation.robustness(draws, "mean_close", "std_close"))


@query(f"{_ZONED}, n AS (SELECT symbol, zone, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS r FROM z), q AS (SELECT symbol, count(*) AS labels, avg(CASE WHEN sign(r) = zone THEN 1.0 ELSE 0.0 END) AS accuracy FROM n WHERE zone <> 0 AND r IS NOT NULL GROUP BY 1) SELECT symbol, labels, {round_sql('accuracy')} FROM q")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.direction_accuracy(_zoned(spark, sf_dir), "zone"))


# --- searches


def _grid_sql(pairs: list[tuple[int, int]], source: str = "b", by: str = "") -> str:
    """Scores of (fast, slow) settings; source: bars, with the columns of by (a leading comma each)."""
    means = ", ".join(f"{roll('avg', 'close', n)} AS m{n}" for n in sorted({n for p in pairs for n in p}))
    pick = lambda x: f"CASE {x} " + " ".join(f"WHEN {n} THEN m{n}" for n in sorted({n for p in pairs for n in p})) + " END"
    return f""", gm AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS step, {means} FROM {source}), gs AS (SELECT symbol, ts, step, fast, slow{by}, coalesce(sign({pick('fast')} - {pick('slow')}), 0) AS s FROM gm, (VALUES {', '.join(map(str, pairs))}) v(fast, slow)),
    gp AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY symbol, fast, slow ORDER BY ts), 0) AS p FROM gs),
    gg AS (SELECT symbol{by}, fast, slow, count(*) AS bars, count(*) FILTER (p <> 0) AS held, count(*) FILTER (s <> p) AS trades, sum(p * step) AS total, avg(p * step) AS mean, stddev_samp(p * step) AS std FROM gp WHERE step IS NOT NULL GROUP BY ALL), g AS (SELECT *, coalesce(mean / nullif(std, 0), 0) AS sharpe FROM gg)"""


_PAIRS = [(f, s) for f in search.FAST for s in search.SLOW if f < s]
_GRID = _B + _grid_sql(_PAIRS)


@query(f"{_GRID} SELECT symbol, fast, slow, bars, held, trades, {round_sql('total', 'mean', 'std', 'sharpe')} FROM g")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.grid(bars(spark, sf_dir)))


@query(f"{_GRID}, r AS (SELECT symbol, fast, slow, round(sharpe, 9) AS sharpe FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, fast, slow) AS k FROM r) SELECT symbol, fast, slow, {round_sql('sharpe')} FROM k WHERE k = 1")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = search.grid(bars(spark, sf_dir)).select("symbol", "fast", "slow", F.round("sharpe", 9).alias("sharpe"))
    best = rated.groupBy("symbol").agg(F.min(F.struct((-F.col("sharpe")).alias("s"), "fast", "slow")).alias("b"))
    return rounded(best.select("symbol", "b.fast", "b.slow", (-F.col("b.s")).alias("sharpe")))


@query(f"{_ZONED}{_grid_sql(_PAIRS, 'z', ', zone')} SELECT symbol, zone, fast, slow, bars, held, trades, {round_sql('total', 'mean', 'std', 'sharpe')} FROM g")
def grid_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.grid(_zoned(spark, sf_dir), by=("zone",)))


_PARTED = f"{_COUNTED}, r AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM b JOIN c USING (symbol))" + _grid_sql(_PAIRS, "r", ", part")


@query(f"{_PARTED}, w AS (SELECT symbol, fast, slow, max(sharpe) FILTER (part = 'train') AS train, max(sharpe) FILTER (part = 'test') AS test FROM g GROUP BY 1, 2, 3), q AS (SELECT *, 0.7::DOUBLE * test + (1 - 0.7::DOUBLE) * train AS fitness, 1 - coalesce(abs(test - train) / nullif(abs(test) + abs(train), 0), 0) AS stability FROM w WHERE train IS NOT NULL AND test IS NOT NULL) SELECT symbol, fast, slow, {round_sql('train', 'test', 'fitness', 'stability')} FROM q")
def blended_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = validation.proportions(bars(spark, sf_dir), 0.7, 0.0)
    return rounded(search.blended(search.grid(parted, by=("part",))))


@query(f"{_GRID}, r AS (SELECT symbol, fast, slow, round(total, 9) AS total, -trades AS calm FROM g) SELECT symbol, fast, slow, -calm AS trades, {round_sql('total')} FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.symbol = r.symbol AND o.total >= r.total AND o.calm >= r.calm AND (o.total > r.total OR o.calm > r.calm))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = search.grid(bars(spark, sf_dir)).select("symbol", "fast", "slow", F.round("total", 9).alias("total"), (-F.col("trades")).alias("calm"))
    return rounded(search.pareto(rated, "symbol", "total", "calm").select("symbol", "fast", "slow", (-F.col("calm")).alias("trades"), "total"))


_VOTES = {"a": "CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END", "b": f"coalesce(sign(close - ({roll('avg', 'close', 10)})), 0)", "c": f"coalesce(sign(volume - ({roll('avg', 'volume', 10)})), 0)"}
_SETS = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]


@query(
    f"{_B}, v AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS step, " + ", ".join(f"{e} AS {n}" for n, e in _VOTES.items()) + " FROM b), s AS ("
    + " UNION ALL ".join(f"SELECT symbol, ts, step, '{'+'.join(x)}' AS signals, CASE WHEN ({' + '.join(x)}) / {len(x)} > 0.5 THEN 1 WHEN ({' + '.join(x)}) / {len(x)} < -0.5 THEN -1 ELSE 0 END AS s FROM v" for x in _SETS)
    + f"), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY symbol, signals ORDER BY ts), 0) AS p FROM s), g AS (SELECT symbol, signals, count(*) AS bars, count(*) FILTER (p <> 0) AS held, count(*) FILTER (s <> p) AS trades, sum(p * step) AS total, avg(p * step) AS mean, stddev_samp(p * step) AS std FROM p WHERE step IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, coalesce(mean / nullif(std, 0), 0) AS sharpe FROM g) SELECT symbol, signals, bars, held, trades, {round_sql('total', 'mean', 'std', 'sharpe')} FROM q"
)
def signal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumns({"m": ind.mean("close", 10), "v": ind.mean("volume", 10)})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rise = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)
    return rounded(search.signal_sets(df, {"a": rise, "b": zero(F.signum(F.col("close") - F.col("m"))), "c": zero(F.signum(F.col("volume") - F.col("v")))}))


@query()
def ga_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.evolve_crossings(bars(spark, sf_dir), population=8, generations=4)
    return spark.createDataFrame([(k + 1, *own, score) for k, (own, score) in enumerate(found)], "generation int, fast int, slow int, sharpe double")


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, so that no round of a search makes the bars again."""
    path = session.scratch(spark, "search")
    df.write.parquet(path)
    return spark.read.parquet(path)


_WIDE = [(f, s) for f in range(2, 7) for s in range(8, 14)]


@query(f"{_B}{_grid_sql(_WIDE)}, r AS (SELECT fast, slow, round(avg(sharpe), 9) AS sharpe, -sum(trades) AS calm FROM g GROUP BY 1, 2) SELECT fast, slow, {round_sql('sharpe')}, CAST(-calm AS BIGINT) AS trades FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.sharpe >= r.sharpe AND o.calm >= r.calm AND (o.sharpe > r.sharpe OR o.calm > r.calm))")
def front_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of much return over deviation and few trades, by sorting into fronts; the SQL rates every setting."""
    b = _written(spark, bars(spark, sf_dir))
    found = optimise.nondominated(lambda p: optimise.crossings(b, p), [(2, 6), (8, 13)], lambda p: True, population=16, generations=4)
    return rounded(spark.createDataFrame([(*own, sharpe, int(-calm)) for own, (sharpe, calm) in found], "fast int, slow int, sharpe double, trades long"))


def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best (fast, slow) by a model of the score, after each of its rounds."""
    b = _written(spark, bars(spark, sf_dir))
    found = optimise.modelled(lambda p: {k: v[0] for k, v in optimise.crossings(b, p).items()}, [(2, 20), (10, 60)], lambda p: p[0] < p[1], first=8, rounds=3, batch=4)
    return rounded(spark.createDataFrame([(k, *own, score) for k, (own, score) in enumerate(found)], "round int, fast int, slow int, sharpe double"))


QUERIES["model_search"] = model_search


@query(f"""{_GRID}, a AS (SELECT fast, slow, avg(sharpe) AS sharpe FROM g GROUP BY 1, 2), one AS (SELECT * FROM a WHERE slow = 50 ORDER BY sharpe DESC, fast LIMIT 1), two AS (SELECT * FROM a WHERE fast = (SELECT fast FROM one) ORDER BY sharpe DESC, slow LIMIT 1)
SELECT step, fast, slow, {round_sql('sharpe')} FROM (SELECT 1 AS step, * FROM one UNION ALL SELECT 2, * FROM two)""")
def stepwise_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.stepwise(bars(spark, sf_dir))
    return rounded(spark.createDataFrame([(k + 1, own["fast"], own["slow"], score) for k, (own, score) in enumerate(found)], "step int, fast int, slow int, sharpe double"))


# --- models

_FORMS = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"), "maxabs": ("0.0", "max(abs({c}))")}


def _scaled(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(learn.scale(bars(spark, sf_dir).select("symbol", "ts", "close", "volume"), ["close", "volume"], kind))

    low, width = _FORMS[kind]
    consts = ", ".join(f"{low.format(c=c)} AS l_{c}, {width.format(c=c)} AS w_{c}" for c in ("close", "volume"))
    QUERIES[f"scale_{kind}"] = run
    ORACLE_SQL[f"scale_{kind}"] = f"{_B}, o AS (SELECT {consts} FROM b), q AS (SELECT symbol, ts, " + ", ".join(f"coalesce(({c} - l_{c}) / nullif(w_{c}, 0), 0) AS {c}" for c in ("close", "volume")) + f" FROM b, o) SELECT symbol, ts, {round_sql('close', 'volume')} FROM q"


for _kind in _FORMS:
    _scaled(_kind)

_LAGS = {f"{c}_day{k}": lag(c, 3 - k) for k in range(3) for c in ("open", "high", "low", "close", "volume")}


@query(f"{_B}, w AS (SELECT symbol, ts, {lag('ts', 3)} AS first_ts, lead(ts, 2) OVER (PARTITION BY symbol ORDER BY ts) AS later, " + ", ".join(f"{e} AS {n}" for n, e in _LAGS.items()) + f", high AS predicted_high, low AS predicted_low, (high + low) / 2 AS prediction FROM b) SELECT symbol, ts, first_ts, {round_sql(*_LAGS, 'predicted_high', 'predicted_low', 'prediction')} FROM w WHERE first_ts IS NOT NULL AND later IS NOT NULL")
def supervised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.supervised(bars(spark, sf_dir), 4))


@query(f"{_ZONED}, w AS (SELECT symbol, ts, list(close) OVER {over(-7)} AS cs, list(volume) OVER {over(-7)} AS vs, lead(zone) OVER (PARTITION BY symbol ORDER BY ts) AS next_label FROM z), q AS (SELECT symbol, ts, len(cs) + len(vs) AS n, cs[1] AS first_close, vs[8] AS last_volume, next_label FROM w WHERE len(cs) = 8 AND next_label IS NOT NULL) SELECT symbol, ts, n::INTEGER AS n, next_label, {round_sql('first_close', 'last_volume')} FROM q")
def label_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learn.sequences(_zoned(spark, sf_dir), ["close", "volume"], 8, "zone")
    return rounded(found.select("symbol", "ts", "next_label", F.size("sequence").alias("n"), F.col("sequence")[0].alias("first_close"), F.col("sequence")[15].alias("last_volume")))


_AR = f"{_B}, w AS (SELECT *, {lag('close')} AS was FROM b), f AS (SELECT symbol, regr_slope(close, was) AS s, regr_intercept(close, was) AS i FROM w GROUP BY 1), p AS (SELECT w.*, i + s * was AS predicted FROM w JOIN f USING (symbol))"


@query(f"{_AR} SELECT symbol, ts, {round_sql('close', 'predicted')} FROM p")
def ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.autoregressive(bars(spark, sf_dir)).select("symbol", "ts", "close", "predicted"))


@query(f"{_AR}, n AS (SELECT *, abs(close - {lag('close', 24)}) AS naive FROM p), g AS (SELECT symbol, count(*) AS rows, sqrt(avg((predicted - close) ** 2)) AS rmse, avg(abs(predicted - close)) AS mae, 100 * avg(abs((predicted - close) / nullif(close, 0))) AS mape, 100 * avg(2 * abs(predicted - close) / nullif(abs(close) + abs(predicted), 0)) AS smape, avg((ln(1 + predicted) - ln(1 + close)) ** 2) AS msle, avg(naive) AS nv FROM n WHERE predicted IS NOT NULL GROUP BY 1), q AS (SELECT *, mae / nullif(nv, 0) AS mase FROM g) SELECT symbol, rows, {round_sql('rmse', 'mae', 'mape', 'smape', 'msle', 'mase')} FROM q")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.regression_metrics(learn.autoregressive(bars(spark, sf_dir)), "predicted", "close", 24))


_RISES = f"{_AR}, u AS (SELECT CASE WHEN {lag('close')} IS NOT NULL THEN close > {lag('close')} END AS t, CASE WHEN {lag('predicted')} IS NOT NULL THEN predicted > {lag('predicted')} END AS p FROM p), k AS (SELECT t AS true_class, p AS predicted_class, count(*) AS n FROM u WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)"


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = learn.autoregressive(bars(spark, sf_dir))
    return df.withColumns({"t": learn.rises("close"), "p": learn.rises("predicted")})


@query(f"{_RISES} SELECT * FROM k")
def direction_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.confusion(_directions(spark, sf_dir), "p", "t")


@query(f"""{_RISES}, s AS (SELECT true_class AS class, sum(n) AS support, sum(n) FILTER (true_class = predicted_class) AS r FROM k GROUP BY 1), c AS (SELECT predicted_class AS class, sum(n) AS called FROM k GROUP BY 1),
m AS (SELECT class, support::BIGINT AS support, coalesce(r / nullif(called, 0), 0) AS precision, coalesce(r / support, 0) AS recall, (SELECT sum(n) FILTER (true_class = predicted_class) / sum(n) FROM k) AS accuracy FROM s LEFT JOIN c USING (class)), q AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m) SELECT class, support, {round_sql('precision', 'recall', 'f1', 'accuracy')} FROM q""")
def direction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.class_report(_directions(spark, sf_dir), "p", "t"))


@query(f"{_B}, s AS (SELECT symbol, avg(close) AS close, sum(volume) AS volume FROM b GROUP BY 1), q AS (SELECT * FROM s UNION ALL SELECT 'average', avg(close), avg(volume) FROM s) SELECT symbol, {round_sql('close', 'volume')} FROM q")
def average_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = bars(spark, sf_dir).groupBy("symbol").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    return rounded(learn.with_average(each, "symbol"))


@query(f"{_B}, i AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b), f AS (SELECT symbol, regr_slope(close, i) AS s, regr_intercept(close, i) AS c, count(*) AS n FROM i GROUP BY 1), x AS (SELECT *, unnest(range(n + 10)) AS row FROM f), q AS (SELECT symbol, row, c + s * row AS fitted, row >= n AS beyond FROM x) SELECT symbol, row, beyond, {round_sql('fitted')} FROM q")
def line_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.line_beyond(bars(spark, sf_dir), "close", 10))


@query(f"{_ZONED}, r AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 12 AS chunk FROM z), g AS (SELECT symbol, chunk, zone, count(*) AS n, min(ts) AS a, max(ts) AS o FROM r GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, chunk ORDER BY n DESC, zone) AS k, min(a) OVER (PARTITION BY symbol, chunk) AS start, max(o) OVER (PARTITION BY symbol, chunk) AS stop FROM g) SELECT symbol, chunk, start, stop, zone FROM k WHERE k = 1")
def chunk_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.chunk_majority(_zoned(spark, sf_dir), "zone", 12)


_ML = ["rsi", "momentum", "adx", "std"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI, momentum, directional movement and deviation of each bar; the first bars lack some of them."""
    df = ind.apply(bars(spark, sf_dir), "rsi_sma", "adx_sma")
    return df.select("symbol", "ts", "close", "rsi", (F.col("close") - ind.before("close", 10)).alias("momentum"), F.col("adx_sma").alias("adx"), ind.deviation("close", 20).alias("std")).dropna()


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.principal(_features(spark, sf_dir), _ML, 2)[0].select("symbol", "ts", "pc_1", "pc_2")


@query()
def kmeans_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.name_clusters(learn.clusters(_features(spark, sf_dir), _ML, 4), "cluster")


@query()
def mixture_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.name_clusters(learn.clusters(_features(spark, sf_dir), _ML, 4, "mixture"), "cluster")


@query()
def cluster_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.silhouettes(_features(spark, sf_dir), _ML, 4)


@query()
def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir)
    model = hidden.fit(df, ["std", "momentum"], 3, passes=5)
    return hidden.states(df, model, ["std", "momentum"]).select("symbol", "ts", "state")


@query()
def hidden_states_by_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden.by_bic(_features(spark, sf_dir), ["std", "momentum"], 3, passes=3)


def _forecast(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    windows = validation.proportions(learn.supervised(bars(spark, sf_dir), 4), 0.7, 0.0)
    found = learn.trees(windows.where("part = 'train'"), windows.where("part = 'test'"), list(_LAGS), "prediction", kind)
    return learn.regression_metrics(found, "predicted", "prediction")


@query()
def forest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, "forest")


@query()
def boosted_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, "boosted")
