"""Density clusters, hidden states over whole sequences, fits and forecasts over hourly bars of the driver's events."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import crossing
from tidebars.plans import arima, density, hidden, linear, spectrum
from tidebars.queries.tables import TICKS_SQL, bars, bars_sql, round_sql, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_B = f"{TICKS_SQL}, b AS ({bars_sql()})"

# --- density

_EPS, _LEAST, _NEAREST = 8.0, 10, 12
_POINTS = f"{_B}, p AS MATERIALIZED (SELECT symbol, ts, symbol || '|' || epoch(ts)::BIGINT AS id, close - open AS x, high - low AS y FROM b)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", "symbol", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    return bars(spark, sf_dir).select("symbol", "ts", key.alias("id"), (F.col("close") - F.col("open")).alias("x"), (F.col("high") - F.col("low")).alias("y"))


@query(f"""WITH RECURSIVE {_POINTS}, near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x >= b.x - {_EPS} AND a.x <= b.x + {_EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS * _EPS}),
core AS MATERIALIZED (SELECT id, floor(x / {_EPS / 2}) AS cx, floor(y / {_EPS / 2}) AS cy FROM p WHERE id IN (SELECT a FROM near GROUP BY a HAVING count(*) >= {_LEAST})),
cells AS MATERIALIZED (SELECT row_number() OVER () AS c, cx, cy, min(id) AS least FROM core GROUP BY cx, cy), member AS MATERIALIZED (SELECT id, c FROM core JOIN cells USING (cx, cy)),
links AS MATERIALIZED (SELECT DISTINCT m.c AS a, n.c AS b FROM near JOIN member m ON m.id = near.a JOIN member n ON n.id = near.b),
reach(c, r) AS (SELECT c, c FROM cells UNION SELECT reach.c, b FROM reach JOIN links ON links.a = reach.r),
name AS MATERIALIZED (SELECT reach.c, min(least) AS cluster FROM reach JOIN cells ON cells.c = reach.r GROUP BY reach.c)
SELECT symbol, ts, id IN (SELECT id FROM core) AS core, (SELECT min(cluster) FROM near JOIN member ON member.id = near.b JOIN name USING (c) WHERE near.a = p.id) AS cluster FROM p""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return density.cluster(points, "id", ["x", "y"], _EPS, _LEAST).join(points, "id").select("symbol", "ts", "core", "cluster")


@query(f"WITH {_POINTS}, q AS (SELECT a.symbol, a.ts, list_sort(list(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))))[{_NEAREST}] AS distance FROM p a, p b GROUP BY a.symbol, a.ts) SELECT symbol, ts, {round_sql('distance')} FROM q")
def density_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return rounded(density.neighbour_distances(points, "id", ["x", "y"], _NEAREST).join(points, "id").select("symbol", "ts", "distance"))


# --- hidden states

#: Quiet and wild hours: deviations of a bar's move.
_QUIET_WILD = hidden.States(np.array([0.6, 0.4]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.zeros((2, 1)), np.array([[400.0], [6400.0]]))


@query(f"""WITH RECURSIVE {_B}, x AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, (close - open) * (close - open) AS m FROM b),
l AS (SELECT *, -0.5 * (m / 400 + ln(2 * pi() * 400)) AS l0, -0.5 * (m / 6400 + ln(2 * pi() * 6400)) AS l1 FROM x),
d AS MATERIALIZED (SELECT *, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM l), n AS (SELECT symbol, max(i) AS n FROM d GROUP BY 1),
f(symbol, i, f0, f1) AS (SELECT symbol, i, 0.6 * b0 / (0.6 * b0 + 0.4 * b1), 0.4 * b1 / (0.6 * b0 + 0.4 * b1) FROM d WHERE i = 1 UNION ALL
SELECT symbol, i, u / (u + v), v / (u + v) FROM (SELECT d.symbol, d.i, (0.95 * f0 + 0.1 * f1) * b0 AS u, (0.05 * f0 + 0.9 * f1) * b1 AS v FROM f JOIN d ON d.symbol = f.symbol AND d.i = f.i + 1)),
g(symbol, i, g0, g1) AS (SELECT symbol, n, 1.0::DOUBLE, 1.0::DOUBLE FROM n UNION ALL
SELECT symbol, i, u / greatest(u, v), v / greatest(u, v) FROM (SELECT g.symbol, g.i - 1 AS i, 0.95 * b0 * g0 + 0.05 * b1 * g1 AS u, 0.1 * b0 * g0 + 0.9 * b1 * g1 AS v FROM g JOIN d ON d.symbol = g.symbol AND d.i = g.i WHERE g.i > 1)),
v(symbol, i, v0, v1, k0, k1) AS (SELECT symbol, i, ln(0.6) + l0, ln(0.4) + l1, 0, 0 FROM d WHERE i = 1 UNION ALL
SELECT d.symbol, d.i, greatest(v0 + ln(0.95), v1 + ln(0.1)) + l0, greatest(v0 + ln(0.05), v1 + ln(0.9)) + l1, CASE WHEN v0 + ln(0.95) >= v1 + ln(0.1) THEN 0 ELSE 1 END, CASE WHEN v0 + ln(0.05) >= v1 + ln(0.9) THEN 0 ELSE 1 END FROM v JOIN d ON d.symbol = v.symbol AND d.i = v.i + 1),
s(symbol, i, state) AS (SELECT symbol, i, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END FROM v JOIN n USING (symbol) WHERE i = n UNION ALL SELECT v.symbol, v.i - 1, CASE WHEN s.state = 0 THEN k0 ELSE k1 END FROM s JOIN v ON v.symbol = s.symbol AND v.i = s.i WHERE v.i > 1),
q AS (SELECT symbol, ts, state::INTEGER AS state, f1 * g1 / (f0 * g0 + f1 * g1) AS wild FROM d JOIN f USING (symbol, i) JOIN g USING (symbol, i) JOIN s USING (symbol, i)) SELECT symbol, ts, state, {round_sql('wild')} FROM q""")
def hidden_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed probability of the wild state and the likeliest path, under a model that is given."""
    df = bars(spark, sf_dir).select("symbol", "ts", (F.col("close") - F.col("open")).alias("move"))
    chances = hidden.probabilities(df, _QUIET_WILD, ["move"], block_rows=256)
    path = hidden.states(df, _QUIET_WILD, ["move"], block_rows=256)
    return rounded(path.join(chances, ["symbol", "ts"]).select("symbol", "ts", "state", F.get("chance", F.lit(1)).alias("wild")))


# --- fits and forecasts

_I = f"{_B}, i AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b)"


def _orthogonal(most: int, extra: int) -> str:
    """Polynomials that are orthogonal over a symbol's rows, each from the two before, and the fits that add them up."""
    ctes = ["m AS (SELECT symbol, count(*) AS n FROM i GROUP BY 1)", f"g AS (SELECT symbol, n, unnest(range(n + {extra})) AS i, (2.0 * i - (n - 1)) / (n - 1) AS t FROM m)", "h AS (SELECT g.*, close FROM g LEFT JOIN i USING (symbol, i))", "o0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS before, 1.0::DOUBLE AS p, 0.0::DOUBLE AS fitted, 1.0::DOUBLE AS norm FROM h)"]
    for k in range(most + 1):
        sums = f"s{k} AS MATERIALIZED (SELECT symbol, sum(p * p) AS pp, sum(t * p * p) / sum(p * p) AS a, sum(close * p) / sum(p * p) AS c, sum(p * p) / any_value(norm) AS b FROM o{k} WHERE i < n GROUP BY 1)"
        ctes += [sums, f"o{k + 1} AS MATERIALIZED (SELECT symbol, n, i, t, close, p AS before, (t - a) * p - {'b * before' if k else '0'} AS p, fitted + c * p AS fitted, pp AS norm FROM o{k} JOIN s{k} USING (symbol))"]
    return ", ".join(ctes)


@query(f"WITH {_I}, {_orthogonal(5, 10)}, q AS (" + " UNION ALL ".join(f"SELECT symbol, {d} AS degree, i AS row, fitted, i >= n AS beyond FROM o{d + 1}" for d in range(1, 6)) + f") SELECT symbol, degree, row, beyond, {round_sql('fitted')} FROM q")
def polynomial_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = [linear.polynomial_beyond(bars(spark, sf_dir), "close", d, 10).withColumn("degree", F.lit(d)) for d in range(1, 6)]
    return rounded(reduce(DataFrame.unionByName, fits).select("symbol", "degree", "row", "beyond", "fitted"))


@query(f"""WITH {_I}, l AS (SELECT symbol, regr_slope(close, i) AS slope, count(*) AS n FROM i GROUP BY 1), r AS MATERIALIZED (SELECT symbol, n, slope, i, close - slope * i AS x FROM i JOIN l USING (symbol)),
f AS (SELECT a.symbol, a.n, a.slope, k, sum(x * cos(2 * pi() * ((k * i) % a.n) / a.n)) AS re, -sum(x * sin(2 * pi() * ((k * i) % a.n) / a.n)) AS im FROM r a JOIN (SELECT symbol, unnest(range(n)) AS k FROM l) USING (symbol) GROUP BY ALL),
t AS MATERIALIZED (SELECT *, sqrt(re * re + im * im) / n AS size FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(sqrt(re * re + im * im) / n, 9) DESC, k DESC) <= 9),
q AS (SELECT t.symbol, row, sum(size * cos(2 * pi() * ((k * row) % n) / n + atan2(im, re))) + any_value(slope) * row AS fitted, row >= any_value(n) AS beyond FROM t JOIN (SELECT symbol, unnest(range(n + 10)) AS row FROM l) USING (symbol) GROUP BY t.symbol, row) SELECT symbol, row, beyond, {round_sql('fitted')} FROM q""")
def harmonic_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectrum.harmonics_beyond(bars(spark, sf_dir), "close", 4, 10))


@query()
def seasonal_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linear.decompose(bars(spark, sf_dir), "close", 24, 3600))


@query(f"""WITH RECURSIVE {_I}, w AS (SELECT symbol, i, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS w FROM i), m AS (SELECT symbol, avg(w) AS mean, count(w) AS n FROM w GROUP BY 1),
a AS (SELECT symbol, i, w - mean AS a, n, mean FROM w JOIN m USING (symbol) WHERE w IS NOT NULL), l AS (SELECT *, lag(a) OVER s AS a1, lag(a, 2) OVER s AS a2 FROM a WINDOW s AS (PARTITION BY symbol ORDER BY i)),
g AS (SELECT symbol, any_value(mean) AS mean, sum(a * a) / any_value(n) AS g0, coalesce(sum(a * a1), 0) / any_value(n) AS g1, coalesce(sum(a * a2), 0) / any_value(n) AS g2, arg_max(a, i) AS a1, arg_max(a1, i) AS a2 FROM l GROUP BY 1),
p AS (SELECT g.*, g1 * (g0 - g2) / (g0 * g0 - g1 * g1) AS p1, (g0 * g2 - g1 * g1) / (g0 * g0 - g1 * g1) AS p2, (SELECT arg_max(close, i) FROM w WHERE w.symbol = g.symbol) AS x FROM g),
f(symbol, step, a1, a2, x, p1, p2, mean) AS (SELECT symbol, 0, a1, a2, x, p1, p2, mean FROM p UNION ALL SELECT symbol, step + 1, p1 * a1 + p2 * a2, a1, x + mean + p1 * a1 + p2 * a2, p1, p2, mean FROM f WHERE step < 8),
q AS (SELECT symbol, step, x AS forecast FROM f WHERE step > 0) SELECT symbol, step, {round_sql('forecast')} FROM q""")
def arima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arima.forecast(bars(spark, sf_dir), "close", (2, 1, 0), 8))


@query()
def arma_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARMA(2, 1) of the hourly moves with a day's season taken out."""
    moves = arima.differenced(bars(spark, sf_dir), "close", 1, 24)
    return rounded(arima.fit(moves, "w", 2, 1).select("symbol", "n", "mean", F.get("phi", F.lit(0)).alias("phi_1"), F.get("phi", F.lit(1)).alias("phi_2"), F.get("theta", F.lit(0)).alias("theta_1"), "variance"))


# --- crossings


def _later(side: str, test: str) -> str:
    return f"(SELECT min(l.ts) FROM b l WHERE l.symbol = {side}.symbol AND l.ts > {side}.ts AND {test})"


@query(f"""WITH {_B}, g AS (SELECT symbol, ts, high, low, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, 'rising' AS side, h2 AS bottom, low AS top, {_later('g', 'l.low <= g.h2')} AS filled FROM g WHERE low > h2 UNION ALL
SELECT symbol, ts, 'falling', high, l2, {_later('g', 'l.high >= g.l2')} FROM g WHERE high < l2""")
def gap_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing.gap_fills(bars(spark, sf_dir))


@query(f"""WITH {_B}, s AS (SELECT symbol, ts AS swing_ts, high, low, count(*) OVER around AS n, max(high) OVER around AS top, min(low) OVER around AS bottom, max(high) OVER earlier AS top_before, min(low) OVER earlier AS bottom_before, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS ts FROM b
WINDOW around AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), earlier AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT symbol, swing_ts AS ts, 'high' AS side, high AS level, {_later('s', 'l.close >= s.high')} AS broken FROM s WHERE n = 11 AND high >= top AND high > top_before UNION ALL
SELECT symbol, swing_ts, 'low', low, {_later('s', 'l.close <= s.low')} FROM s WHERE n = 11 AND low <= bottom AND low < bottom_before""")
def structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing.structure_breaks(bars(spark, sf_dir))
