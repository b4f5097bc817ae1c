"""Every indicator over hourly bars of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import frames, recurrences
from tidebars.functions import indicators as ind
from tidebars.queries.tables import TICKS_SQL, TR, bars, bars_sql, carry, ema, ema_adjusted, lag, over, roll, round_sql, rounded, run, staged_sql, wilder

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(name: str, build, stages: list[dict[str, str]] | None, outputs: list[str], plain: tuple[str, ...] = ()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(bars(spark, sf_dir)).select("symbol", "ts", *outputs, *plain)
        return rounded(df, *outputs)

    QUERIES[name] = query
    if stages is not None:
        ORACLE_SQL[name] = staged_sql(stages, outputs, plain=plain)


def _window(name: str, stages: list[dict[str, str]], outputs: list[str], plain: tuple[str, ...] = ()) -> None:
    _register(f"ind_{name}", lambda b: ind.apply(b, name), stages, outputs, plain)


def _weights(x: str, weights: list[float]) -> str:
    """FIR sum of the last values (oldest weight first) by lags."""
    n = len(weights)
    return f"CASE WHEN count({x}) OVER {over(-(n - 1))} >= {n} THEN " + " + ".join(f"{w!r} * {lag(x, n - 1 - k) if k < n - 1 else x}" for k, w in enumerate(weights)) + " END"


def _linear(n: int) -> list[float]:
    return [k / (n * (n + 1) / 2) for k in range(1, n + 1)]


_TP = "(high + low + close) / 3"
_STEP = f"(close - {lag('close')})"
_RANGE14 = f"({roll('max', 'high', 14)} - {roll('min', 'low', 14)})"

_window("sma", [{"sma_20": roll("avg", "close", 20)}], ["sma_20"])
_window("wma", [{"wma_10": _weights("close", _linear(10))}], ["wma_10"])
_window("hma", [{"raw": f"2 * ({_weights('close', _linear(8))}) - ({_weights('close', _linear(16))})"}, {"hma_16": _weights("raw", _linear(4))}], ["hma_16"])
_window("vwma", [{"vwma_20": f"({roll('sum', 'close * volume', 20)}) / nullif({roll('sum', 'volume', 20)}, 0)"}], ["vwma_20"])
_window("cma", [{"cma": f"CASE WHEN {run('count', '*')} > 2 THEN {run('avg', 'close')} END"}], ["cma"])
_fir = [0.8 ** (9 - k) for k in range(10)]
_window("fir_ewma", [{"fir_ewma": _weights("close", [w / sum(_fir) for w in _fir])}], ["fir_ewma"])
_rq = [(1 + (24 - k) ** 2 / (2 * 8.0 * 64.0)) ** -8.0 for k in range(25)]
_window("kernel_regression", [{"rq_kernel": _weights("close", [w / sum(_rq) for w in _rq])}, {"rq_kernel_trend": f"sign(rq_kernel - {lag('rq_kernel')})::DOUBLE"}], ["rq_kernel", "rq_kernel_trend"])
_window("centre_of_gravity", [{"cog": f"-({_weights('close', [float(10 - j) for j in range(10)])}) / nullif({roll('sum', 'close', 10)}, 0)"}], ["cog"])
_window("donchian_trend", [{"u": roll("max", "high", 20, 1), "d": roll("min", "low", 20, 1)}, {"e": "CASE WHEN close > u THEN 1 WHEN close < d THEN -1 END"}, {"donchian_trend": f"coalesce({carry('e')}, 0)"}], [], ("donchian_trend",))
_window("ssl_channel", [{"h": roll("avg", "high", 10), "l": roll("avg", "low", 10)}, {"e": "CASE WHEN close > h THEN 1 WHEN close < l THEN -1 END"}, {"side": carry("e")}, {"ssl_up": "CASE WHEN side < 0 THEN l ELSE h END", "ssl_down": "CASE WHEN side < 0 THEN h ELSE l END"}], ["ssl_up", "ssl_down"])
_window("range_filter_direction", [{"tr": TR}, {"atr": roll("avg", "tr", 14), "p": lag("close")}, {"e": "CASE WHEN close > p + atr THEN 1 WHEN close < p - atr THEN -1 END"}, {"range_filter": f"coalesce({carry('e')}, 0)"}], [], ("range_filter",))


def _mid(n: int) -> str:
    return f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"


_window("ichimoku", [{"tenkan": _mid(9), "kijun": _mid(26), "s": _mid(52)}, {"senkou_a": lag("(tenkan + kijun) / 2", 26), "senkou_b": lag("s", 26), "chikou": lag("close", 26)}], ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"])
_last = "CASE WHEN count({x}) OVER {w} >= 14 THEN list_position(list_reverse(list({x}) OVER {w}), {f}({x}) OVER {w}) - 1 END"
_window("aroon", [{"u": _last.format(x="high", w=over(-13), f="max"), "d": _last.format(x="low", w=over(-13), f="min")}, {"aroon_up": "(14 - u) / 14.0 * 100", "aroon_down": "(14 - d) / 14.0 * 100"}], ["aroon_up", "aroon_down"])
_window(
    "adx_sma",
    [
        {"u": f"high - {lag('high')}", "d": f"{lag('low')} - low", "tr": TR},
        {"p": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "m": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END"},
        {"plus_di": f"100 * ({roll('avg', 'p', 14)}) / nullif({roll('avg', 'tr', 14)}, 0)", "minus_di": f"100 * ({roll('avg', 'm', 14)}) / nullif({roll('avg', 'tr', 14)}, 0)"},
        {"dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"}, {"adx_sma": roll("avg", "dx", 14)},
    ],
    ["plus_di", "minus_di", "adx_sma"],
)
_window("vortex", [{"p": f"abs(high - {lag('low')})", "m": f"abs(low - {lag('high')})", "tr": TR}, {"vortex_plus": f"({roll('sum', 'p', 14)}) / nullif({roll('sum', 'tr', 14)}, 0)", "vortex_minus": f"({roll('sum', 'm', 14)}) / nullif({roll('sum', 'tr', 14)}, 0)"}], ["vortex_plus", "vortex_minus"])
_window("linear_fit", [{"i": run("count", "*")}, {"slope": f"CASE WHEN count(close) OVER {over(-13)} >= 14 THEN regr_slope(close, i::DOUBLE) OVER {over(-13)} END"}], ["slope"])
_RSI = [
    {"g": f"CASE WHEN {_STEP} > 0 THEN {_STEP} ELSE 0.0 END", "l": f"CASE WHEN {_STEP} < 0 THEN -{_STEP} ELSE 0.0 END"},
    {"mg": roll("avg", "g", 14), "ml": roll("avg", "l", 14)},
    {"rsi": "CASE WHEN ml = 0 AND mg > 0 THEN 100.0 ELSE 100 - 100 / (1 + mg / nullif(ml, 0)) END"},
]
_window("rsi_sma", _RSI, ["rsi"])
_window("stochastic", [{"stoch_k": f"100 * (close - ({roll('min', 'low', 14)})) / nullif({_RANGE14}, 0)"}, {"stoch_d": roll("avg", "stoch_k", 3)}], ["stoch_k", "stoch_d"])
_window("kdj", [{"rsv": f"100 * (close - ({roll('min', 'low', 9)})) / nullif(({roll('max', 'high', 9)}) - ({roll('min', 'low', 9)}), 0)"}, {"kdj_k": roll("avg", "rsv", 9)}, {"kdj_d": roll("avg", "kdj_k", 9)}, {"kdj_j": "3 * kdj_k - 2 * kdj_d"}], ["kdj_k", "kdj_d", "kdj_j"])
_window("stochastic_rsi", [*_RSI, {"stoch_rsi": f"100 * (rsi - ({roll('min', 'rsi', 14)})) / nullif(({roll('max', 'rsi', 14)}) - ({roll('min', 'rsi', 14)}), 0)"}], ["stoch_rsi"])
_window("williams_r", [{"williams_r": f"-100 * (({roll('max', 'high', 14)}) - close) / nullif({_RANGE14}, 0)"}], ["williams_r"])
_window("cci", [{"tp": _TP}, {"mean": roll("avg", "tp", 20), "xs": f"list(tp) OVER {over(-19)}"}, {"cci": "(tp - mean) / nullif(0.015 * list_avg(list_transform(xs, lambda x: abs(x - mean))), 0)"}], ["cci"])
_window("cmo", [{"u": f"CASE WHEN {_STEP} > 0 THEN {_STEP} WHEN {_STEP} IS NOT NULL THEN 0.0 END", "d": f"CASE WHEN {_STEP} < 0 THEN -{_STEP} WHEN {_STEP} IS NOT NULL THEN 0.0 END"}, {"su": roll("sum", "u", 13), "sd": roll("sum", "d", 13)}, {"cmo": "100 * (su - sd) / nullif(su + sd, 0)"}], ["cmo"])
_window("momentum", [{"momentum": f"close - {lag('close', 10)}", "roc": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)"}], ["momentum", "roc"])
_window("detrended_price", [{"dpo": f"close - ({roll('avg', 'close', 20, 11)})"}], ["dpo"])
_window("awesome", [{"m": "(high + low) / 2"}, {"ao": f"({roll('avg', 'm', 5)}) - ({roll('avg', 'm', 34)})"}, {"ac": f"ao - ({roll('avg', 'ao', 5)})"}], ["ao", "ac"])
_window("zscore", [{"zscore": f"(close - ({roll('avg', 'close', 96, least=30)})) / nullif({roll('stddev_pop', 'close', 96, least=30)}, 0)"}], ["zscore"])
_window("return_zscore", [{"r": f"close / nullif({lag('close')}, 0) - 1"}, {"return_z": f"(r - ({roll('avg', 'r', 50, 1)})) / nullif({roll('stddev_samp', 'r', 50, 1)}, 0)"}], ["return_z"])
_window("atr_sma", [{"tr": TR}, {"atr_sma": roll("avg", "tr", 14)}], ["tr", "atr_sma"])
_window("atr_open", [{"t": "greatest(open - low, abs(high - open), abs(low - open))"}, {"atr_open": roll("avg", "t", 14)}], ["atr_open"])
_window("bollinger", [{"bb_mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)}, {"bb_up": "bb_mid + 2 * sd", "bb_low": "bb_mid - 2 * sd"}, {"bb_percent": "(close - bb_low) / nullif(bb_up - bb_low, 0)", "bb_width": "(bb_up - bb_low) / nullif(bb_mid, 0)"}], ["bb_mid", "bb_up", "bb_low", "bb_percent", "bb_width"])
_window("bollinger_population", [{"mid": roll("avg", "close", 20), "sd": roll("stddev_pop", "close", 20)}, {"bbp_up": "mid + 2 * sd", "bbp_low": "mid - 2 * sd"}], ["bbp_up", "bbp_low"])
_window("donchian", [{"dc_up": roll("max", "high", 20), "dc_low": roll("min", "low", 20)}, {"dc_mid": "(dc_up + dc_low) / 2", "dc_width": "dc_up - dc_low"}], ["dc_up", "dc_low", "dc_mid", "dc_width"])
_window("chandelier", [{"tr": TR}, {"atr": roll("avg", "tr", 22)}, {"chandelier_long": f"({roll('max', 'high', 22)}) - 3 * atr", "chandelier_short": f"({roll('min', 'low', 22)}) + 3 * atr"}], ["chandelier_long", "chandelier_short"])
_window("choppiness", [{"tr": TR}, {"ratio": f"({roll('sum', 'tr', 14)}) / nullif({_RANGE14}, 0)"}, {"chop": "100 * log10(ratio) / log10(14.0)"}], ["chop"])
_window("choppiness_summed", [{"tr": TR, "rg": _RANGE14}, {"ratio": f"({roll('sum', 'tr', 14)}) / nullif({roll('sum', 'rg', 14)}, 0)"}, {"chop_summed": "100 * log10(ratio) / log10(14.0)"}], ["chop_summed"])
_window("realised", [{"r": f"close / nullif({lag('close')}, 0) - 1"}, {"realised": f"({roll('stddev_samp', 'r', 20)}) * sqrt(20.0)"}], ["realised"])
_window("vix_fix", [{"vix_fix": f"100 * (({roll('max', 'close', 22)}) - low) / nullif({roll('max', 'close', 22)}, 0)"}], ["vix_fix"])
_window("spike", [{"spike": "close - open"}, {"spike_sd": roll("stddev_pop", "spike", 20)}], ["spike", "spike_sd"])
_window("robust_z", [{"xs": f"list(close) OVER {over(-49)}", "med": f"median(close) OVER {over(-49)}"}, {"mad": "list_median(list_transform(xs, lambda x: abs(x - med)))"}, {"robust_z": "(close - med) / nullif(1.4826 * mad, 0)"}], ["robust_z"])
_window("exante_percentile", [{"ok": f"count(close) OVER {over(-100, -1)} >= 100", "q": f"quantile_cont(close, 0.7) OVER {over(-100, -1)}", "xs": f"list(close) OVER {over(-100, -1)}"}, {"exante_q": "CASE WHEN ok THEN q END", "exante_rank": "CASE WHEN ok THEN len(list_filter(xs, lambda x: x <= close)) / 100.0 END"}], ["exante_q", "exante_rank"])
_window("stages", [{"tr": TR}, {"f": roll("avg", "tr", 10), "s": roll("avg", "tr", 40)}, {"r": "f / nullif(s, 0)"}, {"e": "CASE WHEN r < 0.9 THEN 1 WHEN r < 1 THEN 2 WHEN r < 1.1 THEN 3 WHEN r IS NOT NULL THEN 4 END"}, {"volatility_stage": f"coalesce({carry('e')}, 2)"}], [], ("volatility_stage",))
_window("obv", [{"d": f"coalesce(sign({_STEP}) * volume, 0)"}, {"obv": f"1 + {run('sum', 'd')}"}], ["obv"])
_FLOW = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"
_window("cmf", [{"f": _FLOW}, {"cmf": f"coalesce(({roll('sum', 'f', 20)}) / nullif({roll('sum', 'volume', 20)}, 0), CASE WHEN count(volume) OVER {over(-19)} >= 20 THEN 0.0 END)"}], ["cmf"])
_window("accumulation", [{"f": _FLOW, "p": f"coalesce((close / nullif({lag('close')}, 0) - 1) * volume, 0)"}, {"ad_line": run("sum", "f"), "vpt": run("sum", "p")}], ["ad_line", "vpt"])
_window("vwap", [{"pv": f"{_TP} * volume"}, {"vwap_n": f"({roll('sum', 'pv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0)", "vwap_all": f"{run('sum', 'pv')} / nullif({run('sum', 'volume')}, 0)"}], ["vwap_n", "vwap_all"])
_day = "(PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_window(
    "vwap_anchored",
    [{"tp": _TP}, {"vol": f"nullif(sum(volume) OVER {_day}, 0)", "p1": f"sum(tp * volume) OVER {_day}", "p2": f"sum(tp * tp * volume) OVER {_day}"}, {"vwap_anchor": "p1 / vol", "sd": "sqrt(greatest(0.0, p2 / vol - (p1 / vol) * (p1 / vol)))"}],
    ["vwap_anchor"],
)
_window("volume_ratio", [{"volume_ratio": f"volume / nullif({roll('avg', 'volume', 20)}, 0)"}], ["volume_ratio"])
_window("pvsra", [{"a": roll("avg", "volume", 10, 1), "f": "(high - low) * volume"}, {"m": roll("max", "f", 10, 1)}, {"pvsra": "CASE WHEN volume >= 2 * a OR f >= m THEN 2 WHEN volume >= 1.5 * a THEN 1 ELSE 0 END * CASE WHEN close > open THEN 1 ELSE -1 END"}], [], ("pvsra",))
_window("liquidity_zone", [{"sd": roll("stddev_samp", "close", 20), "mv": roll("avg", "volume", 20)}, {"a": "avg(sd) OVER (PARTITION BY symbol)"}, {"liquidity_zone": "coalesce(volume > 2 * mv AND sd > a, false)::INTEGER"}], [], ("liquidity_zone",))
_levels = {"pp": _TP, "r1": f"2 * {_TP} - low", "s1": f"2 * {_TP} - high", "r2": f"{_TP} + (high - low)", "s2": f"{_TP} - (high - low)", "r3": f"high + 2 * ({_TP} - low)", "s3": f"low - 2 * (high - {_TP})", "woodie": "(high + low + 2 * close) / 4"}
_levels |= {f"camarilla_{s}{n}": f"close {sign} (high - low) * 1.1 / {part}" for n, part in enumerate((12, 6, 4), 1) for s, sign in (("r", "+"), ("s", "-"))}
_x = "CASE WHEN close < open THEN high + 2 * low + close WHEN close > open THEN 2 * high + low + close ELSE high + low + 2 * close END"
_levels |= {"dm_pivot": f"({_x}) / 4", "dm_r1": f"({_x}) / 2 - low", "dm_s1": f"({_x}) / 2 - high"}
_window("pivots", [_levels], list(_levels))
_fibs = {f"fib_{str(x).replace('.', '_')}": f"({roll('max', 'high', 50)}) - {x} * (({roll('max', 'high', 50)}) - ({roll('min', 'low', 50)}))" for x in (0.236, 0.382, 0.5, 0.618, 0.786)}
_window("fibonacci", [_fibs], list(_fibs))
_window("fair_value_gap", [{"fvg": f"CASE WHEN low - {lag('high')} > 0 THEN 1 WHEN {lag('low')} - high > 0 THEN -1 ELSE 0 END"}], [], ("fvg",))
_FRACTALS = {f"fractal_{n}": f"CASE WHEN count(close) OVER {over(-2, 2)} = 5 AND {x} = {f}({x}) OVER {over(-2, 2)} THEN 1 ELSE 0 END" for n, x, f in (("up", "high", "max"), ("down", "low", "min"))}
_window("fractals", [_FRACTALS], [], ("fractal_up", "fractal_down"))
_past = "last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_window("swing_labels", [_FRACTALS, {"ph": "CASE WHEN fractal_up = 1 THEN high END", "pl": "CASE WHEN fractal_down = 1 THEN low END"}, {"wh": _past.format(x="ph"), "wl": _past.format(x="pl")}, {"swing": "CASE WHEN ph > wh THEN 'HH' WHEN ph IS NOT NULL AND wh IS NOT NULL THEN 'LH' WHEN pl < wl THEN 'LL' WHEN pl IS NOT NULL AND wl IS NOT NULL THEN 'HL' END"}], [], ("swing",))
_window("heikin_ashi_plain", [{"ha_close": "(open + high + low + close) / 4", "ha_open": f"({lag('open')} + {lag('close')}) / 2"}], ["ha_close", "ha_open"])
_window("supply_demand", [{"mv": roll("avg", "volume", 20), "mc": roll("avg", "close", 20)}, {"zone": "CASE WHEN volume > 1.5 * mv AND close > mc THEN 1 WHEN volume > 1.5 * mv AND close < mc THEN -1 ELSE 0 END"}], [], ("zone",))
_window("range_detector", [{"tr": TR}, {"atr": roll("avg", "tr", 20), "m": roll("avg", "close", 20), "xs": f"list(close) OVER {over(-19)}"}, {"in_range": "coalesce(len(list_filter(xs, lambda x: abs(x - m) <= atr)) = 20, false)::INTEGER"}], [], ("in_range",))


def _fold(name: str, stages: list[dict[str, str]] | None, *fold_names: str) -> None:
    outputs = [c for n in fold_names for c in recurrences.FOLDS[n][1]]
    _register(f"fold_{name}", lambda b: recurrences.apply(b, *fold_names), stages, outputs)


_A20 = 2 / 21
_fold("ema_family", [{"ema_12": ema("close", 2 / 13), "ema_26": ema("close", 2 / 27), "ema_adj_20": ema_adjusted("close", _A20), "e1": ema("close", _A20)}, {"e2": ema("e1", _A20)}, {"e3": ema("e2", _A20)}, {"dema_20": "2 * e1 - e2", "tema_20": "3 * e1 - 3 * e2 + e3"}], "ema_family")
_fold("macd", [{"macd": f"{ema_adjusted('close', 2 / 13)} - {ema_adjusted('close', 2 / 27)}"}, {"macd_signal": ema_adjusted("macd", 0.2)}, {"macd_hist": "macd - macd_signal"}], "macd")
_fold("rsi_wilder", [_RSI[0], {"mg": wilder("g", 14), "ml": wilder("l", 14)}, {"rsi_wilder": "CASE WHEN ml = 0 AND mg > 0 THEN 100.0 ELSE 100 - 100 / (1 + mg / nullif(ml, 0)) END"}], "rsi_wilder")
_fold("atr_wilder", [{"tr": TR}, {"atr_wilder": wilder("tr", 14), "mid": ema("close", _A20)}, {"keltner_up": "mid + 2 * atr_wilder", "keltner_low": "mid - 2 * atr_wilder"}], "atr_wilder")
_fold(
    "adx_wilder",
    [
        {"u": f"high - {lag('high')}", "d": f"{lag('low')} - low", "tr": TR},
        {"p": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "m": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END"},
        {"plus_di_wilder": f"100 * ({wilder('p', 14)}) / nullif({wilder('tr', 14)}, 0)", "minus_di_wilder": f"100 * ({wilder('m', 14)}) / nullif({wilder('tr', 14)}, 0)"},
        {"dx": "100 * abs(plus_di_wilder - minus_di_wilder) / nullif(plus_di_wilder + minus_di_wilder, 0)"}, {"adx_wilder": wilder("dx", 14)},
    ],
    "adx_wilder",
)
_fold("tsi", [{"d": _STEP}, {"d1": ema_adjusted("d", 2 / 26), "a1": ema_adjusted("abs(d)", 2 / 26)}, {"d2": ema_adjusted("d1", 2 / 14), "a2": ema_adjusted("a1", 2 / 14)}, {"tsi": "100 * d2 / nullif(a2, 0)"}, {"tsi_signal": ema_adjusted("tsi", 0.25)}], "tsi")
_fold("power", [{"mid": ema_adjusted("close", 2 / 14)}, {"bull_power": "high - mid", "bear_power": "low - mid"}], "power")
_fold("heikin_ashi", [{"ha_close_rec": "(open + high + low + close) / 4"}, {"seed": f"coalesce({lag('ha_close_rec')}, (open + close) / 2)"}, {"ha_open_rec": ema("seed", 0.5)}], "heikin_ashi")
_fold("mcginley", [{"mcginley": "list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: CASE WHEN a = 0 THEN x WHEN x = 0 THEN a ELSE a + (x - a) / greatest(1.0, 14 * (x / a) ** 4) END)"}], "mcginley")
# prices here can be near 0, so the published path runs over the close plus 100
_register(
    "fold_mcginley_free", lambda b: recurrences.apply(b.withColumn("close", F.col("close") + 100), "mcginley_free"),
    [{"i": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "seed": roll("avg", "close + 100", 14)}, {"x": "CASE WHEN i = 14 THEN seed WHEN i > 14 THEN close + 100 END"},
     {"mcginley_free": "list_reduce(list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a + (x - a) / (14 * (x / a) ** 4))"}],
    ["mcginley_free"],
)
_EMAS = {f"e{n}": ema_adjusted("close", 2 / (n + 1)) for n in (7, 14, 20, 50, 200)}
_fold(
    "ema_crosses",
    [
        _EMAS, {"short": "sign(round(e7 - e14, 9))", "middle": "sign(round(e20 - e50, 9))", "long": "sign(round(e50 - e200, 9))"},
        {"b_xtrender": "CASE WHEN short > 0 THEN 1.0 ELSE -1.0 END", "ema_stack": "CASE WHEN middle > 0 AND long > 0 THEN 1.0 WHEN middle < 0 AND long < 0 THEN -1.0 ELSE 0.0 END", "ema_cross": f"CASE WHEN long > 0 AND {lag('long')} <= 0 THEN 1.0 WHEN long < 0 AND {lag('long')} >= 0 THEN -1.0 ELSE 0.0 END"},
    ],
    "ema_crosses",
)
_fold("conditional_ema", [{"e14": _EMAS["e14"], "first": f"{lag('close')} IS NULL"}, {"held": "CASE WHEN close > open OR first THEN e14 END"}, {"conditional_ema": carry("held")}], "conditional_ema")
_register(
    "fold_conditional_ema_volume", lambda b: recurrences.by_symbol(b, recurrences.conditional("volume", 150.0), ["conditional_ema"]),
    [{"e14": _EMAS["e14"], "first": f"{lag('close')} IS NULL"}, {"held": "CASE WHEN volume > 150 OR first THEN e14 END"}, {"conditional_ema": carry("held")}], ["conditional_ema"],
)
_fold(
    "ema_oscillators",
    [
        {"wolfpack": f"{ema('close', 0.5)} - {ema('close', 2 / 9)}", "one": ema("(close * 1000)", 2 / 14), "step": f"abs({_STEP})", "raw": f"2 * {ema('close', 2 / 9)} - {ema('close', 2 / 17)}"},
        {"two": ema("one", 2 / 14), "s1": ema("step", 2 / 15), "ehma": ema("raw", 2 / 5)},
        {"force": f"abs(one - two) * ((one - {lag('one')} + two - {lag('two')}) / 2) ** 3", "range_size": f"2.618 * {ema('s1', 2 / 28)}"},
        {"tdfi": f"force / nullif({roll('max', 'abs(force)', 39, least=1)}, 0)"},
    ],
    "ema_oscillators",
)


def _outside(x: str, n: int) -> str:
    m, sd = roll("avg", x, n), roll("stddev_samp", x, n)
    return f"CASE WHEN {x} > ({m}) + ({sd}) THEN 1 WHEN {x} < ({m}) - ({sd}) THEN -1 ELSE 0 END"


_MIXED = [
    {"u": f"high - {lag('high')}", "d": f"low - {lag('low')}", "tr1": f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END"},
    {"p": "CASE WHEN u > abs(d) AND u > 0 THEN u ELSE 0.0 END", "m": "CASE WHEN abs(d) > u AND d < 0 THEN abs(d) ELSE 0.0 END"},
    {"plus_di_mixed": f"100 * ({roll('avg', 'p', 14)}) / nullif({roll('avg', 'tr1', 14)}, 0)", "minus_di_mixed": f"100 * ({roll('avg', 'm', 14)}) / nullif({roll('avg', 'tr1', 14)}, 0)"},
    {"dx": "100 * abs(plus_di_mixed - minus_di_mixed) / nullif(plus_di_mixed + minus_di_mixed, 0)"}, {"adx_mixed": roll("avg", "dx", 14)},
]
_BOUNDS = [*_RSI, {"stoch_k": f"100 * (close - ({roll('min', 'low', 14)})) / nullif({_RANGE14}, 0)"}]
_RANGE20 = f"(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}))"
_PLACE = {"place": f"(close - ({roll('min', 'low', 20)})) / nullif({_RANGE20}, 0)"}
_HH_LL = {"hh_ll_score": "CASE WHEN place > 0.8 THEN 1 WHEN place < 0.2 THEN -1 ELSE 0 END"}
_window("adx_mixed", _MIXED, ["adx_mixed", "plus_di_mixed", "minus_di_mixed"])
_window(
    "adx_clip",
    [
        {"p": f"CASE WHEN high > {lag('high')} THEN high - {lag('high')} WHEN high <= {lag('high')} THEN 0.0 END", "m": f"CASE WHEN low < {lag('low')} THEN {lag('low')} - low WHEN low >= {lag('low')} THEN 0.0 END", "tr": TR},
        {"plus_di_clip": f"100 * (({roll('avg', 'p', 14)}) / nullif({roll('avg', 'tr', 14)}, 0))", "minus_di_clip": f"100 * (({roll('avg', 'm', 14)}) / nullif({roll('avg', 'tr', 14)}, 0))"},
        {"dx": "100 * abs(plus_di_clip - minus_di_clip) / (plus_di_clip + minus_di_clip + 0.001)"}, {"adx_clip": roll("avg", "dx", 14)},
    ],
    ["adx_clip", "plus_di_clip", "minus_di_clip"],
)
_window(
    "dynamic_bounds",
    [*_BOUNDS, {f"{n}_{side}": f"({roll('avg', x, 20)}) {sign} ({roll('stddev_samp', x, 20)})" for x, n in (("rsi", "rsi"), ("stoch_k", "stoch")) for side, sign in (("upper", "+"), ("lower", "-"))} | {"rsi_outside": _outside("rsi", 20), "stoch_outside": _outside("stoch_k", 20)}],
    ["rsi_upper", "rsi_lower", "stoch_upper", "stoch_lower"], ("rsi_outside", "stoch_outside"),
)
_window("range_place", [_PLACE, _HH_LL], [], ("hh_ll_score",))
_window("candle_range", [{"r": "high - low"}, {"candle_range_score": _outside("r", 8)}], [], ("candle_range_score",))
_window("volume_score", [{"volume_score": _outside("volume", 20)}], [], ("volume_score",))
_window("damiani", [{"r": f"close / nullif({lag('close')}, 0) - 1"}, {"damiani": f"({roll('stddev_samp', 'r', 14)}) * sqrt(14)"}], ["damiani"])
_window(
    "waddah_attar",
    [{"m": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20), "tr": TR, "c": lag("close")}, {"a": roll("avg", "tr", 14)}, {"explosion_up": "CASE WHEN close > m + 2 * sd AND close > c + a THEN 1 ELSE 0 END", "explosion_down": "CASE WHEN close < m - 2 * sd AND close < c - a THEN 1 ELSE 0 END"}],
    [], ("explosion_up", "explosion_down"),
)
_window(
    "fractal_dimension",
    [{"span": f"({roll('max', 'close', 14)}) - ({roll('min', 'close', 14)})"}, {"len": " + ".join(f"abs(({lag('close', k)} - {lag('close', k - 1) if k > 1 else 'close'}) / nullif(span, 0) + {1 / 196!r})" for k in range(1, 12))}, {"fdi": "CASE WHEN span = 0 THEN 0.0 WHEN len > 0 THEN 1 + (ln(len) + ln(2)) / ln(28) END"}],
    ["fdi"],
)
_W14 = over(-13)
_window(
    "price_entropy",
    [
        {"h": roll("max", "close", 14), "l": roll("min", "close", 14), "cs": f"list(close) OVER {_W14}", "vs": f"list(volume) OVER {_W14}"},
        {"a": "sqrt(list_sum([v * v for v, i in vs if (cs[i] - l) * 2 >= h - l]))", "z": "sqrt(list_sum([v * v for v, i in vs if (cs[i] - l) * 2 < h - l]))"},
        {"x": "coalesce(a, 0) / nullif(coalesce(a, 0) + coalesce(z, 0), 0)", "y": "coalesce(z, 0) / nullif(coalesce(a, 0) + coalesce(z, 0), 0)"},
        {"entropy": "CASE WHEN h > l THEN CASE WHEN x > 0 THEN -x * log2(x) ELSE 0.0 END + CASE WHEN y > 0 THEN -y * log2(y) ELSE 0.0 END END"},
    ],
    ["entropy"],
)
_window(
    "volume_delta",
    [{"up_volume": "CASE WHEN close > open THEN volume ELSE 0.0 END", "down_volume": "CASE WHEN close < open THEN volume ELSE 0.0 END"}, {"volume_delta": "up_volume - down_volume"}, {"volume_delta_sum": roll("sum", "volume_delta", 20)}],
    ["up_volume", "down_volume", "volume_delta", "volume_delta_sum"],
)
_window("thma", [{"raw": f"3 * ({_weights('close', _linear(5))}) - ({_weights('close', _linear(8))}) - ({_weights('close', _linear(16))})"}, {"thma": _weights("raw", _linear(16))}], ["thma"])
_window("rsi_crossings", [*_RSI, {"was": lag("rsi")}, {"rsi_signal": "CASE WHEN was <= 30 AND rsi > 30 THEN 1 WHEN was >= 70 AND rsi < 70 THEN -1 ELSE 0 END"}], [], ("rsi_signal",))

_STOCH = [{"fast": f"100 * (close - ({roll('min', 'low', 14)})) / nullif({_RANGE14}, 0)"}, {"k": roll("avg", "fast", 3)}, {"d": roll("avg", "k", 3)}, {"side": "sign(round(k - d, 9))"}, {"was": lag("side"), "k0": f"round({lag('k')}, 9)", "k1": "round(k, 9)"}]
_window(
    "stochastic_signals",
    [*_STOCH, {
        "stoch_cross": "CASE WHEN was < 0 AND side > 0 THEN 1 WHEN was > 0 AND side < 0 THEN -1 ELSE 0 END", "stoch_side": "CASE WHEN side > 0 THEN 1 WHEN side < 0 THEN -1 ELSE 0 END",
        "stoch_cross_zone": "CASE WHEN was < 0 AND side > 0 AND k0 < 20 AND k1 > 20 THEN 1 WHEN was > 0 AND side < 0 AND k0 > 80 AND k1 < 80 THEN -1 ELSE 0 END",
    }],
    [], ("stoch_cross", "stoch_cross_zone", "stoch_side"),
)
_window(
    "band_oscillator",
    [
        {"m": roll("avg", "close", 20), "sd": roll("stddev_pop", "close", 20)}, {n: f"(m {e} - close) / nullif(m {e} + close / 2, 0)" for n, e in (("u", "+ 2 * sd"), ("l", "- 2 * sd"), ("b", ""))},
        {f"{n}s": _weights(n, _linear(6)) for n in "ulb"}, {"band_osc": f"-(bs + ({roll('avg', 'bs', 2)}))"}, {"band_osc_trigger": roll("avg", "band_osc", 4)},
        {"ov": "sign(round(band_osc - us, 9))", "un": "sign(round(band_osc - ls, 9))", "way": "sign(round(band_osc - band_osc_trigger, 9))"},
        {"turn": f"CASE WHEN ov > 0 AND {lag('ov')} <= 0 THEN 1 WHEN un < 0 AND {lag('un')} >= 0 THEN -1 END"}, {"cycle": carry("turn")},
        {"band_entry": "CASE WHEN way > 0 AND un >= 0 AND cycle < 0 THEN 1 WHEN way < 0 AND ov <= 0 AND cycle > 0 THEN -1 ELSE 0 END", "band_exit": "CASE WHEN way > 0 AND ov > 0 THEN 1 WHEN way < 0 AND un < 0 THEN -1 ELSE 0 END"},
    ],
    ["band_osc", "band_osc_trigger"], ("band_entry", "band_exit"),
)

def _states(first: dict[str, str], step: dict[str, str], test: str = "true") -> str:
    """The state of a fold after each bar: a struct of the bar's values and the state's, starting as `first`; in step,
    a is the state before and x the bar with its values."""
    element = "{" + ", ".join(f"'{k}': ({v})" for k, v in first.items()) + "}"
    after = "{" + ", ".join(f"'{k}': ({step.get(k, f"x['{k}']")})" for k in first) + "}"
    return f"list_reduce(list({element}) FILTER ({test}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: {after})"


def _let(value: str, name: str, then: str) -> str:
    return f"list_transform([{value}], lambda {name}: {then})[1]"


_NOW = "CASE WHEN x['c'] > a['down'] THEN 1.0 WHEN x['c'] < a['up'] THEN -1.0 ELSE a['now'] END"
_STOPS = {"up": "CASE WHEN a['c'] > a['up'] THEN greatest(x['lo'], a['up']) ELSE x['lo'] END", "down": "CASE WHEN a['c'] < a['down'] THEN least(x['hi'], a['down']) ELSE x['hi'] END"}
_STOP_FIRST = {"lo": "lo", "hi": "hi", "c": "c", "up": "lo", "down": "hi", "now": "1.0::DOUBLE"}
_STOP_OF = "CASE WHEN s['now'] > 0 THEN s['up'] ELSE s['down'] END"
_fold(
    "supertrend",
    [
        {"tr": TR}, {"atr": wilder("tr", 10)}, {"lo": "(high + low) / 2 - 3 * atr", "hi": "(high + low) / 2 + 3 * atr", "c": "close"},
        {"s": _states(_STOP_FIRST, _STOPS | {"now": "CASE WHEN a['now'] < 0 AND x['c'] > a['down'] THEN 1.0 WHEN a['now'] > 0 AND x['c'] < a['up'] THEN -1.0 ELSE a['now'] END"}, "atr IS NOT NULL")},
        {"supertrend": _STOP_OF, "supertrend_side": "s['now']"},
    ],
    "supertrend",
)
_fold(
    "chandelier_exit",
    [
        {"tr": TR, "top": roll("max", "close", 22, least=1), "bottom": roll("min", "close", 22, least=1)}, {"atr": wilder("tr", 22)}, {"lo": "top - 3 * atr", "hi": "bottom + 3 * atr", "c": "close"},
        {"s": _states(_STOP_FIRST, _STOPS | {"now": _NOW}, "atr IS NOT NULL")}, {"chandelier_stop": _STOP_OF, "chandelier_side": "s['now']"},
    ],
    "chandelier_exit",
)
_QQE = {"up": "CASE WHEN a['c'] > a['up'] AND x['c'] > a['up'] THEN greatest(x['lo'], a['up']) ELSE x['lo'] END", "down": "CASE WHEN a['c'] < a['down'] AND x['c'] < a['down'] THEN least(x['hi'], a['down']) ELSE x['hi'] END"}
_fold(
    "qqe",
    [
        _RSI[0], {"mg": wilder("g", 14), "ml": wilder("l", 14)}, {"rsi_w": "CASE WHEN ml = 0 AND mg > 0 THEN 100.0 ELSE 100 - 100 / (1 + mg / nullif(ml, 0)) END"}, {"qqe_line": ema("rsi_w", 1 / 3)}, {"d": f"abs(qqe_line - {lag('qqe_line')})"},
        {"w1": wilder("d", 27)}, {"w2": f"4.238 * ({wilder('w1', 27)})"}, {"lo": "qqe_line - w2", "hi": "qqe_line + w2", "c": "qqe_line"}, {"s": _states(_STOP_FIRST, _QQE | {"now": _NOW}, "w2 IS NOT NULL AND qqe_line IS NOT NULL")}, {"qqe_stop": _STOP_OF},
    ],
    "qqe",
)
_TURN = "CASE WHEN a['up'] THEN x['l'] < s ELSE x['h'] > s END"
_SAR_STOP = "CASE WHEN a['up'] THEN least(a['stop'] + a['share'] * (a['ext'] - a['stop']), x['l1'], x['l2']) ELSE greatest(a['stop'] + a['share'] * (a['ext'] - a['stop']), x['h1'], x['h2']) END"
_BEST = "CASE WHEN a['up'] THEN greatest(a['ext'], x['h']) ELSE least(a['ext'], x['l']) END"
_fold(
    "parabolic_sar",
    [
        {"rises": "coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY ts) >= close, true)", "h1": lag("high"), "l1": lag("low"), "h2": f"coalesce({lag('high', 2)}, {lag('high')})", "l2": f"coalesce({lag('low', 2)}, {lag('low')})", "two": f"{lag('close')} IS NOT NULL"},
        {"s": _states(
            {"h": "high", "l": "low", "h1": "h1", "l1": "l1", "h2": "h2", "l2": "l2", "up": "rises", "stop": "CASE WHEN rises THEN low ELSE high END", "ext": "CASE WHEN rises THEN high ELSE low END", "share": "0.02::DOUBLE"},
            {
                "up": _let(_SAR_STOP, "s", f"CASE WHEN {_TURN} THEN NOT a['up'] ELSE a['up'] END"), "stop": _let(_SAR_STOP, "s", f"CASE WHEN {_TURN} THEN a['ext'] ELSE s END"),
                "ext": _let(_SAR_STOP, "s", f"CASE WHEN {_TURN} THEN CASE WHEN a['up'] THEN x['l'] ELSE x['h'] END ELSE {_BEST} END"),
                "share": _let(_SAR_STOP, "s", f"CASE WHEN {_TURN} THEN 0.02::DOUBLE WHEN {_BEST} <> a['ext'] THEN least(0.2::DOUBLE, a['share'] + 0.02::DOUBLE) ELSE a['share'] END"),
            },
        )},
        {"sar": "CASE WHEN two THEN s['stop'] END"},
    ],
    "parabolic_sar",
)
_PEAK, _TROUGH = "greatest(a['peak'], x['bottom'])", "least(a['trough'], x['top'])"
_FLIP = f"CASE WHEN a['now'] > 0 THEN x['mh'] < {_PEAK} AND x['c'] < x['pl'] ELSE x['ml'] > {_TROUGH} AND x['c'] > x['ph'] END"
_NEXT = f"CASE WHEN {_FLIP} THEN -a['now'] ELSE a['now'] END"
_NEW_PEAK = f"CASE WHEN a['now'] > 0 THEN {_PEAK} WHEN {_FLIP} THEN x['bottom'] ELSE a['peak'] END"
_NEW_TROUGH = f"CASE WHEN a['now'] < 0 THEN {_TROUGH} WHEN {_FLIP} THEN x['top'] ELSE a['trough'] END"
_FOLLOW = f"CASE WHEN {_NEXT} > 0 THEN {_NEW_PEAK} ELSE {_NEW_TROUGH} END"
_fold(
    "half_trend",
    [
        {"top": roll("max", "high", 2, least=1), "bottom": roll("min", "low", 2, least=1), "mh": roll("avg", "high", 2, least=1), "ml": roll("avg", "low", 2, least=1), "ph": lag("high"), "pl": lag("low")},
        {"s": _states(
            {"top": "top", "bottom": "bottom", "mh": "mh", "ml": "ml", "c": "close", "ph": "ph", "pl": "pl", "now": "1.0::DOUBLE", "peak": "bottom", "trough": "'infinity'::DOUBLE", "level": "bottom"},
            {"now": _NEXT, "peak": _NEW_PEAK, "trough": _NEW_TROUGH, "level": f"CASE WHEN {_FLIP} THEN {_FOLLOW} WHEN {_NEXT} > 0 THEN greatest(a['level'], {_FOLLOW}) ELSE least(a['level'], {_FOLLOW}) END"},
        )},
        {"half_trend": "s['level']", "half_trend_side": "s['now']"},
    ],
    "half_trend",
)
_MOVED = "CASE WHEN x['x'] > a['line'] THEN greatest(a['line'], x['x'] - x['r']) ELSE least(a['line'], x['x'] + x['r']) END"
_fold(
    "range_filter",
    [
        {"d": f"abs({_STEP})"}, {"d1": ema_adjusted("d", 2 / 51)}, {"r": f"coalesce(3 * ({ema_adjusted('d1', 2 / 100)}), 0)"},
        {"s": _states({"x": "close", "r": "r", "line": "close", "side": "0.0::DOUBLE"}, {"line": _MOVED, "side": f"CASE WHEN {_MOVED} > a['line'] THEN 1.0 WHEN {_MOVED} < a['line'] THEN -1.0 ELSE a['side'] END"})},
        {"range_filter_line": "s['line']", "range_filter_side": "s['side']"},
    ],
    "range_filter",
)


def _place_sql(x: str, name: str) -> list[dict[str, str]]:
    low, high = roll("min", x, 10, least=1), roll("max", x, 10, least=1)
    return [{f"{name}_raw": f"100 * ({x} - ({low})) / nullif(({high}) - ({low}), 0)"}, {f"{name}_full": f"coalesce({carry(f'{name}_raw')}, 0.0)"}, {name: ema(f"{name}_full", 0.5)}]


_fold("schaff", [{"line": f"{ema('close', 2 / 24)} - {ema('close', 2 / 51)}"}, *_place_sql("line", "p1"), *_place_sql("p1", "p2"), {"stc": "greatest(0.0, least(100.0, p2))"}], "schaff")
_fold(
    "waddah_explosion",
    [
        {"m": f"{ema('close', 2 / 21)} - {ema('close', 2 / 41)}", "tr": TR, "waddah_band": f"4 * ({roll('stddev_pop', 'close', 20)})"}, {"waddah_trend": f"150 * (m - {lag('m')})", "waddah_dead": f"coalesce(3.7 * ({wilder('tr', 100)}), 0.0)"},
        {"waddah_side": "CASE WHEN abs(waddah_trend) > waddah_band AND waddah_band > waddah_dead AND abs(waddah_trend) > waddah_dead THEN sign(waddah_trend)::DOUBLE ELSE 0.0 END"},
    ],
    "waddah_explosion",
)
_fold("zigzag", None, "zigzag")



def indicator_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, momentum and volatility of quarter-hour bars in one pass over one window partitioning."""
    df = ind.apply(bars(spark, sf_dir, "15m"), "sma", "rsi_sma", "bollinger", "atr_sma", "stochastic")
    return rounded(df.select("symbol", "ts", "close", "sma_20", "rsi", "bb_mid", "bb_up", "bb_low", "atr_sma", "stoch_k", "stoch_d"))


QUERIES["indicator_panel"] = indicator_panel
ORACLE_SQL["indicator_panel"] = staged_sql(
    [*_RSI, {"tr": TR}, {"sma_20": roll("avg", "close", 20), "bb_mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20), "atr_sma": roll("avg", "tr", 14), "stoch_k": f"100 * (close - ({roll('min', 'low', 14)})) / nullif({_RANGE14}, 0)"}, {"bb_up": "bb_mid + 2 * sd", "bb_low": "bb_mid - 2 * sd", "stoch_d": roll("avg", "stoch_k", 3)}],
    ["close", "sma_20", "rsi", "bb_mid", "bb_up", "bb_low", "atr_sma", "stoch_k", "stoch_d"], "15 minutes",
)


def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.volume_profile(bars(spark, sf_dir), 20))


QUERIES["volume_profile"] = volume_profile
ORACLE_SQL["volume_profile"] = f"""WITH {TICKS_SQL}, b AS ({bars_sql()}), m AS (SELECT symbol, min(close) AS lo, max(close) AS hi, sum(volume) AS a FROM b GROUP BY 1),
p AS (SELECT symbol, least(19, floor(coalesce((close - lo) * 20 / nullif(hi - lo, 0), 0)))::INTEGER AS bin, volume, a FROM b JOIN m USING (symbol)), g AS (SELECT symbol, bin, sum(volume) AS volume, max(a) AS a FROM p GROUP BY 1, 2),
r AS (SELECT symbol, bin, volume, volume / nullif(a, 0) AS share FROM g) SELECT symbol, bin, {round_sql('volume', 'share')} FROM r"""


def halo_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of 20 over blocks of 200 bars led by the 19 bars before, so that one symbol takes many tasks."""
    from pyspark.sql.window import Window

    cut = frames.halo(bars(spark, sf_dir), 19, 200)
    w = Window.partitionBy("symbol", "__block").orderBy("ts").rowsBetween(-19, 0)
    out = cut.withColumn("sma_20", F.when(F.count("close").over(w) >= 20, F.avg("close").over(w))).where("not __halo")
    return rounded(out.select("symbol", "ts", "sma_20"))


QUERIES["halo_sma"] = halo_sma
ORACLE_SQL["halo_sma"] = ORACLE_SQL["ind_sma"]
