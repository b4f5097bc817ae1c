"""Time-series analytics on PySpark DataFrames: bars, joins, indicators, regimes, backtests, streams."""
