"""Table functions called from SQL."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tidebars.functions import sql


def test_table_functions(spark):
    sql.register(spark)
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    values = [3.0, 3.0, None, None, 5.0, 3.0, 3.0, 3.0]
    rows = [("x", at(k), v, "extra") for k, v in enumerate(values)] + [("y", at(k), float(k * k % 7), "extra") for k in range(40)] + [("z", at(0), None, None)]
    spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double, begun string").repartition(5).createOrReplaceTempView("t_rows")
    runs = spark.sql("SELECT * FROM runs_of(TABLE(t_rows), 'v')").where("symbol <> 'y'").collect()
    want = [("x", "3.0", at(0), at(1), 2), ("x", None, at(2), at(3), 2), ("x", "5.0", at(4), at(4), 1), ("x", "3.0", at(5), at(7), 3), ("z", None, at(0), at(0), 1)]
    assert sorted((tuple(r) for r in runs), key=lambda r: (r[0], r[2])) == want
    found = spark.sql("SELECT symbol, ts, ema FROM ema_of(TABLE(t_rows), 'v', 5) ORDER BY symbol, ts").toPandas()
    y = pd.Series([float(k * k % 7) for k in range(40)]).ewm(span=5, adjust=False).mean()
    assert (found[found.symbol == "y"].ema.to_numpy() - y.to_numpy()).__abs__().max() < 1e-12
    assert found[found.symbol == "x"].ema.tolist()[:4] == [3.0] * 4 and found[found.symbol == "z"].ema.isna().all()
    assert spark.sql("SELECT * FROM runs_of(TABLE(SELECT * FROM t_rows WHERE false), 'v')").count() == 0
    for bad in ("runs_of(TABLE(t_rows), 'w')", "ema_of(TABLE(t_rows), 'v', 0)", "runs_of(TABLE(SELECT v FROM t_rows), 'v')"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {bad}").collect()
