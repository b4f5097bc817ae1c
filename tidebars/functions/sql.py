"""Table functions for SQL: state carried along the rows of a symbol, as

    SELECT * FROM ema_of(TABLE(bars), 'close', 10)
    SELECT * FROM runs_of(TABLE(bars), 'zone')

Both partition their table by `symbol` and order it by `ts` themselves, and hold one row's state: memory doesn't grow with a
symbol's history, though a symbol is one task. Null values: an exponential mean stays as it is (null before the first value), a
run goes on while the value is null too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, Row, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidebars import session

_ORDER = {"partitionBy": [PartitioningColumn("symbol")], "orderBy": [OrderingColumn("ts")]}


def _checked(table: AnalyzeArgument, column: AnalyzeArgument, *numbers: AnalyzeArgument) -> StructField:
    """The field of the named column; what isn't a table with symbol, ts and that column is an error of the query's analysis."""
    if not table.isTable or not column.isConstantExpression or column.value is None or not all(n.isConstantExpression for n in numbers):
        raise ValueError("expected a table, the name of a column and constants")
    missing = [n for n in ("symbol", "ts", column.value) if n not in table.dataType.names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table.dataType[column.value]


class EmaOf:
    """Rows of the table (symbol, ts, value of the column) with their exponential mean of so many rows, begun at the first value."""

    def __init__(self):
        self.mean = None

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        _checked(table, column, rows)
        if rows.value is None or rows.value < 1:
            raise ValueError("an exponential mean is over one row at least")
        kind = table.dataType
        return AnalyzeResult(schema=StructType([kind["symbol"], kind["ts"], StructField(column.value, DoubleType()), StructField("ema", DoubleType())]), **_ORDER)

    def eval(self, row: Row, column: str, rows: int) -> Iterator[tuple]:
        value = None if row[column] is None else float(row[column])
        if value is not None:
            self.mean = value if self.mean is None else self.mean + 2 / (rows + 1) * (value - self.mean)
        yield row["symbol"], row["ts"], value, self.mean


class RunsOf:
    """Of each stretch of equal values of the column: symbol, the value as text, first and last ts, and its rows."""

    def __init__(self):
        self.run = None

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        _checked(table, column)
        at = table.dataType["ts"].dataType or TimestampNTZType()
        return AnalyzeResult(schema=StructType([table.dataType["symbol"], StructField("value", StringType()), StructField("begun", at), StructField("ended", at), StructField("bars", LongType())]), **_ORDER)

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        value = row[column]
        if self.run is not None and self.run[1] == value:
            self.run[3], self.run[4] = row["ts"], self.run[4] + 1
            return
        yield from self.terminate()
        self.run = [row["symbol"], value, row["ts"], row["ts"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            symbol, value, begun, ended, bars = self.run
            self.run = None
            yield symbol, None if value is None else str(value), begun, ended, bars


def register(spark: SparkSession) -> SparkSession:
    """Make ema_of and runs_of known to the session's SQL."""
    session.ship(spark)
    spark.udtf.register("ema_of", udtf(EmaOf))
    spark.udtf.register("runs_of", udtf(RunsOf))
    return spark
