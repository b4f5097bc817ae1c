"""Window frames over a symbol's bars, null until they are full, as rolling windows with a minimum of rows are.

Windows run by symbol. `blocked` cuts a symbol's history into blocks first, each led by the rows that its windows look
back on, so that one symbol with all the bars takes many tasks; what looks back without bound can't be cut so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY, TIME = "symbol", "ts"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(key: str = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def rows(first: int, last: int = 0) -> WindowSpec:
    return ordered().rowsBetween(first, last)


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def rolling(agg, x: Column | str, n: int, least: int | None = None, shift: int = 0) -> Column:
    """agg over the last n rows (those up to `shift` rows ago), null with fewer than `least` values (n, if not given)."""
    w = rows(-(n - 1) - shift, -shift)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), agg(col(x)).over(w))


def mean(x, n: int, **kw) -> Column:
    return rolling(F.avg, x, n, **kw)


def total(x, n: int, **kw) -> Column:
    return rolling(F.sum, x, n, **kw)


def highest(x, n: int, **kw) -> Column:
    return rolling(F.max, x, n, **kw)


def lowest(x, n: int, **kw) -> Column:
    return rolling(F.min, x, n, **kw)


def deviation(x, n: int, ddof: int = 1, **kw) -> Column:
    return rolling(F.stddev_samp if ddof else F.stddev_pop, x, n, **kw)


def quantile(x, q: float, n: int, **kw) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(q)), x, n, **kw)


def values(x, n: int) -> Column:
    """The last n values as an array, oldest first; null until there are n."""
    w = rows(-(n - 1))
    return F.when(F.count(col(x)).over(w) >= n, F.collect_list(col(x)).over(w))


def weighted(x, weights: list[float]) -> Column:
    """The sum of the last values times weights (oldest first)."""
    pairs = F.zip_with(values(x, len(weights)), F.array(*[F.lit(float(w)) for w in weights]), lambda a, w: a * w)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p)


def before(x, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered()) if k >= 0 else F.lead(col(x), -k).over(ordered())


def change(x, k: int = 1) -> Column:
    return col(x) - before(x, k)


def returns(x, k: int = 1) -> Column:
    return safe(col(x), before(x, k)) - 1


def safe(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def carry(x: Column) -> Column:
    """The last value so far that isn't null."""
    return F.last(x, ignorenulls=True).over(so_far())


def stacked(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """df with the columns of one stage after another, where later ones use windows over earlier ones."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def halo(df: DataFrame, lookback: int, block_rows: int) -> DataFrame:
    """df cut into time blocks of one symbol, each led by copies of the `lookback` rows before it.

    Windows of at most lookback + 1 rows can then run by (symbol, __block), so that one symbol's history
    is spread over many tasks; drop the rows with __halo afterwards. Row numbers come from counts of
    calendar days, never from one sort of a whole symbol.
    """
    day = F.to_date(TIME)
    counted = df.withColumn("__day", day)
    days = counted.groupBy(KEY, "__day").count()
    starts = days.select(KEY, "__day", F.coalesce(F.sum("count").over(Window.partitionBy(KEY).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = counted.join(starts, [KEY, "__day"]).withColumn("__row", F.col("__start") + F.row_number().over(Window.partitionBy(KEY, "__day").orderBy(TIME)) - 1)
    block = F.floor(F.col("__row") / block_rows)
    last = F.floor((F.col("__row") + lookback) / block_rows)
    copies = numbered.withColumn("__own", block).withColumn("__block", F.explode(F.sequence(block, last)))
    return copies.withColumn("__halo", F.col("__block") != F.col("__own")).drop("__day", "__start", "__own")


#: Rows of a symbol that one task holds in `blocked`, besides those before them.
BLOCK_ROWS = 32768


def blocked(df: DataFrame, build: Callable[[DataFrame], DataFrame], lookback: int, block_rows: int | None = None) -> DataFrame:
    """build(df), run by blocks of a symbol. No value that build adds may depend on more than `lookback` rows before its own,
    or on any after it. Within build, symbol names the block, and __row counts the symbol's rows from 0."""
    cut = halo(df, lookback, block_rows or BLOCK_ROWS).withColumnRenamed(KEY, "__symbol")
    out = build(cut.withColumn(KEY, F.concat_ws("#", "__symbol", F.col("__block").cast("string"))))
    kept = [F.col("__symbol").alias(KEY) if c == KEY else F.col(c) for c in out.columns if c == KEY or not c.startswith("__")]
    return out.where(~F.col("__halo")).select(*kept)
