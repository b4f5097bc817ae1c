"""What several of the operators share: scratch tables, joins that bear hot keys, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many; there are fewer hot keys than this.
HOT_SHARE = 200

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, an own temporary one, in local mode alone."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidebars-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, deleted when the session's file system closes."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Rows of a small table that one task writes.
TASK_ROWS = 16384


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage and survives lost executors.

    rows: about how many there are, if known; few rows are then written by few tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None and (tasks := 1 + rows // TASK_ROWS) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table which no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of rows with table, whose key is unique and whose weight says how many rows have it.

    Keys with more than one row in HOT_SHARE (fewer than HOT_SHARE keys, whatever the input) are
    broadcast; the others are shuffled, and none of them can fill a task. Rows with a null key get nulls.
    Both sides should be materialized, since they are read more than once.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * HOT_SHARE > total).drop(weight)
    cold = table.where(F.col(weight) * HOT_SHARE <= total).drop(weight)
    some, none = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    on_hot = some.join(F.broadcast(hot), key)
    rest = some.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    empty = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in (key, weight)]
    return on_hot.unionByName(rest).unionByName(none.select("*", *empty))


def ascii_lower(col: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8, A-Z in lower case; bytes split and lower by ASCII alone."""
    return (text or "").encode().lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def hash_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width neighbouring word hashes; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, width)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = mix64(total + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    return total + np.uint64(width)


def in_blocks(texts: list, most_chars: int = 4_000_000):
    """Slices of texts with about most_chars in each, so that work arrays stay small whatever the batch."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= most_chars):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
