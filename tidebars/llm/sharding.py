"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a number from the record's key alone; the shard whose draw, stretched by its weight,
comes first gets the record. A new shard only takes records in whose race it comes first, so no record
moves between old shards. Places within a shard are dealt in two levels, so that neither a shard nor
the table is ever sorted in one task.

Defined results: records with the same key share a shard and have slots of their own; a null key counts
as the text 'null', a null text as an empty one; columns named shard, slot or grown_shard give way to the
results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of the hash that part a shard into buckets for its slots: 16**3 counts a shard.
BUCKET_DIGITS = 3


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential waiting time of the shard for this key, shorter for larger weights."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def shard_of(draws: Column, shards: int) -> Column:
    """The first of the draws of shards 0 to shards - 1."""
    some = F.slice(draws, 1, shards)
    return (F.array_position(some, F.array_min(some)) - 1).cast("int")


def assign(rows: DataFrame, key_col: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """rows with `shard`; with grown_weight also `grown_shard`, as it will be with one more shard of that weight."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    every = [*weights, *([] if grown_weight is None else [grown_weight])]
    drawn = rows.withColumn("__draws", F.array(*[_draw(key, s, w) for s, w in enumerate(every)]))
    out = drawn.withColumn("shard", shard_of(F.col("__draws"), len(weights)))
    if grown_weight is not None:
        out = out.withColumn("grown_shard", shard_of(F.col("__draws"), len(every)))
    return out.drop("__draws")


def with_slots(rows: DataFrame, key_col: str, order: Sequence[str] = ()) -> DataFrame:
    """rows of assign() with `slot`, gapless from 0 in each shard.

    Rows of a shard go to buckets by a hash of key and order; rows equal in all of these share one. Counts of all buckets (16**BUCKET_DIGITS a shard, whatever
    the input) give each bucket its first slot, and rows are numbered within their bucket.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    # a key that many rows have goes to many buckets, by what `order` tells its rows apart
    apart = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order]
    dealt = rows.withColumn("__bucket", F.substring(F.md5(F.concat_ws(":", key, *apart, F.lit("slot"))), 1, BUCKET_DIGITS))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "__bucket").count()
    firsts = counts.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bucket").orderBy(key_col, *order)
    placed = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(F.broadcast(firsts), ["shard", "__bucket"])
    return placed.withColumn("slot", (F.col("__first") + F.col("__rank")).cast("long")).drop("__bucket", "__first", "__rank")


def write_shards(rows: DataFrame, path: str, shards: int) -> None:
    """A folder shard=<n> for each shard, as Parquet; hot shards are split over many tasks first."""
    rows.repartition(shards * 8, "shard", F.pmod(F.xxhash64("slot"), F.lit(8))).write.partitionBy("shard").parquet(path)


def plan(docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard under the law 'key'; texts are never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        key_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return with_slots(assign(small, key_col, [1.0] * shards, 1.0), key_col, ("text_crc32", "size"))
