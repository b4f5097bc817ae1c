"""Substring dedup by line hashing.

A text's units are its lines. Each unit of enough words is normalised (lower case, white space as one
space) and hashed; digests are grouped over the whole corpus, and of equal units only the earliest by
rank (id, then place) stays. Every removed unit keeps its offsets in the original text.

Defined results: null and empty texts have no units; rows with the same id are one document, whose rows
lose no unit to each other; rows with a null id are left alone; an empty table gives an empty one; a column
named `removed` gives way to the result of `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import in_blocks, lookup, materialize
from tidebars.llm.secrets import _bound

#: Shorter units are left alone: headings, signatures and the like repeat in clean text as well.
LEAST_WORDS = 20


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, __key, unit, first_unit, start, end, n_words, digest) of each unit of at least so many words.

    Offsets are in code points; first_unit is the first equal unit of the same text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"), text_col).where(F.col(id_col).isNotNull())
    names = [id_col, "__key", "unit", "first_unit", "start", "end", "n_words", "digest"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def of(text: str) -> Iterator[tuple]:
        start, seen = 0, {}
        for k, line in enumerate(text.split("\n")):
            words = line.lower().split()
            if len(words) >= least_words:
                digest = hashlib.md5(" ".join(words).encode()).digest()
                yield k, seen.setdefault(digest, k), start, start + len(line), len(words), digest
            start += len(line) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_blocks(texts):
                found = [(i, row) for i in range(a, b) for row in of(texts[i] or "")]
                where = pa.array([i for i, _ in found], pa.int64())
                columns = list(zip(*(row for _, row in found))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return keyed.mapInArrow(run, f"`{id_col}` {id_type}, __key long, unit int, first_unit int, start long, end long, n_words int, digest binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each unit to remove: id, unit, start, end, n_words, and the id and unit of the one that stays.

    Digests are counted before the shuffle; hot ones are looked up by broadcast, so no task gets all copies.
    """
    every = materialize(units(docs, id_col, text_col, least_words), "units")
    groups = every.where("unit = first_unit").groupBy("digest").agg(F.min(id_col).alias("first"), F.min_by("unit", id_col).alias("first_place"), F.count("*").alias("n"))
    found = lookup(every, materialize(groups.where("n > 1"), "repeated"), "digest", "n")
    again = found.where((F.col("unit") != F.col("first_unit")) | (F.col(id_col) != F.col("first")))
    keeper = [F.coalesce("first", id_col).alias(f"keeper_{id_col}"), F.coalesce("first_place", "first_unit").alias("keeper_unit")]
    return again.select(id_col, "__key", "unit", "start", "end", "n_words", *keeper)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without repeated units (each with its line break) and with `removed`: their original (start, end)."""
    spans = repeats(docs, id_col, text_col, least_words).distinct()
    each = spans.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("unit", "start", "end"))).alias("__removed"))
    docs = docs.drop("removed")
    joined = docs.withColumn("__of", F.xxhash64(F.col(id_col), F.col(text_col))).join(each.withColumnRenamed("__key", "__of"), "__of", "left")
    gone = F.transform("__removed", lambda r: r["unit"])
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    clean = F.array_join(_bound(F.split(F.col(text_col), "\n", -1), lambda lines: F.transform(left(lines), lambda i: F.get(lines, i))), "\n")
    removed = F.transform("__removed", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns, removed.alias("removed"))
