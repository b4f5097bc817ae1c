"""Repeated passages: word windows joined over the whole corpus, extended to maximal spans.

A passage may be wrapped into short lines or stand inside a longer line, so its windows are runs of
WINDOW_WORDS words of the text, whatever the line breaks. A window is removed if its words stand in a text
of a smaller id, or further up in the same text without overlap; windows that overlap or touch are one span.

Each window has an anchor, the least hash of the runs of ANCHOR_WORDS words in it, and equal windows have equal
anchors. Neighbouring windows with the same anchor are one stretch, a row with the anchor and a hash of all
its words. Stretches whose anchor occurs once hold no repeat. Of those left, a stretch whose words all stand
in a text of a smaller id goes as a whole; only the others are taken apart into windows, which are held
against each other by their hashes. That drops no repeat, and few windows become rows. All hashes have 64
bits.

Defined results: words are compared in lower case (code points that lower to several stay as they are); null
and short texts have no windows; rows with the same id are one document, whose rows lose nothing to each
other; rows with a null id are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import in_blocks, lookup, materialize, mix64
from tidebars.llm.secrets import mask

#: Words of a window: the shortest passage that is removed.
WINDOW_WORDS = 50
#: Words of the runs of which the least hash is a window's anchor.
ANCHOR_WORDS = 12

_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """The powers 0 to n of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers.shape[1] <= n:
        size = max(n + 1, 1 << 16)
        _powers = np.ones((2, size), np.uint64)
        _powers[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        np.multiply.accumulate(_powers, axis=1, out=_powers)
    return _powers


class Ranges:
    """Hashes of any ranges of a sequence, the same wherever the range lies in it."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(len(values))[0, : len(values)])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * _power(len(self.sums))[1, starts] + (ends - starts).astype(np.uint64))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end code point of each word of the text, and its hash in lower case."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], ~_SPACE[np.minimum(code, len(_SPACE) - 1)], [False]])
    cuts = np.flatnonzero(inside[1:] != inside[:-1])
    return cuts[::2], cuts[1::2], Ranges(code.astype(np.uint64) + np.uint64(1))(cuts[::2], cuts[1::2])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of so many values: of the rest of one block and the beginning of the next."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    begun = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(rest[:n], begun[width - 1 : width - 1 + n])


def _stretches(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and end of each run of neighbouring windows whose anchor stands at the same place."""
    run = min(ANCHOR_WORDS, size)
    at = np.arange(len(words) - run + 1)
    # the last bits say where a run stands, within 2 ** bits places; an anchor is what is left without them
    bits = np.uint64((size - run + 1).bit_length())
    least = _least(Ranges(words)(at, at + run) >> bits << bits | at.astype(np.uint64) & (np.uint64(1) << bits) - np.uint64(1), size - run + 1)
    low = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[low] >> bits, low, np.concatenate([low[1:], [len(least)]])


def _table(batch: pa.RecordBatch, keys: int, parts: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """The first columns of batch at the rows that the first of each part names, and the other parts."""
    columns = [np.concatenate(x) for x in zip(*parts)] or [np.empty(0, np.int64)] * (len(kinds) + 1)
    where = pa.array(columns[0].astype(np.int64))
    values = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)).cast(k) for x, k in zip(columns[1:], kinds)]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(keys)), *values], names)


def stretches(keyed: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, __key, anchor, whole, low, high, start, end): the windows [low, high) of each text that share an anchor.

    whole is a hash of all words of the stretch, start and end are its code points.
    """
    id_type = keyed.schema[id_col].dataType.simpleString()
    names, kinds = [id_col, "__key", "anchor", "whole", "low", "high", "start", "end"], [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_blocks(texts):
                parts = []
                for i in range(a, b):
                    starts, ends, words = _words(texts[i] or "")
                    if len(words) >= size:
                        anchor, low, high = _stretches(words, size)
                        parts.append((np.full(len(low), i), anchor, Ranges(words)(low, high + size - 1), low, high, starts[low], ends[high + size - 2]))
                yield _table(batch, 2, parts, names, kinds)

    return keyed.select(id_col, "__key", text_col).mapInArrow(run, f"`{id_col}` {id_type}, __key long, anchor long, whole long, low int, high int, start long, end long")


def _windows(keyed: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, __key, place, first, start, end, digest) of each window in the ranges of the column `ranges`.

    place counts words, start and end code points; first is the first equal window of the same text.
    """
    id_type = keyed.schema[id_col].dataType.simpleString()
    names, kinds = [id_col, "__key", "place", "first", "start", "end", "digest"], [pa.int32()] * 2 + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in in_blocks(texts, 1_000_000):
                parts = []
                for i in range(a, b):
                    starts, ends, words = _words(texts[i])
                    place = np.unique(np.concatenate([np.arange(r["low"], r["high"]) for r in ranges[i]]))
                    digest = Ranges(words)(place, place + size)
                    _, first, at = np.unique(digest, return_index=True, return_inverse=True)
                    parts.append((np.full(len(place), i), place, place[first[at]], starts[place], ends[place + size - 1], digest))
                yield _table(batch, 2, parts, names, kinds)

    return keyed.select(id_col, "__key", text_col, "ranges").mapInArrow(run, f"`{id_col}` {id_type}, __key long, place int, first int, start long, end long, digest long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """A row for each span to remove: id, start, end, first_word, n_words, and a smaller id that holds its first window
    (its own if it stands further up in the same text)."""
    keyed = docs.select(id_col, F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"), text_col).where(F.col(id_col).isNotNull())
    every = materialize(stretches(keyed, id_col, text_col, size), "stretches")
    again = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("found", F.lit(True))
    some = materialize(lookup(every, materialize(again, "anchors"), "anchor", "n").where("found").drop("found", "anchor"), "repeated")
    wholes = some.groupBy("whole").agg(F.min(id_col).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    held = materialize(lookup(some, materialize(wholes, "wholes"), "whole", "n").withColumn("goes", F.coalesce(F.col("keeper") < F.col(id_col), F.lit(False))), "held")
    ranges = held.where("not goes").groupBy("__key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    windows = materialize(_windows(keyed.join(materialize(ranges, "ranges"), "__key"), id_col, text_col, size), "windows")
    groups = windows.where("place = first").groupBy("digest").agg(F.min(id_col).alias("keeper"), F.count("*").alias("n"))
    found = lookup(windows, materialize(groups.where("n > 1"), "digests"), "digest", "n")
    alone = found.where((F.col("keeper") < F.col(id_col)) | (F.col("place") >= F.col("first") + size)).select(id_col, "__key", F.col("place").alias("low"), (F.col("place") + 1).alias("high"), "start", "end", F.coalesce("keeper", id_col).alias("keeper"))
    gone = held.where("goes").select(id_col, "__key", "low", "high", "start", "end", "keeper").unionByName(alone)
    each = gone.groupBy(id_col, "__key").agg(F.sort_array(F.collect_set(F.struct("low", "high", "start", "end", "keeper"))).alias("gone"))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "__key", "start", "end", "first_word", "n_words", f"keeper_{id_col}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for i, own in enumerate(batch.column(2).to_pylist()):
                last = None
                for w in own:
                    words = w["high"] - 1 + size - w["low"]
                    if last is None or w["low"] > last[3] + last[4]:
                        last = [i, w["start"], w["end"], w["low"], words, w["keeper"]]
                        rows.append(last)
                    elif w["low"] + words > last[3] + last[4]:
                        last[2], last[4] = w["end"], w["low"] + words - last[3]
            columns = list(zip(*rows)) or [()] * 6
            where = pa.array(columns[0], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), batch.column(0).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)

    return each.select(id_col, "__key", "gone").mapInArrow(run, f"`{id_col}` {id_type}, __key long, start long, end long, first_word int, n_words int, `keeper_{id_col}` {id_type}")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """docs without repeated passages and with `removed`, in place of a column so named: their original (start, end)."""
    docs = docs.drop("removed")
    spans = repeats(docs.select(id_col, text_col), id_col, text_col, size).distinct()
    each = spans.groupBy(F.col("__key").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__removed"))
    joined = docs.withColumn("__of", F.xxhash64(F.col(id_col), F.col(text_col))).join(each, "__of", "left")
    places = F.transform("__removed", lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    rest = mask(F.col(text_col), places, lambda _: F.lit(""))
    return joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns, F.col("__removed").alias("removed"))
