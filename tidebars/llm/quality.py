"""Quality rules: counts of plain defects, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one over all trusted documents (those labelled so),
one over the whole corpus. A document's score is the mean over its n-grams of the
logarithm of the two smoothed probabilities' ratio, so that length doesn't matter, and every document is
held against the same threshold.

Defined results: a null or blank text has no words and fails the base rules; without trusted documents
every ratio is 0 and only the base rules decide; repeated rows each get a result; an empty table gives an
empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import hash_runs, hash_words, in_blocks

#: Buckets of the hashed n-grams (a power of two) and bytes in an n-gram.
BUCKETS = 1 << 15
GRAM_BYTES = 4
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
#: A document is kept if the mean ratio of its n-grams is at least so much.
LEAST_RATIO = -0.25
#: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW_WORDS = 5

_BLANKS = re.compile("[\x20\x09-\x0d]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def _grams(raw: bytes) -> np.ndarray:
    """The bucket of each n-gram; a shorter text is one n-gram."""
    data = np.frombuffer(raw.ljust(GRAM_BYTES, b"\0") if raw else b"", np.uint8).astype(np.uint32)
    if not len(data):
        return np.empty(0, np.uint32)
    n = len(data) - GRAM_BYTES + 1
    joined = data[:n].copy()
    for k in range(1, GRAM_BYTES):
        joined <<= np.uint32(8)
        joined |= data[k : k + n]
    joined *= np.uint32(2654435761)
    joined >>= np.uint32(33 - BUCKETS.bit_length())
    return joined


def count(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, trusted, corpus): n-gram counts of the trusted documents and of all. trusted: different ids, of any number.

    Texts are shuffled once by id, whatever the number of ids, since that has no bound for a broadcast; rows without an
    id, which are never trusted, stay where they lie. Each task then adds up its own documents, so at most BUCKETS rows of
    each are shuffled again.
    """
    named, ids = docs.select(id_col, text_col), trusted.select(id_col, F.lit(True).alias("__trusted"))
    marked = named.where(F.col(id_col).isNotNull()).join(ids.hint("shuffle_hash"), id_col, "left")
    marked = marked.select(text_col, "__trusted").unionByName(named.where(F.col(id_col).isNull()).select(text_col, F.lit(None).cast("boolean").alias("__trusted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(_grams((text or "").encode()), minlength=BUCKETS)
                counts[1] += found
                if own:
                    counts[0] += found
        some = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "trusted", "corpus"])

    parts = marked.select(text_col, "__trusted").mapInArrow(run, "bucket int, trusted long, corpus long")
    return parts.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("corpus").alias("corpus"))


def ratios(counts: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of each bucket; counts has BUCKETS rows at most."""
    rows = counts.toPandas()
    table = np.zeros((2, BUCKETS))
    table[0, rows["bucket"]], table[1, rows["bucket"]] = rows["trusted"], rows["corpus"]
    if not table[0].sum():
        return np.zeros(BUCKETS)
    share = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(share[0] / share[1])


def _repeated(words: list[bytes]) -> int:
    """Words in windows that occur twice or more."""
    if len(words) <= WINDOW_WORDS:
        return 0
    runs = hash_runs(hash_words(words), WINDOW_WORDS)
    _, at, times = np.unique(runs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[at] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, again, 1)
    np.add.at(inside, again + WINDOW_WORDS, -1)
    return int((np.cumsum(inside) > 0).sum())


def defects(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(words), len(text) - len(_BLANKS.findall(text)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), _repeated(words)


def judge(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Per row: id, the defects, base_failed, the mean ratio and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_blocks(texts):
                found = np.array([defects(t or "") for t in texts[a:b]], np.int64).reshape(-1, len(names))
                mean = np.array([table[g].mean() if len(g := _grams((t or "").encode())) else 0.0 for t in texts[a:b]])
                failed = (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(found[:, k]) for k in range(len(names))), pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= least_ratio))],
                    [id_col, *names, "base_failed", "mean_ratio", "kept"],
                )

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, mean_ratio double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def trusted_ids(labels: DataFrame, good, id_col: str = "doc_id") -> DataFrame:
    """The ids of all labelled documents for which the column `good` holds."""
    return labels.where(good & F.col(id_col).isNotNull()).select(id_col).distinct()


def apply(docs: DataFrame, labels: DataFrame, good, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(docs, ratios(count(docs, trusted_ids(labels, good, id_col), id_col, text_col)), id_col, text_col)
