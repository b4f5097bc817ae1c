"""Vector code compression: product quantization with codebooks of whole numbers.

Each component becomes floor(256 * x), each vector is cut into equal consecutive parts, and each part
position has a codebook. A codebook is bounded by its parameters (parts * entries * part width), so it
is broadcast; a task takes Arrow batches of vectors and gets all distances to the entries from
|x|^2 - 2 x.c + |c|^2 with int64 matrix products. Each round the tasks add up, by part and entry, the
components of what they assigned; these sums meet in one grouped shuffle of at most parts * entries *
width rows a task, and the entries become floor(sum / count). All is in whole numbers, so the result
depends neither on the order of the rows nor on how they are dealt over tasks.

Defined results: rows whose vector is null or holds a null or non-finite component take no part. Vectors
are as long as the longest, rounded up to whole parts; shorter ones are followed by zeros. Components
saturate at `vectors.largest` (2 ** 24 at 64 dimensions, x = 65536), so that no distance overflows;
label_error is null if its sum doesn't fit a long. Rows with a null id are coded but start no codebook;
of rows with the same id the lesser vector comes first. With fewer kept rows than entries, there are as
many entries; without any id there is none, codes are zeros and errors 0. Repeated rows each get their own result, null labels are one group, an empty table gives
an empty one. Columns other than the three named don't pass through, so none of them can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import lookup, materialize
from tidebars.llm.vectors import usable, whole_numbers

#: Rows of a batch whose distances are held at once.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """entries: int64 of (part, entry, position within the part)."""

    entries: np.ndarray

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, row) of the nearest entry, ties to the lower index, and of its squared distance."""
        parts, _, width = self.entries.shape
        x = rows.reshape(len(rows), parts, width).transpose(1, 0, 2)
        far = (x * x).sum(axis=2)[:, :, None] - 2 * np.matmul(x, self.entries.transpose(0, 2, 1)) + (self.entries * self.entries).sum(axis=2)[:, None, :]
        best = far.argmin(axis=2)
        return best, np.take_along_axis(far, best[:, :, None], axis=2)[:, :, 0]

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that the codes stand for, in the scale of the components."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), self.entries.shape[0])
        return self.entries[np.arange(self.entries.shape[0]), at].reshape(len(codes), self.dims)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector")).where(usable("__vector"))


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """Each part of the vectors of the least ids."""
    longest = vectors.agg(F.max(F.size("__vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = vectors.where(F.col("__id").isNotNull()).orderBy("__id", "__vector").limit(entries).select("__id", "__vector").toArrow()
    first = first.take(pa.compute.sort_indices(first["__id"]))  # stable, so equal ids stay as they came
    rows = whole_numbers(first["__vector"].combine_chunks(), max(1, width * parts))[:, : width * parts]
    return Codebooks(rows.reshape(len(rows), parts, width).transpose(1, 0, 2).copy())


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round of assigning all vectors and taking means."""
    parts, entries, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = whole_numbers(batch.column(0), parts * width)
            for a in range(0, len(rows), BLOCK_ROWS):
                block = rows[a : a + BLOCK_ROWS]
                best, _ = shared.value.nearest(block)
                for p in range(parts):
                    counts[p] += np.bincount(best[p], minlength=entries)
                    np.add.at(sums[p], best[p], block[:, p * width : (p + 1) * width])
        part, entry, place = (x.ravel().astype(np.int32) for x in np.indices(sums.shape))
        used = np.repeat(counts.ravel(), width)
        some = used > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (part, entry, place, sums.ravel(), used)], ["part", "entry", "place", "total", "n"])

    sums = vectors.select("__vector").mapInArrow(add, "part int, entry int, place int, total long, n long")
    moved = books.entries.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(moved)


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks that begin with the vectors of the least ids and take all vectors' means `rounds` times; entries: 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = _vectors(df, id_col, vector_col)
    books = _first_entries(vectors, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = _moved(vectors, books)
    return books


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code and error of each row that takes part; vectors as in `train`."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    kept = df.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__vector")).where(usable("__vector"))
    kinds = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, _ = shared.value.entries.shape
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                if shared.value.entries.size:
                    best, far = shared.value.nearest(whole_numbers(part.column(2), shared.value.dims))
                else:  # no row has an id, or all vectors are empty
                    best, far = np.zeros((parts, part.num_rows), np.int64), np.zeros((parts, part.num_rows), np.int64)
                codes = [r.tobytes().hex() for r in np.ascontiguousarray(best.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(far.sum(axis=0))], ["__id", "__label", "code", "error"])

    coded = kept.mapInArrow(run, f"__id {kinds['__id']}, __label {kinds['__label']}, code string, error long")
    return coded.select(F.col("__id").alias(id_col), F.col("__label").alias(label_col), "code", "error")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each row that takes part.

    The codes are written once; the sums of labels are joined back with hot labels apart, so that one label may hold most rows.
    """
    books = train(df, id_col, vector_col, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col("__label").cast("string")), F.lit("null"))
    coded = materialize(encode(df, books, id_col, vector_col, label_col).toDF("__id", "__label", "code", "error").select("__id", key.alias("__key"), "code", "error"), "codes")
    sums = materialize(coded.groupBy("__key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("__n")), "label-errors")
    return lookup(coded, sums, "__key", "__n").select(F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
