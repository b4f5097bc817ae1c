"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score): one weight vector over hashed text features is shared by
all grades, and ordered thresholds part them. The model is fitted on a bounded sample of the labelled
documents and then grades every document: expected grade and the probability of the upper tail.

Features of a text, each near an average over it: its distinct letter runs in lower case and their first letters,
what stands between letter runs, and buckets of the shares of capitals and of distinct words.

Defined results: a null text counts as empty and is graded like any other; an empty table gives an empty
one; without labelled rows, or with one grade alone, the score is 0 and every document is kept; repeated
rows and extra columns pass through; a column named like a result gives way to it in `grade`, and passes
through `select` as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import in_blocks

#: Hashed features; a power of two.
BUCKETS = 1 << 17
#: Labelled documents that the model is fitted on, at most: those with the least hashes of their ids.
SAMPLE_DOCS = 5000
#: The value of a bucket feature, against 1 for all letter runs of a text together.
EXTRA = 0.5
#: A feature has a weight if so many documents of the sample have it.
LEAST_DOCS = 6
#: A document is kept if its probability of the highest grade is at least so much.
LEAST_TAIL = 0.6

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]")
#: Prefixes of letter runs that are features, by their number of bytes.
_PREFIXES = (4, 5, 6)


def _salted(parts: list[bytes], salt: int) -> np.ndarray:
    if not parts:
        return np.empty(0, np.int64)
    hashes = pd.util.hash_array(np.array(parts, dtype=object), categorize=False)
    hashes = (hashes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _texts(texts: list[str | None]) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    words: list[bytes] = []
    between: list[bytes] = []
    counts, extra = [], []
    for text in texts:
        raw = (text or "").encode()
        low = raw.lower()
        own = _LETTERS.findall(low)
        gaps = _LETTERS.split(low)
        once = list(dict.fromkeys(own))
        words += once
        between += gaps
        counts.append((len(once), len(gaps)))
        capitals = len(_CAPITALS.findall(raw)) / max(1, len(raw))
        fresh = len(once) / max(1, len(own))
        extra.append((b"capitals%d" % int(capitals * 10), b"distinct%d" % int(fresh * 10)))
    sizes = np.array(counts, dtype=np.int64).reshape(-1, 2)
    return words, between, sizes[:, 0], sizes[:, 1], extra


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, value and document number of each entry."""
    words, between, n_words, n_between, extra = _texts(texts)
    docs = np.arange(len(texts))
    at, share = np.repeat(docs, n_words), np.repeat(np.maximum(n_words, 1) ** -0.75, n_words)
    code, runs = pd.factorize(np.array(words, dtype=object)) if words else (np.empty(0, np.int64), [])
    found = [(hashed[code], share, at) for hashed in _word_features(list(runs))]
    code, gaps = pd.factorize(np.array(between, dtype=object)) if between else (np.empty(0, np.int64), [])
    found.append((_salted(list(gaps), 2)[code], np.repeat(1.0 / np.maximum(n_between, 1), n_between), np.repeat(docs, n_between)))
    found += [(_salted([e[k] for e in extra], 100 + k), np.full(len(docs), EXTRA), docs) for k in (0, 1)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _word_features(runs: list[bytes]) -> list[np.ndarray]:
    return [_salted(runs, 1), *(_salted([w[:n] for w in runs], 10 + n) for n in _PREFIXES)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ordered, one fewer than grades

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The sum over each text's features, taken once for each distinct letter run of all texts."""
        words, between, n_words, n_between, extra = _texts(texts)
        docs, n = np.arange(len(texts)), len(texts)
        total = EXTRA * sum(self.weights[_salted([e[k] for e in extra], 100 + k)] for k in (0, 1))
        if words:
            code, runs = pd.factorize(np.array(words, dtype=object))
            each = sum(self.weights[h] for h in _word_features(list(runs)))
            total = total + np.bincount(np.repeat(docs, n_words), weights=each[code], minlength=n) * np.maximum(n_words, 1) ** -0.75
        code, gaps = pd.factorize(np.array(between, dtype=object))
        each = self.weights[_salted(list(gaps), 2)]
        return total + np.bincount(np.repeat(docs, n_between), weights=each[code], minlength=n) / np.maximum(n_between, 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document and threshold k."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def fit(feature: np.ndarray, value: np.ndarray, doc: np.ndarray, grade: np.ndarray, passes: int = 30, rate: float = 8.0, parts: int = 16, decay: float = 2e-6) -> Model:
    """Maximum likelihood by AdaGrad over parts of the rows in turn; grades are 0, 1, ..."""
    grades, n = int(grade.max(initial=0)) + 1, len(grade)
    if n == 0 or len(np.unique(grade)) < 2:
        return Model(np.zeros(BUCKETS), np.full(max(1, grades - 1), -10.0))
    known = np.bincount(feature, minlength=BUCKETS) >= LEAST_DOCS
    feature, value, doc = (x[known[feature]] for x in (feature, value, doc))
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-10)
    share = np.clip(np.array([(grade > k).mean() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # thresholds: the first, and the logarithms of the gaps, so that they stay in order
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    free_seen = np.full(len(free), 1e-10)
    batches = []
    for p in range(parts):
        own = doc % parts == p
        batches.append((feature[own], value[own], doc[own] // parts, grade[p::parts]))
    for turn in range(passes):
        pace = rate * (1 - turn / passes)
        for feature, value, doc, grade in batches:
            if not len(grade):
                continue
            gaps = np.exp(free[1:])
            cuts = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(doc, weights=weights[feature] * value, minlength=len(grade))
            ends = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = ends[grade + 1] - score, ends[grade] - score
            p_up, p_low = _logistic(upper), _logistic(lower)
            mass = np.maximum(p_up - p_low, 1e-12)
            d_up, d_low = np.where(np.isinf(upper), 0, p_up * (1 - p_up) / mass), np.where(np.isinf(lower), 0, p_low * (1 - p_low) / mass)
            slope = (d_up - d_low) / len(grade)  # of the loss by the score
            grad = np.bincount(feature, weights=slope[doc] * value, minlength=BUCKETS) + decay * weights
            seen += grad * grad
            weights -= pace * grad / np.sqrt(seen)
            by_cut = np.array([(np.where(grade == k + 1, d_low, 0) - np.where(grade == k, d_up, 0)).mean() for k in range(grades - 1)])
            by_free = np.concatenate([[by_cut.sum()], [gaps[k] * by_cut[k + 1 :].sum() for k in range(len(gaps))]])
            free_seen += by_free * by_free
            free -= 0.1 * by_free / np.sqrt(free_seen)
    return Model(weights, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def _feature_rows(docs: DataFrame, text_col: str, grade_col: str, id_col: str) -> DataFrame:
    """id, grade, features and values of each document, equal features added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_blocks(texts):
                feature, value, doc = features(texts[a:b])
                key, at = np.unique(doc * BUCKETS + feature, return_inverse=True)
                total = np.bincount(at, weights=value, minlength=len(key))
                ends = np.searchsorted(key, np.arange(1, b - a) * BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.split((key % BUCKETS).astype(np.int32), ends), pa.list_(pa.int32())), pa.array(np.split(total.astype(np.float32), ends), pa.list_(pa.float32()))],
                    ["id", "grade", "features", "shares"],
                )

    return docs.select(F.col(id_col).cast("string"), F.col(grade_col).cast("int"), text_col).mapInArrow(run, "id string, grade int, features array<int>, shares array<float>")


def train(docs: DataFrame, labels: DataFrame, grade, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> Model:
    """Fit on the labelled documents. grade: a column over labels.

    The sample is bounded by `most` ids, so it is broadcast to the documents; their features, at most
    BUCKETS a document, come to the driver. An id counts once, however many rows have it: with its least
    grade and the text of the least hash.
    """
    chosen = labels.select(id_col, grade.alias("__grade")).where(F.col(id_col).isNotNull() & F.col("__grade").isNotNull())
    chosen = chosen.groupBy(id_col).agg(F.min("__grade").alias("__grade")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    least = F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col)))
    one = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "__grade").agg(least.alias(text_col))
    rows = _feature_rows(one, text_col, "__grade", id_col).toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    if not rows.num_rows:
        return Model(np.zeros(BUCKETS), np.full(1, -10.0))
    sizes = pa.compute.list_value_length(rows["features"]).to_numpy()
    feature, value = (rows[c].combine_chunks().flatten().to_numpy() for c in ("features", "shares"))
    return fit(feature, value, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), rows["grade"].to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: Model, text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """docs with expected_grade, tail (probability of the highest grade) and kept, in place of columns so named."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds))
    results = ["expected_grade", "tail", "kept"]
    passed = [(c, kind) for c, kind in docs.dtypes if c.lower() not in results]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in passed) + ", expected_grade double, tail double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in in_blocks(texts):
                tails = shared.value.tails(shared.value.scores(texts[a:b]))
                part = batch.slice(a, b - a)
                found = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*(c for c, _ in passed), *results])

    return docs.select(*(c for c, _ in passed), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def select(docs: DataFrame, model: Model, text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs that the model keeps, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in in_blocks(texts):
                tails = shared.value.tails(shared.value.scores(texts[a:b]))
                yield batch.slice(a, b - a).filter(pa.array(tails[:, -1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def ratings(quality: str = "quality", toxic: str = "toxic"):
    """The grade of a label: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col(toxic) > 0, 0).when(F.col(quality) < 1, 1).when(F.col(quality) >= 1, 2)
