"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item, and at least one word shingle of
an item of that size, gets a SimHash of PRINT_BITS bits over its weighted shingles, in which a shingle votes
with the square root of its weight, so that the angle follows the similarity that is checked. Multi-index
Hamming blocks hold the items' fingerprints: two fingerprints within RADIUS differ by at most BLOCK_RADIUS
bits in one of the blocks of BLOCK_BITS bits, so probing each block at all patterns of so few bits finds
every item within the radius. The exact weighted Jaccard similarity of the shingles then verifies each
candidate. A window at the threshold lies outside the radius with a chance of 1e-5 (binomial, by the angle
of similarity 0.8); a fingerprint at random meets one item in 7 in some block, and none of 10**15 within the
radius. A window without a shingle of an item has similarity 0, so leaving it out loses nothing. A document
of fewer words than an item is one window as a whole; it is held against each longer item whose shared
weight admits the similarity, without fingerprints.

Rarer shingles weigh more. How many items have a shingle is counted over the whole benchmark, in
COUNT_BUCKETS hashed buckets, so weights and results don't depend on how the benchmark is dealt.

The benchmark is the stated query set: it is taken in parts of bounded size, one at a time, each held
against all documents where they lie.

Defined results: null and empty texts match nothing, and so do items without words; equal
items each match; repeated rows match each; an empty table on either side gives an empty result; items'
ids are of any type, null included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidebars.llm.common import hash_runs, hash_words, in_blocks, materialize, mix64, split_words

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
PRINT_BITS = 256
BLOCK_BITS = 16
BLOCK_RADIUS = 3
RADIUS = PRINT_BITS // BLOCK_BITS * (BLOCK_RADIUS + 1) - 1
COUNT_BUCKETS = 1 << 22
#: Items that are held against the documents at once.
ITEMS_AT_ONCE = 20_000
#: Characters of items that are indexed at once; one item longer than that is still a part of its own.
CHARS_AT_ONCE = 20_000_000

_BITS = np.arange(64, dtype=np.uint64)
#: All patterns of at most BLOCK_RADIUS bits of a block.
_PROBES = np.array([sum(1 << k for k in some) for n in range(BLOCK_RADIUS + 1) for some in combinations(range(BLOCK_BITS), n)], np.uint16)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The SimHash, as 64-bit words, of the `count` shingles from each of starts on."""
    words = [mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(PRINT_BITS // 64)]
    ones = np.concatenate([(w[:, None] >> _BITS & np.uint64(1)).astype(np.float64) for w in words], axis=1)
    votes = np.sqrt(weights)[:, None]
    total = np.concatenate([np.zeros((1, PRINT_BITS)), np.cumsum((ones * 2 - 1) * votes, axis=0)])
    bits = (total[starts + count] - total[starts]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(at[: len(a)], weights=wa, minlength=len(keys))
    y = np.bincount(at[len(a) :], weights=wb, minlength=len(keys))
    most = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / most) if most else 0.0


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket in which items with each shingle are counted."""
    return (mix64(shingles) >> np.uint64(20) & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)


def item_shingles(text: str | None) -> tuple[int, np.ndarray]:
    """Words of an item and its shingles; of an item of fewer than SHINGLE_WORDS words all its words are one."""
    words = split_words(text)
    return len(words), hash_runs(hash_words(words), min(SHINGLE_WORDS, len(words)))


@dataclass
class Spread:
    """In how many items of the whole benchmark the shingles of each bucket are."""

    items: int
    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Spread:
        own = [bucket_of(np.unique(x)) for n, x in map(item_shingles, texts) if n]
        buckets, counts = np.unique(np.concatenate([np.empty(0, np.int64), *own]), return_counts=True)
        return cls(len(own), buckets, counts)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """1 + ln((1 + items) / (1 + items with it))."""
        have = np.zeros(len(shingles))
        if len(self.buckets):
            bucket = bucket_of(shingles)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            have = np.where(self.buckets[at] == bucket, self.counts[at], 0)
        return 1 + np.log((1 + self.items) / (1 + have))


@dataclass
class Index:
    """A part of the items: their shingles, weights and fingerprints, and what finds them."""

    ids: list
    spread: Spread
    sizes: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)  # the weight of all shingles
    known: dict[int, np.ndarray] = field(default_factory=dict)  # by shingle width: sorted shingles
    owners: dict[tuple[int, int], list[int]] = field(default_factory=dict)  # by width and shingle: items
    prints: np.ndarray | None = None
    firsts: np.ndarray | None = None  # by block and its value: where its items begin in `held`
    held: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], spread: Spread | None = None) -> Index:
        own = [(i, *item_shingles(t)) for i, t in rows]
        own = [(i, size, grams) for i, size, grams in own if size]
        index = cls([i for i, _, _ in own], spread or Spread.of([t for _, t in rows]))
        prints = np.zeros((len(own), PRINT_BITS // 64), np.uint64)
        for n, (_, size, grams) in enumerate(own):
            width, weights = min(SHINGLE_WORDS, size), index.weights(grams)
            index.sizes.append(size)
            index.shingles.append(grams)
            index.totals.append(float(weights.sum()))
            prints[n] = fingerprints(grams, weights, np.zeros(1, np.int64), len(grams))[0]
            for s in set(grams.tolist()):
                index.owners.setdefault((width, s), []).append(n)
        for width in {w for w, _ in index.owners}:
            index.known[width] = np.array(sorted(s for w, s in index.owners if w == width), np.uint64)
        index.prints = prints
        values = prints.view(np.uint16).astype(np.int64) + (np.arange(PRINT_BITS // BLOCK_BITS) << BLOCK_BITS)
        order = np.argsort(values.T.ravel(), kind="stable")
        index.held = (order % max(1, len(own))).astype(np.int32)
        index.firsts = np.searchsorted(values.T.ravel()[order], np.arange((PRINT_BITS // BLOCK_BITS << BLOCK_BITS) + 1)).astype(np.int32)
        return index

    def weights(self, shingles: np.ndarray, width: int = 0) -> np.ndarray:
        return self.spread.weights(shingles)

    def near(self, print_: np.ndarray, size: int) -> list[int]:
        """The items of so many words whose fingerprints lie within RADIUS."""
        blocks = print_.view(np.uint16)
        probed = (blocks[:, None] ^ _PROBES).astype(np.int64) + (np.arange(len(blocks)) << BLOCK_BITS)[:, None]
        full = np.flatnonzero(self.firsts[probed + 1] > self.firsts[probed])
        found = [self.held[self.firsts[v] : self.firsts[v + 1]] for v in probed.ravel()[full].tolist()]
        if not found:
            return []
        some = np.unique(np.concatenate(found))
        apart = np.bitwise_count(self.prints[some] ^ print_).sum(axis=1)
        return [n for n in some[apart <= RADIUS].tolist() if self.sizes[n] == size]


def _runs(words: np.ndarray, index: Index) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle width: the shingles of all words, and whether each is an item's."""
    found = {}
    for width, keys in index.known.items():
        runs = hash_runs(words, width) if len(words) >= width else np.empty(0, np.uint64)
        table = np.zeros(1 << 20, bool)
        table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        may = np.flatnonzero(table[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        hit = np.zeros(len(runs), bool)
        hit[may] = keys[np.minimum(np.searchsorted(keys, runs[may]), len(keys) - 1)] == runs[may]
        found[width] = runs, hit
    return found


def _longer(own: np.ndarray, weights: np.ndarray, places: list[int], words: int, width: int, index: Index, least: float) -> Iterator[tuple[int, float]]:
    """(item, similarity) of each item of more words than the whole document, of which places are an item's shingles."""
    owners = [index.owners[width, int(own[p])] for p in places]
    items, at = np.unique(np.concatenate(owners), return_inverse=True)
    shared = np.bincount(at, weights=np.repeat(weights[places], [len(x) for x in owners]))
    total = float(weights.sum())
    for n, most in zip(items.tolist(), shared.tolist()):
        if index.sizes[n] > words and most >= (least - 1e-9) * (total + index.totals[n] - most):
            same = similarity(own, weights, index.shingles[n], index.weights(index.shingles[n], width))
            if same >= least:
                yield n, same


def matches(texts: list[str | None], index: Index, least: float = LEAST_SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of the best window of each text and item."""
    split = [split_words(t) for t in texts]
    ends = np.cumsum([0, *map(len, split)])
    by_width = _runs(hash_words([w for own in split for w in own]), index)
    found: dict[tuple[int, int], tuple[float, int]] = {}
    longest = max(index.sizes, default=0)
    for width, (runs, hit) in by_width.items():
        at = np.flatnonzero(hit)
        doc = np.searchsorted(ends, at, side="right") - 1
        inside = at + width <= ends[doc + 1]
        for d in np.unique(doc[inside]).tolist():
            first, last = int(ends[d]), int(ends[d + 1])
            own = runs[first : last - width + 1]
            starts: dict[int, set[int]] = {}
            places = (at[inside & (doc == d)] - first).tolist()
            for p in places:
                for size in {index.sizes[n] for n in index.owners[width, int(own[p])]}:
                    starts.setdefault(size, set()).update(range(max(0, p - size + width), min(p, last - first - size) + 1))
            weights = index.weights(own, width)
            if last - first < longest:
                found.update({(d, n): (same, 0) for n, same in _longer(own, weights, places, last - first, width, index, least)})
            for size, where in starts.items():
                where = np.array(sorted(where), np.int64)
                if not len(where):
                    continue
                low, count = int(where[0]), size - width + 1
                reach = slice(low, int(where[-1]) + count)
                prints = fingerprints(own[reach], weights[reach], where - low, count)
                for s, print_ in zip(where.tolist(), prints):
                    for n in index.near(print_, size):
                        item = index.shingles[n]
                        same = similarity(own[s : s + count], weights[s : s + count], item, index.weights(item, width))
                        if same >= least and (same, -s) > found.get((d, n), (0.0, 0)):
                            found[d, n] = same, -s
    return [(d, n, -s, min(index.sizes[n], len(split[d])), same) for (d, n), (same, s) in sorted(found.items())]


def count_spread(benchmark: DataFrame, item_text: str = "text") -> Spread:
    """Counted in the tasks and added up by bucket; at most COUNT_BUCKETS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = Spread.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([-1, *part.buckets]), pa.array([part.items, *part.counts], pa.int64())], ["bucket", "n"])

    rows = benchmark.select(item_text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().sort_by("bucket")
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    return Spread(int(n[bucket < 0].sum()), bucket[bucket >= 0], n[bucket >= 0])


def _part_count(benchmark: DataFrame, item_text: str, most: int) -> int:
    """In how many parts the benchmark is indexed, so that each has at most about `most` items and CHARS_AT_ONCE characters."""
    n, chars = benchmark.agg(F.count("*"), F.sum(F.length(item_text))).first()
    return max(1, -(-n // most), -(-(chars or 0) // CHARS_AT_ONCE))


def _parts(benchmark: DataFrame, item_col: str, item_text: str, parts: int) -> Iterator[Index]:
    """The index of each part of the benchmark, dealt by hash."""
    spread = count_spread(benchmark, item_text)
    for part in range(parts):
        items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where(F.pmod(F.xxhash64(item_col, item_text), F.lit(parts)) == part)
        yield Index.build(sorted(((r["i"], r["t"]) for r in items.collect()), key=str), spread)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SIMILARITY, most_items: int = ITEMS_AT_ONCE) -> DataFrame:
    """A row for each document and item that it holds: both ids, start_word, n_words, similarity."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, start_word long, n_words long, similarity double"
    arrow_type = to_arrow_type(item_type)
    found: list[DataFrame] = []
    for own in _parts(benchmark, item_col, item_text, _part_count(benchmark, item_text, most_items)):
        if found:  # what the last part found is written before the next one's index is shared
            found[-1] = materialize(found[-1], "leaks")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in in_blocks(texts):
                    rows = matches(texts[a:b], index, least) if index.ids else []
                    columns = list(zip(*rows)) or [()] * 5
                    item = pa.array([index.ids[n] for n in columns[1]], arrow_type)
                    numbers = [pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(columns[0], pa.int64())), item, *numbers], [id_col, item_col, "start_word", "n_words", "similarity"])

        found.append(docs.select(id_col, text_col).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST_SIMILARITY, most_items: int = ITEMS_AT_ONCE) -> DataFrame:
    """docs without those that hold a benchmark item; all columns pass through.

    A benchmark of one part filters documents where they lie. With more parts, each writes the hashes of the
    texts that go, and the documents are then held against all of these.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    if _part_count(benchmark, item_text, most_items) == 1:
        shared = spark.sparkContext.broadcast(next(_parts(benchmark, item_col, item_text, 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for a, b in in_blocks(texts):
                    bad = {r[0] for r in matches(texts[a:b], shared.value, least)} if shared.value.ids else set()
                    yield batch.slice(a, b - a).filter(pa.array([i not in bad for i in range(b - a)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    texts = docs.select(F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("text"))
    gone = find(texts, benchmark, "__key", "text", item_col, item_text, least, most_items).select("__key").distinct()
    return docs.withColumn("__text_key", F.xxhash64(text_col)).join(materialize(gone, "leaks"), F.col("__text_key") == F.col("__key"), "left_anti").select(docs.columns)
