"""Near-duplicate documents by circulant MinHash.

A document's set has its distinct runs of SHINGLE_WORDS words (64-bit hashes; two sets of a thousand
shingles confuse one with a chance of 1e-13). Two permutations give a signature of any length: the first
scatters the shingles over the slots, the second, shifted circularly by k, gives coordinate k as its least
value over the slots. Coordinates are banded, and documents equal in a band are candidates. The rows of
a band are chosen so that a pair at the threshold is missed in all bands with a chance of 1e-6 at most.

Documents with equal sets are one node. Every node is first held against the least one that it shares a
bucket with; then, in buckets whose nodes aren't yet in one component, against the least one of each
bucket, and then against one that a hash picks for each bucket. Those passes are linear. Where components
still meet in a bucket, each node outside the largest of them is held against those of all others. A pair
is made there only in the first bucket that both share, and only if the lowest bits of two longer
signatures (CHECK_COORDINATES) differ in few enough places; a pair at the threshold fails that with a
chance of 1e-6. So no pair of candidates that could join two components is left out, and none is made
within a component. Buckets with many comparisons are dealt over a grid of tasks. What stays quadratic in
a bucket's size is the comparison of bits between nodes that no link joins. Every link is confirmed on
the full sets.

Defined results: without words (null, empty, blank) n_shingles is 0 and the document is linked with
nothing; rows with the same id are one document whose links are those of all its rows; a null id is
never linked, its component is null and it is kept; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import drop_table, hash_runs, hash_words, in_blocks, lookup, materialize, mix64, split_words
from tidebars.llm.graph import components

SHINGLE_WORDS = 5
BANDS = 48
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
SLOTS = 1 << 20
SEED = 20240229
#: Coordinates whose lowest bits are compared before a pair is made.
CHECK_COORDINATES = 2048
#: Deviations that the differing bits of two signatures may lie above what a pair at the threshold has on average; a
#: pair at the threshold lies above them with a chance of MISS.
BIT_DEVIATIONS = 4.75
#: Comparisons of bits that one task makes in a bucket.
TASK_COMPARISONS = 4_000_000


def rows_per_band(percent: int, bands: int = BANDS) -> int:
    """The most rows with which a pair of that similarity is missed by all bands with a chance of MISS at most."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


class Circulant:
    """Signatures of so many coordinates."""

    def __init__(self, coordinates: int):
        order = np.random.default_rng(SEED).permutation(SLOTS).astype(np.int32)
        wound = np.concatenate([order, order[:coordinates]])
        self.shifts = np.lib.stride_tricks.sliding_window_view(wound, coordinates)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Row i of shifts holds the values of slot i under all shifts of the second permutation."""
        slots = ((shingles >> np.uint64(44)) * np.uint64(636413) + np.uint64(12345)) & np.uint64(SLOTS - 1)
        slots = slots.astype(np.int64)
        least = self.shifts[slots[:512]].min(axis=0)
        for k in range(512, len(slots), 512):
            np.minimum(least, self.shifts[slots[k : k + 512]].min(axis=0), out=least)
        return least


_circulants: dict[int, Circulant] = {}


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band, with its number, of each signature."""
    parts = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        total = mix64(total * np.uint64(31) + parts[:, :, k])
    return total.view(np.int64)


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [split_words(t) for t in texts]
    hashes = hash_words([w for own in split for w in own])
    runs = hash_runs(hashes, width) if len(hashes) >= width else np.empty(0, np.uint64)
    out, at = [], 0
    for own in split:
        n = len(own)
        out.append(np.unique(runs[at : at + n - width + 1] if n >= width else hash_runs(hashes[at : at + n], width)))
        at += n
    return out


def most_differing(percent: int, coordinates: int = CHECK_COORDINATES) -> int:
    """In so many coordinates the lowest bits may differ: those of unequal ones are equal with a chance of a half."""
    share = (100 - percent) / 200
    return int(coordinates * share + BIT_DEVIATIONS * (coordinates * share * (1 - share)) ** 0.5) + 1


def _circulant(coordinates: int) -> Circulant:
    if coordinates not in _circulants:
        _circulants[coordinates] = Circulant(coordinates)
    return _circulants[coordinates]


def _differing(words: int) -> Column:
    """The number of bits in which the arrays x and y of so many longs differ."""
    return sum(F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(words))


def signatures(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(id, n_shingles, digest, bands, bits) of each row; digest is null without words."""
    id_type = docs.schema[id_col].dataType.simpleString()
    coordinates = bands * rows_per_band(percent, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _circulant(coordinates)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_blocks(texts):
                sets = shingle_sets(texts[a:b])
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = np.array([sign(sets[i]) for i in full]).reshape(len(full), coordinates)
                hashed = dict(zip(full, band_hashes(signed, bands)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([hashed.get(i) for i in range(b - a)], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "digest", "bands"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_shingles long, digest binary, bands array<long>")


def _check_bits(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bits): the lowest bits of CHECK_COORDINATES coordinates, for those of ids."""
    id_type = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _circulant(CHECK_COORDINATES)
        for batch in batches:
            grams = batch.column(1)
            bits = [np.packbits((sign(g.values.to_numpy().view(np.uint64)) & 1).astype(np.uint8)).view(np.int64) for g in grams]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["id", "bits"])

    return sets.join(ids, "id", "left_semi").select("id", "grams").mapInArrow(run, f"id {id_type}, bits array<long>")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grams) of the rows of docs with one of ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_blocks(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.list_(pa.int64()))], ["id", "grams"])

    return some.select("id", "text").mapInArrow(run, f"id {id_type}, grams array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("t")).where(100 * F.col("n") >= percent * (F.col("t") - F.col("n"))).select("a", "b")


def _with_components(members: DataFrame, linked: DataFrame) -> DataFrame:
    return materialize(members.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")


def _hub_pass(members: DataFrame, linked: DataFrame, order: Column) -> DataFrame:
    """The pairs (a, b) of the first node by `order` of each bucket and one of another component."""
    known = _with_components(members, linked)
    own = known.groupBy("key").agg(F.min_by("id", order).alias("hub"), F.min_by("component", order).alias("at"), F.min("component").alias("low"), F.max("component").alias("high"))
    live = own.where("low <> high").select("key", "hub", "at")
    apart = known.drop("hub").join(live, "key").where(F.col("component") != F.col("at"))
    return apart.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("buckets")).select("a", "b")


def _second_pass(members: DataFrame, nodes: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links that join components across buckets' nodes not yet held against each other; None if no bucket has two components."""
    known = _with_components(members.where("size > 2"), linked)
    each = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    each = each.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("parts"))
    grid = F.ceil(F.sqrt((F.col("size") - F.col("most")) * F.col("size") / F.lit(TASK_COMPARISONS))).cast("int")
    live = materialize(each.where("parts > 1").select("key", "major", grid.alias("grid")), "live")
    if live.isEmpty():
        return None
    known = materialize(known.join(live, "key"), "known")
    bits = materialize(_check_bits(sets, known.select("id").distinct()), "bits")
    known = known.join(nodes.select("id", "n_shingles", "bands"), "id").join(bits, "id")
    own, all_ = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    minor = known.where("component <> major").select("key", "band", "major", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"), F.col("bits").alias("x"), F.col("bands").alias("xb"), own.alias("i"), all_.alias("j"))
    other = known.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n_shingles").alias("nb"), F.col("bits").alias("y"), F.col("bands").alias("yb"), all_.alias("i"), own.alias("j"))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    close = _differing(CHECK_COORDINATES // 64) <= most_differing(percent)
    before = F.arrays_overlap(F.slice("xb", F.lit(1), F.col("band")), F.slice("yb", F.lit(1), F.col("band")))
    pairs = minor.join(other, ["key", "i", "j"]).where(apart & sized & close & ~before).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(confirm(pairs, sets, percent), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links of at least percent similarity), kept."""
    signed = materialize(signatures(docs, percent, id_col, text_col, bands), "signatures")
    usable = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    nodes = usable.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("first"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("digest", "copies", "first.*"), "nodes")
    banded = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(hubs, "key"), "members")
    sets = materialize(_sets(docs, members.select("id").distinct(), id_col, text_col), "sets")
    first = members.where("id <> hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
    links = materialize(confirm(first, sets, percent), "links")
    linked = components(links)
    for order in (F.col("id"), F.xxhash64("id", "key")):
        pairs = materialize(_hub_pass(members, linked, order), "pairs")
        more = materialize(confirm(pairs, sets, percent), "links")
        links = linked.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more)
        linked = components(links)
    more = _second_pass(members, nodes, linked, sets, percent)
    if more is not None:
        linked = components(links.unionByName(more))
    classes = nodes.select("digest", "copies", "id").join(linked, "id", "left").where("copies > 1 or component is not null")
    classes = materialize(classes.select("digest", "copies", F.coalesce("component", "id").alias("component")), "classes")
    for done in (members, sets):
        drop_table(done)
    out = lookup(signed.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")), classes, "digest", "copies")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. All columns pass through."""
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = found.where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
