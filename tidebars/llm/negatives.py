"""Hard-negative mining by a two-dimensional block matrix multiplication.

The score matrix anchors x rows is laid out in tiles. Rows are sharded into blocks and their components
into chunks of dimensions; the anchors of a block, with the same chunk, travel to every block of rows.
A task multiplies an anchor block by a row block over one chunk of dimensions, which gives a partial
tile of int64 scores; the partial tiles of one place are shuffled together and added. Of a tile only a
few scores an anchor stay: the best of the anchor's label, or the best within each positive's window;
then the best of these over all tiles. No score leaves its tile otherwise, and no task holds more than
a few tiles, however many rows there are.

Blocks are cut within LABEL_GROUPS hashed groups of labels, so that positives are looked for in the
blocks of the anchor's group alone, and negatives skip blocks that hold nothing but the anchor's label.
A label with most of the rows is cut into as many blocks as it needs, by row and not by key. As anchors
are a given share of the rows, scores grow with the square of the table; what a task holds doesn't.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part.
A null id is no anchor, but a row like others; among equal scores it comes last. Equal ids are different
rows: an anchor's copy may be its positive, and each copy of an anchor gets results of its own. Shorter
vectors are followed by zeros; components saturate at `vectors.largest` (2 ** 24 at 64 dimensions).
An anchor without another row of its label, and a positive without a row in its window, give no row. An
empty table gives an empty one. Other columns don't pass through, so none of them can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.common import materialize
from tidebars.llm.vectors import usable, whole_numbers

#: Rows of a block. With one anchor in a hundred a tile of these is about 82 x 8192 scores, 5 MB.
BLOCK_ROWS = 8192
#: Anchors that a tile takes at most; more of a block make more tiles.
TILE_ANCHORS = 256
#: Dimensions of a chunk.
CHUNK = 32
#: Groups of labels.
LABEL_GROUPS = 64

SHARD = "block long, chunk int, lo long, hi long, n int, rows binary, ids binary, labels binary, data binary"
ANCHORS = "part string, own long, chunk int, lo long, hi long, n int, rows binary, ids binary, labels binary, data binary"


def _ints(value: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _shards(kept: DataFrame, dims: int, offsets: Column, blocks: Column, chunk: int) -> DataFrame:
    """A row for each block of rows and chunk of dimensions: ids ascending (null ids last), components as int32."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])  # nulls go last
        data = whole_numbers(table["vector"].combine_chunks(), dims).astype(np.int32)
        labels = table["label"].to_numpy()
        ids = table["id"].combine_chunks()
        known = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), table["anchor"].to_numpy()]).astype(np.int64)
        out = []
        for k in range(0, dims, chunk):
            out.append({
                "block": table["block"][0].as_py(), "chunk": k // chunk, "lo": int(labels.min()), "hi": int(labels.max()), "n": len(labels),
                "rows": table["row"].to_numpy().tobytes(), "ids": known.tobytes(), "labels": labels.tobytes(), "data": np.ascontiguousarray(data[:, k : k + chunk]).tobytes(),
            })
        return pa.Table.from_pylist(out, shard_schema)

    shard_schema = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "labels", "data"))])
    placed = kept.withColumn("block", offsets + F.pmod("row", blocks))
    return placed.groupBy("block").applyInArrow(pack, SHARD)


def _anchors(shards: DataFrame, group: Column) -> DataFrame:
    """The anchors of the shards, by block and chunk, in parts of at most TILE_ANCHORS."""
    schema = pa.schema([("part", pa.string()), ("own", pa.int64()), ("chunk", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "labels", "data"))])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, labels = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["labels"], np.int64)
                known = np.frombuffer(r["ids"], np.int64).reshape(3, -1)
                data = np.frombuffer(r["data"], np.int32).reshape(r["n"], -1)
                chosen = np.flatnonzero(known[2])
                for a in range(0, len(chosen), TILE_ANCHORS):
                    at = chosen[a : a + TILE_ANCHORS]
                    own = {"part": f"{r['block']}-{a}", "own": r["block"], "chunk": r["chunk"], "lo": int(labels[at].min()), "hi": int(labels[at].max()), "n": len(at)}
                    yield pa.RecordBatch.from_pylist([own | {"rows": rows[at].tobytes(), "ids": known[0, at].tobytes(), "labels": labels[at].tobytes(), "data": np.ascontiguousarray(data[at]).tobytes()}], schema)

    return shards.mapInArrow(pick, ANCHORS).withColumn("group", group)


def _tiles(anchors: DataFrame, shards: DataFrame) -> DataFrame:
    """Partial tiles: anchors (with a column `to`, the block they go to) by rows, over one chunk of dimensions.

    The small side is multiplied and the large one moved once; what names the rows goes with the first chunk.
    """
    sides = anchors.select("part", "own", F.col("to").alias("block"), "chunk", F.col("data").alias("a"), F.col("n").alias("na"))
    met = sides.hint("merge").join(shards.select("block", "chunk", F.col("data").alias("b"), F.col("n").alias("nb")), ["block", "chunk"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, block, chunk, a, b, na, nb = batch.columns
            for k in range(batch.num_rows):
                left, right = (_ints(x[k], np.int32).reshape(n[k].as_py(), -1).astype(np.int64) for x, n in ((a, na), (b, nb)))
                tile = np.matmul(left, right.T).tobytes()
                yield pa.RecordBatch.from_arrays([part[k : k + 1], block[k : k + 1], pa.array([tile], pa.binary())], ["part", "block", "tile"])

    return met.select("part", "block", "chunk", "a", "b", "na", "nb").mapInArrow(multiply, "part string, block long, tile binary")


def _reduced(tiles: DataFrame, anchors: DataFrame, shards: DataFrame, best, schema: str) -> DataFrame:
    """best(anchor rows, anchor labels, window scores, scores, row names) of each tile, its partial tiles added.

    What names the anchors and rows of a tile joins its partial tiles as rows of the same group.
    """
    names = anchors.where("chunk = 0").select("part", F.col("to").alias("block"), "rows", "labels", "windows")
    sides = shards.where("chunk = 0").select("block", F.col("rows").alias("b_rows"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"))
    named = names.hint("merge").join(sides, "block")

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_pylist([], out_schema)
        if not left.num_rows or not right.num_rows:
            return empty
        r = right.to_pylist()[0]
        rows, labels = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["labels"], np.int64)
        total = sum(np.frombuffer(t.as_buffer(), np.int64) for t in left["tile"]).reshape(len(rows), -1)
        known = np.frombuffer(r["b_ids"], np.int64).reshape(3, -1)
        found = best(rows, labels, r["windows"], total, np.frombuffer(r["b_rows"], np.int64), known[0], known[1].astype(bool), np.frombuffer(r["b_labels"], np.int64))
        return pa.Table.from_arrays([pa.array(x, f.type, mask=m) for (x, m), f in zip(found, out_schema)], schema=out_schema)

    kinds = {"int": pa.int32(), "long": pa.int64()}
    out_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return tiles.groupBy("part", "block").cogroup(named.groupBy("part", "block")).applyInArrow(add, schema)


def _first(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n first columns of each row by score, ties to the lower column; None where there are fewer."""
    n = min(n, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    row, column = np.nonzero((scores >= cut[:, None]) & (scores > LEAST))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], column[place < n]


LEAST = np.iinfo(np.int64).min


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100, chunk: int = CHUNK, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition over df; label_col: whole numbers. For each anchor its first `positives` other rows of its label
    by inner product, ties to smaller ids, and for each of these the first `negatives` rows of other labels whose score
    lies from lower / 100 to upper / 100 of the positive's.
    """
    kept = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor")
    ).where(F.col("label").isNotNull() & usable("vector"))
    kept = kept.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))
    counts = {r["group"]: (r["n"], r["longest"]) for r in kept.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("longest")).collect()}
    dims = max([1, *(longest for _, longest in counts.values())])
    blocks = [-(-counts.get(g, (0, 0))[0] // block_rows) for g in range(LABEL_GROUPS)]
    starts = np.concatenate([[0], np.cumsum(blocks)]).tolist()

    def by_group(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("group"))

    # rows are numbered as they are read, once and for all, since blocks are written by these numbers
    numbered = kept.withColumn("row", F.monotonically_increasing_id())
    shards = materialize(_shards(numbered, dims, by_group(starts[:-1]), F.greatest(F.lit(1).cast("long"), by_group(blocks)), chunk), "shards")
    of_block = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts[1:]]), lambda s: s <= F.col("own"))).cast("int")
    anchors = materialize(_anchors(shards, of_block), "anchors")

    def same(rows, labels, _, scores, b_rows, b_ids, b_null, b_labels):
        fits = (labels[:, None] == b_labels) & (rows[:, None] != b_rows)
        row, column = _first(np.where(fits, scores, LEAST), positives)
        return [(rows[row], None), (b_ids[column], b_null[column]), (scores[row, column], None)]

    near = anchors.withColumn("windows", F.lit(None).cast("binary")).withColumn("to", F.explode(F.sequence(by_group(starts[:-1]), by_group(starts[1:]) - 1)))
    found = _reduced(_tiles(near, shards), near, shards, same, "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    best = materialize(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    # each anchor's windows go with its block: (anchors, positives) scores, missing ones empty
    windows = best.groupBy("row").agg(F.array_agg(F.struct("place", "positive_score")).alias("scores"))
    windows = _windows(anchors, windows, positives)
    far = anchors.join(windows.hint("merge"), "part").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, starts[-1] - 1)).cast("long"))))
    only = shards.where("chunk = 0 and lo = hi").select(F.col("block").alias("to"), F.col("lo").alias("only"))
    far = far.join(only.hint("merge"), (far["to"] == only["to"]) & (far["lo"] == only["only"]) & (far["hi"] == only["only"]), "left_anti")

    def other(rows, labels, held, scores, b_rows, b_ids, b_null, b_labels):
        bars = np.frombuffer(held, np.int64).reshape(len(rows), positives)
        top = bars.max(axis=1)
        low = np.where(bars > LEAST, bars, np.iinfo(np.int64).max).min(axis=1)
        row, column = np.nonzero((labels[:, None] != b_labels) & (scores >= 0) & (100 * scores <= upper * top[:, None]) & (100 * scores >= lower * low[:, None]))
        order = np.lexsort((column, -scores[row, column], row))
        row, column = row[order], column[order]
        value, ends = scores[row, column], np.searchsorted(row, np.arange(len(rows) + 1))
        out = [[], [], []]
        for k in range(len(rows)):
            own = value[ends[k] : ends[k + 1]]
            at = np.searchsorted(-100 * own, -upper * np.maximum(bars[k], 0))[:, None] + np.arange(negatives)
            fits = (at < len(own)) & (bars[k] >= 0)[:, None]
            fits[fits] = 100 * own[at[fits]] >= np.broadcast_to(lower * np.maximum(bars[k], 0)[:, None], at.shape)[fits]
            place, _ = np.nonzero(fits)
            out[0].append(np.full(len(place), rows[k])), out[1].append(place + 1), out[2].append(ends[k] + at[fits])
        row, place, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        return [(row, None), (place, None), (b_ids[column[at]], b_null[column[at]]), (value[at], None)]

    hard = _reduced(_tiles(far, shards), far, shards, other, "row long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = anchors.where("chunk = 0").mapInArrow(_names, "row long, anchor_id long")
    out = hard.join(best, ["row", "place"]).join(ids, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row and id of each anchor."""
    for batch in batches:
        for rows, ids in zip(batch["rows"], batch["ids"]):
            yield pa.RecordBatch.from_arrays([pa.array(_ints(rows)), pa.array(_ints(ids))], ["row", "anchor_id"])


def _windows(anchors: DataFrame, scores: DataFrame, positives: int) -> DataFrame:
    """part and windows: the positives' scores of each anchor of a part, as int64 of (anchor, place)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch["part"], batch["rows"]):
                own = _ints(rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(own)), pa.array(own), pa.array(np.arange(len(own), dtype=np.int32))], ["part", "row", "at"])

    def gathered(table: pa.Table) -> pa.Table:
        bars = np.full((table.num_rows, positives), LEAST)
        for r in table.to_pylist():
            for s in r["scores"] or ():
                bars[r["at"], s["place"] - 1] = s["positive_score"]
        return pa.table({"part": [table["part"][0].as_py()], "windows": pa.array([bars.tobytes()], pa.binary())})

    places = anchors.where("chunk = 0").mapInArrow(listed, "part string, row long, at int")
    return places.join(scores, "row", "left").groupBy("part").applyInArrow(gathered, "part string, windows binary")
