"""Codebooks and hard negatives against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import negatives, quantize, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, block string, row string"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    """Two thirds of one label, copies, equal ids, and rows that take no part."""
    r = np.random.default_rng(5)
    base = [[float(np.float32(x)) for x in r.normal(0, 0.2, 8)] for _ in range(40)]
    out = [(k, base[int(r.integers(0, 40))] if k % 3 else [float(np.float32(x)) for x in r.normal(0, 0.2, 8)], int(r.integers(0, 4)) if k % 3 == 0 else 1) for k in range(0, 330)]
    out += [(100, base[3], 2), (100, base[3], 2), (200, base[4], 1), (None, base[5], 1), (None, base[6], None), (7, base[7], None), (-100, [0.0] * 8, 3), (-200, [1.0, 2.0], 0), (-300, [], 2)]
    return out + [(400, None, 1), (500, [None] + [0.1] * 7, 1), (600, [NAN] * 8, 1), (-700, [INF] * 8, 1), (-900, [1e30] + [0.0] * 7, 5), (-901, [-1e30] + [0.0] * 7, 5)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(5)


def plain_rows(rows, dims):
    most = vectors.largest(dims)
    for i, v, label in rows:
        if v is not None and all(x is not None and abs(x) < INF for x in v):
            yield i, [max(-most, min(most, floor(max(-most, min(most, x)) * 256))) for x in v] + [0] * (dims - len(v)), label


def plain_codes(rows, parts, entries, rounds):
    kept = list(plain_rows(rows, 8))
    width = 8 // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)
    # equal ids: the lesser vector as given; no such pair stands at the border here
    books = [[cut(v)[p] for _, v in first[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((far(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        found = [near(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), n in zip(kept, found) if n[p][1] == e]
                new = [sum(x) // len(own) for x in zip(*own)] if own else books[p][e]
                books[p] = [*books[p][:e], new, *books[p][e + 1 :]]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), label) for (i, _, label), n in ((k, near(k[1])) for k in kept)]
    return sorted(((i, c, d, sum(x[2] for x in out if x[3] == label), sha) for i, c, d, label in out), key=str)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 2), (2, 64, 3), (8, 256, 1), (1, 3, 0)])
def test_codes(table, rows, parts, entries, rounds):
    got = quantize.compress(table, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, parts, entries, rounds)


def test_decoded_codes_are_as_far_as_the_error_says(table):
    books = quantize.train(table, parts=4, entries=32)
    found = quantize.encode(table, books).where("vec_id between 0 and 99").collect()
    given = {r["vec_id"]: r["embedding"] for r in table.where("vec_id between 0 and 99").collect() if r["vec_id"] != 7}
    for r in found:
        if r["vec_id"] != 7:
            far = np.floor(np.array(given[r["vec_id"]], float) * 256) - books.decode([r["code"]])[0]
            assert (far**2).sum() == r["error"]


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (none, spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA)):
        assert quantize.compress(df).collect() == []
        assert negatives.mine(df, F.col("vec_id") % 100 == 0).collect() == []


def plain_negatives(rows, positives=5, count=5):
    kept = [(n, i, v, label) for n, (i, v, label) in enumerate(plain_rows(rows, 8)) if label is not None]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, i, v, label in kept:
        if i is None or i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, m) for k, j, w, m in kept if k != n]
        for p in sorted((s for s in scores if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scores if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)[:count]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows, chunk", [(8192, 32), (16, 3), (50, 8)])
def test_hard_negatives(table, rows, block_rows, chunk):
    found = negatives.mine(table, F.col("vec_id") % 100 == 0, block_rows=block_rows, chunk=chunk)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == plain_negatives(rows) and len(got) > 20


def test_parts_of_a_block_full_of_anchors(table, rows, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0, positives=2, negatives=3, block_rows=60)
    few = {(a, p, r) for a, p, r, *_ in plain_negatives([(i, v, m) if i is None or i % 10 == 0 or i % 100 else (i, v, m) for i, v, m in rows], 2, 3)}
    found = {(r["anchor_id"], r["positive_id"], r["rank"]) for r in got.collect() if r["anchor_id"] % 100 == 0}
    assert found == few and got.where("anchor_id % 100 <> 0").count() > 0
