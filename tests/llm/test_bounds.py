"""What bounds a sample, a part of a benchmark and a search, and columns whose names clash."""

import numpy as np
from pyspark.sql import functions as F

from tidebars.llm import decontaminate, lines, ordinal, packing, passages


def test_a_repeated_id_counts_once(spark, monkeypatch):
    rows = [(1, f"text {k} of one id") for k in range(3000)] + [(k, f"another text {k}") for k in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)] + [(1, 0, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda feature, value, doc, grade: seen.append((int(doc.max()) + 1, grade.tolist())) or "model")
    assert ordinal.train(docs, labels, ordinal.ratings(), most=8) == "model"
    ordinal.train(docs.repartition(7), labels, ordinal.ratings(), most=8)
    assert seen[0][0] == 8 and seen[0] == seen[1]
    ordinal.train(docs, labels, ordinal.ratings(), most=5)
    assert seen[2][0] == 5


def test_a_benchmark_is_parted_by_its_characters(spark, monkeypatch):
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    items = [(f"i{k}", " ".join(word() for _ in range(40))) for k in range(12)]
    docs = spark.createDataFrame([(k, f"{word()} {t} {word()}") for k, (_, t) in enumerate(items)] + [(99, "clean " * 50), (100, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(tuple, decontaminate.find(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "CHARS_AT_ONCE", 700)
    assert decontaminate._part_count(benchmark, "text", 20_000) == -(-sum(len(t) for _, t in items) // 700)
    assert sorted(map(tuple, decontaminate.find(docs, benchmark).collect())) == whole and len(whole) == 12
    assert {x["doc_id"] for x in decontaminate.clean(docs, benchmark).collect()} == {99, 100}


def test_clashing_columns_and_many_spans_of_removal(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    mixed = " | ".join([passage.replace("w", f"v{k}x") for k in range(300)])
    docs = spark.createDataFrame([(1, f"a {passage} b", "x", "y"), (2, f"c {passage} d", "x", "y"), (3, mixed, "x", "y"), (4, mixed.replace("|", "/"), "x", "y"), (5, None, "x", "y")], "doc_id long, text string, removed string, `end` string")
    out = {r["doc_id"]: r for r in passages.remove(docs).collect()}
    assert passages.remove(docs).columns == ["doc_id", "text", "end", "removed"]
    assert out[1]["text"] == f"a {passage} b" and out[2]["text"].split() == ["c", "d"] and out[5]["text"] is None
    start, end = out[2]["removed"][0]
    assert f"c {passage} d"[start:end].split()[0] == "w0" and len(out[4]["text"]) < len(mixed) / 3
    line = " ".join(f"q{k}" for k in range(25))
    many = "\n".join([line, *(f"{line} {k}" for k in range(2000)), line])
    table = spark.createDataFrame([(1, many), (2, many), (3, "x\n\ny")], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in lines.remove(table).collect()}
    assert cut[1] == many.rsplit("\n", 1)[0] and cut[2] == "" and cut[3] == "x\n\ny"


def test_searches_without_end(spark):
    r = np.random.default_rng(2)
    lengths = [int(n) for n in r.integers(20, 60, 18)]
    table = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    count = lambda **kw: packing.pack(table, 100, **kw).select("sequence_id").distinct().count()
    exact = len(set(packing.fill(np.array(lengths), 100, None)[0].tolist()))
    assert count(nodes=None, group_pieces=None) == exact
    # a group's border costs no more than the sequences that the group would have been short of one another
    parted = packing.pack(table, 100, nodes=None, group_pieces=6)
    assert exact <= parted.select("sequence_id").distinct().count() <= exact + 3
    full = parted.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 100").count() == 0 and full.agg(F.sum("n")).first()[0] == sum(lengths)
