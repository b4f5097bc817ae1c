"""Cases of the review: where an operator did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from tidebars.llm import decontaminate, passages, quality, wrapper

# --- 3


def brute_short_leaks(rows, items, least=0.8):
    """Documents of fewer words than the item, each held against it as a whole."""
    index = decontaminate.Index.build(items)
    out = {}
    for d, text in rows:
        own = decontaminate.split_words(text)
        for n, item in enumerate(index.ids):
            width = min(5, index.sizes[n])
            if width <= len(own) < index.sizes[n]:
                grams = decontaminate.hash_runs(decontaminate.hash_words(own), width)
                same = decontaminate.similarity(grams, index.weights(grams, width), index.shingles[n], index.weights(index.shingles[n], width))
                if same >= least:
                    out[d, item] = len(own), round(same, 9)
    return out


def test_documents_shorter_than_the_item(spark):
    r = np.random.default_rng(8)
    items = [(k, " ".join(f"v{x}" for x in r.integers(0, 300, 50))) for k in range(6)] + [(9, None)]
    rows = [(10 * k + cut, " ".join(items[k][1].split()[: 50 - cut] if k % 2 else items[k][1].split()[cut:])) for k in range(6) for cut in range(1, 10)] + [(99, "v1 v2"), (100, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_short_leaks(rows, items)
    found = decontaminate.find(table, benchmark).collect()
    assert {(x["doc_id"], x["item_id"]): (x["n_words"], round(x["similarity"], 9)) for x in found} == want and (13, 1) in want
    assert len(want) == 54 == len(found)
    assert {x["doc_id"] for x in decontaminate.clean(table, benchmark).collect()} == {99, 100}


def plain_leaks(rows, items, least=0.8):
    """Every window of the item's size against every item, with words, Counters and logarithms alone."""
    from collections import Counter
    from math import log

    split = lambda t: [w.encode().lower() for w in (t or "").split()]
    grams = lambda ws: Counter(tuple(ws[k : k + min(5, len(ws))]) for k in range(max(1, len(ws) - 4)))
    own = {i: split(t) for i, t in items if split(t)}
    spread = Counter(g for ws in own.values() for g in set(grams(ws)))
    weight = lambda g: 1 + log((1 + len(own)) / (1 + spread[g]))
    out = set()
    for d, text in rows:
        ws = split(text)
        for i, item in own.items():
            want, size = grams(item), min(len(item), len(ws))
            for s in range(len(ws) - size + 1) if size >= min(5, len(item)) else ():
                got = grams(ws[s : s + size])
                both, either = sum(weight(g) * n for g, n in (got & want).items()), sum(weight(g) * n for g, n in (got | want).items())
                if both >= least * either:
                    out.add((d, i))
    return out


def test_leaks_against_plain_counters_in_parts_and_with_any_item_ids(spark):
    r = np.random.default_rng(11)
    items = [(k, " ".join(f"v{x}" for x in r.integers(0, 400, int(r.integers(6, 60))))) for k in range(30)]
    items += [(40 + k, " ".join(items[0][1].split()[: 5 + k])) for k in range(3)]
    rows = []
    for k in range(90):
        text, item = [f"v{x}" for x in r.integers(0, 400, int(r.integers(10, 150)))], items[k % 30][1].split()
        for at in r.integers(0, len(item), k % 4):
            item[at] = "changed"
        text[len(text) // 3 : len(text) // 3] = item
        rows.append((k, " ".join(text)))
    table, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plain_leaks(rows, items)
    assert len(want) > 30
    for kind in ("int", "string", "long"):
        benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
        for most in (7, 20_000):
            found = decontaminate.find(table, benchmark, most_items=most)
            assert found.schema["item_id"].dataType.simpleString() == benchmark.schema["item_id"].dataType.simpleString()
            assert {(x["doc_id"], int(x["item_id"])) for x in found.collect()} == want
        assert {x["doc_id"] for x in decontaminate.clean(table, benchmark, most_items=7).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_windows_at_the_threshold_lie_within_the_radius():
    r = np.random.default_rng(12)
    apart = []
    for _ in range(300):
        both, mine, yours = (r.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))  # similarity 0.8
        x, y = (decontaminate.fingerprints(np.concatenate([both, own]), np.ones(450), np.zeros(1, np.int64), 450)[0] for own in (mine, yours))
        apart.append(int(np.bitwise_count(x ^ y).sum()))
    assert max(apart) <= decontaminate.RADIUS and 35 < np.mean(apart) < 43


# --- 4


def test_template_of_a_host_with_empty_and_cut_pages(spark):
    page = "<html><body><div><p>Follow us everywhere</p><div><p>story {0} begins</p><p>and ends {0}</p></div><p>All rights</p></div></body></html>"
    rows = [(k, f"http://h/{k}", page.format(k)) for k in range(12)] + [(12, "http://h/n", None)]
    rows += [(100 + k, f"http://g/{k}", page.format(k)) for k in range(12)] + [(120, "http://g/c", page.format(20)[:50])]
    found = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[a + k] == f"story {k} begins\nand ends {k}" for a in (0, 100) for k in range(12)) and found[12] == ""


# --- 5


def brute_passages(rows, size):
    """(id, first word) of every word that goes, by the definition: all windows against all earlier ones."""
    split = {i: t.lower().split() for i, t in rows if t}
    gone = {}
    for i, own in split.items():
        gone[i] = set()
        for p in range(len(own) - size + 1):
            window = own[p : p + size]
            other = any(j < i and any(x[q : q + size] == window for q in range(len(x) - size + 1)) for j, x in split.items())
            first = next(q for q in range(p + 1) if own[q : q + size] == window)
            if other or first + size <= p:
                gone[i] |= set(range(p, p + size))
    return gone


def test_passages_across_line_breaks(spark):
    r = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    shared, inside = word(60), word(55)
    rows = [(1, " ".join([*word(20), *shared, *word(10)])), (2, "\n".join(x.upper() for x in shared) + "\n" + " ".join(word(30))), (3, " ".join([*word(5), *shared[5:57], *word(9), *inside, *word(3)]))]
    rows += [(4, "\n\n".join([" ".join(inside[:8]), *inside[8:]])), (5, " ".join(["a b c"] * 60)), (6, " ".join(shared[:49])), (7, None), (8, ""), (9, rows[0][1])]
    table = spark.createDataFrame([*rows, (9, rows[0][1]), (None, rows[0][1])], "doc_id long, text string").repartition(3)
    want = brute_passages(rows, 50)
    got = {i: set() for i in want}
    for x in passages.repeats(table).collect():
        got[x["doc_id"]] |= set(range(x["first_word"], x["first_word"] + x["n_words"]))
        text = dict(rows)[x["doc_id"]]
        assert text[x["start"] : x["end"]].split() == text.split()[x["first_word"] : x["first_word"] + x["n_words"]]
    assert got == want and all(len(got[i]) >= 52 for i in (2, 3, 4, 5, 9)) and not got[1] and not got[6]
    clean = {x["doc_id"]: x["text"] for x in passages.remove(table).collect() if x["doc_id"] is not None}
    assert all(clean[i].split() == [w for k, w in enumerate((t or "").split()) if k not in want[i]] for i, t in rows if t) and clean[7] is None
    assert passages.remove(table).count() == len(rows) + 2 and passages.repeats(table.where("false")).count() == 0


# --- 6


def test_all_trusted_documents_count(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    counts = quality.count(docs, quality.trusted_ids(docs, F.lit(True))).toPandas()
    assert counts["trusted"].sum() == counts["corpus"].sum() == 21_000
