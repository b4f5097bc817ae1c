"""Live states from a stream against one walk over the whole table, over two runs with a restart between them."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tidebars.plans.hidden import States
from tidebars.streaming import bars as streams
from tidebars.streaming import live

MODEL = States(np.array([0.8, 0.2]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[10.0], [30.0]]), np.array([[25.0], [100.0]]))
AT = datetime.datetime(2024, 1, 1)


def walk(rows, look, silence):
    out, prices, chance, last = [], [], None, None
    for symbol, ts, i, price in sorted(rows, key=lambda r: (r[1], r[2])):
        if last is not None and (ts - last).total_seconds() > silence:
            prices, chance = [], None
        prices, last = [*prices, price][-look:], ts
        chance = live.step(MODEL, chance, price)
        out.append((symbol, ts, i, round(sum(prices) / len(prices), 9), round(float(chance[1]), 9)))
    return out


def test_a_stream_in_two_runs(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [("ab"[k % 2], AT + datetime.timedelta(minutes=int(7 * k + (3000 if k > 250 else 0)), milliseconds=int(r.integers(0, 999))), k, float(r.choice([10, 30]) + r.normal(0, 3))) for k in range(400)]
    kind = "symbol string, ts timestamp_ntz, id long, price double"
    first = [x for x in rows if x[1] < AT + datetime.timedelta(hours=20)]
    # rows of the first half come in any order; the second run also brings one that is far too late
    r.shuffle(first)
    spark.createDataFrame(first, kind).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    late = ("a", AT + datetime.timedelta(minutes=1), 9999, 1.0)

    def run():
        ticks = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        with live.store(spark):
            return streams.run_available(live.live_states(ticks, MODEL, look=5, silence_seconds=40_000), f"file://{tmp_path}/out", f"file://{tmp_path}/offsets")

    assert run().count() > 50
    spark.createDataFrame([x for x in rows if x[1] >= AT + datetime.timedelta(hours=20)] + [late], kind).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    found = run().withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
    closed = max(x[1] for x in rows) - datetime.timedelta(minutes=10)
    closed = closed.replace(minute=0, second=0, microsecond=0)
    want = sorted(x for s in "ab" for x in walk([y for y in rows if y[0] == s], 5, 40_000) if x[1] < closed)
    got = sorted((x["symbol"], x["ts"], x["id"], round(x["mean"], 9), round(x["chance"], 9)) for x in found)
    assert got == want
