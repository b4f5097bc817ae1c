"""A fitted model over a stream: rolling features and filtered states of each symbol, kept as state between micro-batches.

Rows wait, by bin, until the watermark has passed their bin, so that they are taken in time order however
they come; a timer at the end of each bin then runs them through the model. What is held of a symbol is
the waiting rows, the last prices that the features look back on, and the state probabilities. Rows that
come after the watermark are left out, and a symbol that is silent for `silence` starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.plans.hidden import States

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, ts timestamp, id long, price double, mean double, chance double"


def step(model: States, chance: np.ndarray | None, price: float) -> np.ndarray:
    """The probabilities of the states after one more price, given those before it (None: there was none)."""
    before = model.start if chance is None else chance @ model.moves
    log_b = model.log_densities(np.array([[price]]))[0]
    after = before * np.exp(log_b - log_b.max())
    return after / max(after.sum(), 1e-300)


class Live(StatefulProcessor):
    def __init__(self, model: States, look: int, bin_ms: int, silence_ms: int):
        self.model, self.look, self.bin_ms, self.silence_ms = model, look, bin_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by the end of the bin, so that a timer reads its own rows alone
        self.waiting = handle.getMapState("waiting", "end long", "ms array<long>, id array<long>, price array<double>")
        self.recent = handle.getValueState("recent", "ms long, prices array<double>, chance array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            ms = (frame["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[frame["ts"].dt.unit]).to_numpy()
            ends = ms // self.bin_ms * self.bin_ms + self.bin_ms
            for end in np.unique(ends[ends > watermark]).tolist():
                own = ends == end
                new = [ms[own].tolist(), frame["id"].to_numpy()[own].tolist(), frame["price"].to_numpy()[own].tolist()]
                if self.waiting.containsKey((end,)):
                    new = [list(old) + more for old, more in zip(self.waiting.getValue((end,)), new)]
                else:
                    self.handle.registerTimer(end)
                self.waiting.updateValue((end,), tuple(new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(zip(*self.waiting.getValue((end,))))
        self.waiting.removeKey((end,))
        held = self.recent.get() if self.recent.exists() else None
        last, prices, chance = (held[0], list(held[1]), np.array(held[2])) if held else (None, [], None)
        out = []
        for ms, i, price in due:
            if last is not None and ms - last > self.silence_ms:
                prices, chance = [], None
            prices = [*prices, price][-self.look :]
            chance, last = step(self.model, chance, price), ms
            out.append((key[0], pd.Timestamp(ms, unit="ms", tz="UTC"), i, price, sum(prices) / len(prices), float(chance[-1])))
        self.recent.update((last, prices, chance.tolist()))
        yield pd.DataFrame(out, columns=["symbol", "ts", "id", "price", "mean", "chance"])

    def close(self) -> None:
        pass


def live_states(ticks: DataFrame, model: States, look: int = 20, bin_seconds: int = 3600, late: str = "10 minutes", silence_seconds: int = 86_400) -> DataFrame:
    """symbol, ts (milliseconds), id, price, mean (of the last `look` prices) and chance of the model's last state, of each tick whose bin the watermark has passed.

    ticks: symbol, ts, id, price. The session's state store must be RocksDB's: see `store`.
    """
    timed = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "id", F.col("price").cast("double").alias("price")).withWatermark("ts", late)
    processor = Live(model, look, bin_seconds * 1000, silence_seconds * 1000)
    return timed.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")


class store:
    """Within it, streams of the session start with the state store that timers and lists need; afterwards the setting is as before."""

    def __init__(self, spark):
        self.conf, self.key = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.was = self.conf.get(self.key, None)
        self.conf.set(self.key, ROCKS)

    def __exit__(self, *_):
        self.conf.unset(self.key) if self.was is None else self.conf.set(self.key, self.was)
