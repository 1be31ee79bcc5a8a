"""Kernels and event algebra over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.kernels import Kernel


@contextmanager
def stateful(spark: SparkSession):
    """The state store that kernels need, for queries started within; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream(df: DataFrame, key: str, order: Sequence[str], kernel: Kernel, keep: Sequence[str]) -> DataFrame:
    """Runs the kernel over a streaming DataFrame, with the kernel's state as pickled value state for each key.

    A micro-batch gives no order, so its rows of a key are sorted by the columns of order before they are stepped; the source's
    limits on a micro-batch (maxFilesPerTrigger and the like) bound what is held at once. Rows that come in a later micro-batch
    than rows of a later time are stepped late, as they arrive; `in_order` waits for them instead. Across micro-batches the
    state is the same that the batch runner carries, so a stream fed in order has the batch's result.
    """
    import pickle

    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    keep = list(dict.fromkeys([key, *keep]))
    used = list(dict.fromkeys([*keep, *order, *kernel.reads]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), kernel.returns])
    names = [x.split()[0] for x in kernel.returns.split(", ")]

    class Runner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "data binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            whole = pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")
            state = pickle.loads(self.state.get()[0]) if self.state.exists() else kernel.init()
            found, values = kernel.step(state, {c: whole[c].to_numpy() for c in kernel.reads})
            self.state.update((pickle.dumps(state),))
            out = whole[keep].iloc[found].reset_index(drop=True)
            for c in names:
                out[c] = pd.Series(values[c], dtype=object if not values[c] else None)
            yield out

        def close(self) -> None:
            pass

    return df.select(*used).where(f"`{key}` is not null").groupBy(key).transformWithStateInPandas(Runner(), outputStructType=schema, outputMode="append", timeMode="none")


def in_order(df: DataFrame, key: str, time: str, order: Sequence[str], kernel: Kernel, keep: Sequence[str], lateness: str) -> DataFrame:
    """Like `stream`, but rows wait in state until the watermark (the latest time seen less the lateness) has passed them, and
    are stepped in order then: rows that are out of order by less than the lateness give the batch's result. Later ones are
    dropped, as the watermark says they may be. time is a timestamp column; the state holds what came within the lateness.
    """
    import pickle

    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    keep = list(dict.fromkeys([key, *keep]))
    used = list(dict.fromkeys([*keep, time, *order, *kernel.reads]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), kernel.returns])
    names = [x.split()[0] for x in kernel.returns.split(", ")]

    class Runner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("state", "data binary")

        def _load(self) -> tuple:
            return pickle.loads(self.state.get()[0]) if self.state.exists() else (kernel.init(), None)

        def _step(self, state, held: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame]:
            at = held[time].astype("datetime64[ms]").astype("int64")
            now, later = held[at <= until].sort_values(list(order), kind="stable"), held[at > until]
            found, values = kernel.step(state, {c: now[c].to_numpy() for c in kernel.reads})
            out = now[keep].iloc[found].reset_index(drop=True)
            for c in names:
                out[c] = pd.Series(values[c], dtype=object if not values[c] else None)
            return out, later

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state, held = self._load()
            mark = timerValues.getCurrentWatermarkInMs()
            new = pd.concat(list(rows), ignore_index=True)
            if mark > 0:  # there is no watermark before the second micro-batch
                new = new[new[time].astype("datetime64[ms]").astype("int64") > mark]
            held = new if held is None or not len(held) else pd.concat([held, new], ignore_index=True)
            self.state.update((pickle.dumps((state, held)),))
            if len(held):
                self.handle.registerTimer(int(held[time].astype("datetime64[ms]").astype("int64").max()))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            state, held = self._load()
            if held is None or not len(held):
                return
            out, later = self._step(state, held, timerValues.getCurrentWatermarkInMs())
            self.state.update((pickle.dumps((state, later)),))
            yield out

        def close(self) -> None:
            pass

    return df.select(*used).where(f"`{key}` is not null").withWatermark(time, lateness).groupBy(key).transformWithStateInPandas(Runner(), outputStructType=schema, outputMode="append", timeMode="eventtime")


def tumbling_rate(spikes: DataFrame, time: str, width: str, lateness: str, by: Sequence[str], n_spikes: str = "n_spikes") -> DataFrame:
    """Firing rates in event-time windows, closed once the watermark has passed; time is a timestamp column."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    windows = spikes.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), *by).agg(F.sum(n_spikes).alias("n_spikes"))
    return windows.select(*by, F.col("w.start").alias("bin_start"), "n_spikes", (F.col("n_spikes") / seconds).alias("rate"))
