"""Runs kernels over keyed streams of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rivulet.operators.kernels import Kernel


def run_segments(kernel: Kernel, states: dict, batch: pd.DataFrame, key: str, keep: Sequence[str], fresh: bool) -> pd.DataFrame:
    """Steps the kernel over each run of one key in the batch. fresh: a key that ends is forgotten, as sorted input never
    comes back to it."""
    keys = batch[key].to_numpy()
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = [0, *change.tolist()] if len(keys) else []
    columns = {c: batch[c].to_numpy() for c in kernel.reads}
    names = [x.split()[0] for x in kernel.returns.split(", ")]
    rows: list[int] = []
    out: dict[str, list] = {c: [] for c in names}
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        if fresh and keys[a] not in states:
            states.clear()
        if keys[a] not in states:
            states[keys[a]] = kernel.init()
        found, values = kernel.step(states[keys[a]], {c: v[a:b] for c, v in columns.items()})
        rows += [a + k for k in found]
        for c in names:
            out[c] += values[c]
    result = batch[list(keep)].iloc[rows].reset_index(drop=True)
    for c in names:
        result[c] = pd.Series(out[c], dtype=object if not out[c] else None)
    return result


def batch(df: DataFrame, key: str, order: Sequence[str], kernel: Kernel, keep: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Runs the kernel over each key's rows in order. keep: columns that go with each output row.

    One shuffle by key and one sort; rows then pass through in Arrow batches, and the state is carried over their ends, so memory
    does not grow with a stream. Only the columns used are shuffled. A stream is one task's work: its steps depend on
    each other. key must not be null.
    """
    keep = list(dict.fromkeys([key, *keep]))
    used = list(dict.fromkeys([*keep, *order, *kernel.reads]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), kernel.returns])
    dealt = df.select(*used).where(f"`{key}` is not null")
    dealt = (dealt.repartition(partitions, key) if partitions else dealt.repartition(key)).sortWithinPartitions(key, *order)

    def run(batches):
        states: dict = {}
        for b in batches:
            yield run_segments(kernel, states, b, key, keep, fresh=True)

    return dealt.mapInPandas(run, schema)
