"""Shared helpers: table reading, durable cuts of lineage, slices of Arrow batches, groups of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker turns into its own objects at once. Spark bounds the bytes of an Arrow batch itself.
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Read the named columns of a table through Spark only (any file system), so extra columns never clash."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE_ROWS) -> Iterator[pd.DataFrame]:
    """The batches in runs of at most so many rows; an empty batch stays one."""
    for batch in batches:
        for k in range(0, max(len(batch), 1), rows):
            yield batch.iloc[k : k + rows].reset_index(drop=True)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by the keys, cut only where a key changes: each frame holds whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for key in keys:
            x = batch[key].to_numpy()
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= x[0] != held[-1][key].iloc[-1]
        last = np.flatnonzero(change)
        if len(last):
            done = [*held, batch.iloc[: last[-1]]]
            held = [batch.iloc[last[-1] :]]
            if sum(map(len, done)):
                yield pd.concat(done, ignore_index=True)
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """First rows of the groups of a sorted frame."""
    change = np.zeros(len(frame), bool)
    change[:1] = True
    for key in keys:
        x = frame[key].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows u < v within groups of these sizes that follow each other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    row = np.arange(len(ends))
    after = ends - row - 1
    u = np.repeat(row, after)
    return u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(after) - after, after)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session on one machine may go without: it gets a local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/rivulet-checkpoints"


def durable(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors.

    replaces: an earlier cut that nothing but df reads, deleted once df is written. What is left goes when the driver ends.
    Spark removes a shuffle's files once its plan is garbage; the plan that made df is, so the driver collects garbage here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    if replaces is not None:
        old = jvm.org.apache.hadoop.fs.Path(replaces._cut)
        old.getFileSystem(conf).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    jvm.System.gc()
    return out


def text_id(column: str = "doc_id") -> Column:
    """An id as text: pandas would turn longs beside nulls into doubles, which lose digits."""
    return F.col(column).cast("string").alias(column)


def long_id(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("long"))
