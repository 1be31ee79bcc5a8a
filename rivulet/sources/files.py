"""Files of packets and vectors, record writers, and packets as a streaming source."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rivulet.operators.packets import HEADER, START


def record_size(nchannels: int) -> int:
    return 4 * (HEADER + 1 + nchannels)


def read_packets(spark: SparkSession, path: str, nchannels: int) -> DataFrame:
    """path, arrival and words of every record of raw packet files. Files with exchanged bytes are put right; a file that is
    not a whole number of records fails."""
    size = record_size(nchannels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % size:
                    raise ValueError(f"{path} is not a whole number of records")
                words = np.frombuffer(content, "<u4").reshape(-1, size // 4)
                if len(words) and words[0, 0] not in (START, 8):
                    raise ValueError(f"{path} has an unknown byte order")
                if len(words) and words[0, 0] == 8:  # the start word with the bytes of its halves exchanged
                    words = words.view("<u2").byteswap().view("<u4")
                for k in range(0, len(words), 4096):
                    part = words[k : k + 4096]
                    yield pd.DataFrame({"path": path, "arrival": np.arange(k, k + len(part)), "words": list(part.astype("<u4").view("<i4"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, arrival long, words array<int>")


def cycled(packets: DataFrame, times: int) -> DataFrame:
    """The packets of each file (path, arrival, words) so many times in a row, arrival going on."""
    counts = packets.groupBy("path").agg((F.max("arrival") + 1).alias("_n"))
    again = packets.join(counts, "path").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.withColumn("arrival", F.col("arrival") + F.col("_k") * F.col("_n")).drop("_n", "_k")


def write_packets(words: DataFrame, path: str, order: str = "arrival") -> None:
    """Raw packet files: each row's words as a record of little-endian words, in order within and across files, as
    `read_packets` reads them. path is a folder that the driver and the executors share; it must not exist."""
    spark = words.sparkSession
    spark.dataSource.register(RawPackets)
    ordered = words.select(order, F.transform("words", lambda w: w.cast("int")).alias("words")).repartitionByRange(order).sortWithinPartitions(order)
    ordered.select(F.col(order).cast("long").alias("arrival"), "words").write.format("raw_packets").option("path", path).mode("append").save()


def replayed(packets: DataFrame, per_second: int, cycle: bool = False) -> DataFrame:
    """Stored packets as a streaming DataFrame, so many a second in order of arrival (0 to n - 1), over and over with cycle:
    the clock's ticks joined with the table. at is the time of the tick."""
    spark = packets.sparkSession
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("at"), F.col("value").alias("tick"))
    if cycle:
        n = packets.count()
        return ticks.withColumn("arrival", F.col("tick") % n).join(packets, "arrival").withColumn("arrival", F.col("tick")).drop("tick")
    return ticks.withColumnRenamed("tick", "arrival").join(packets, "arrival")


@dataclass
class Written(WriterCommitMessage):
    name: str


class RawWriter(DataSourceWriter):
    """Tasks write files under hidden names; the commit gives them their names, so that what failed leaves nothing to be read."""

    def __init__(self, path: str):
        self.path = path
        if os.path.exists(path):
            raise ValueError(f"{path} exists")
        os.makedirs(path)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.nrd"
        hidden = f"_{name}.{context.taskAttemptId()}"
        with open(os.path.join(self.path, hidden), "wb") as f:
            for row in iterator:
                f.write(np.asarray(row.words, "<i4").tobytes())
        return Written(hidden)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.rename(os.path.join(self.path, m.name), os.path.join(self.path, m.name[1:].rpartition(".")[0]))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(f := os.path.join(self.path, m.name)):
                os.remove(f)


class RawPackets(DataSource):
    """Sink of raw packet files."""

    @classmethod
    def name(cls) -> str:
        return "raw_packets"

    def schema(self) -> str:
        return "arrival long, words array<int>"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options["path"])


def read_vector(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """path, position and value of vectors in files: white-space separated text, or little-endian doubles."""
    if kind == "text":
        lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v"))
        return lines.select("path", F.posexplode("v").alias("position", "v")).where("v != ''").select("path", "position", F.col("v").cast("double").alias("value"))
    if kind != "binary":
        raise ValueError(f"unknown kind {kind}")

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                v = np.frombuffer(content, "<f8")
                yield pd.DataFrame({"path": p, "position": np.arange(len(v), dtype=np.int32), "value": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, position int, value double")


def write_vector(values: DataFrame, path: str, order: str = "position") -> None:
    """One line of text a value, in order within and across files."""
    values.repartitionByRange(order).sortWithinPartitions(order).select(F.col("value").cast("string").alias("value")).write.mode("errorifexists").text(path)


def serialize(df: DataFrame, path: str, by: str = "stream_id", form: str = "parquet", overwrite: bool = False) -> None:
    """One folder for each stream; refuses to overwrite unless told to. The schema stands in place of a preamble."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(by).format(form).save(path)


class UdpPart(InputPartition):
    def __init__(self, start: int, n: int, size: int, file: str | None, at: int, data: bytes):
        self.start, self.n, self.size, self.file, self.at, self.data = start, n, size, file, at, data


class UdpReader(DataSourceStreamReader):
    """Reads datagrams on the driver; those of the wrong size are counted, not kept.

    An offset is offered after at most `batch` packets or `wait` seconds, however fast packets come. With `spool`, a folder
    that the driver and the executors share, packets are written there before their offset is offered: executors read them from
    there, and a query that starts again finds those of an unfinished micro-batch. Without it they are in the driver's memory
    until they are committed, and a restart loses them. A micro-batch is dealt out in parts of `part` packets.
    """

    def __init__(self, options: dict):
        self.address, self.port = options.get("address", "127.0.0.1"), int(options.get("port", 5000))
        self.size, self.limit = record_size(int(options.get("nchannels", 128))), int(options.get("npackets", 0))
        self.batch, self.wait, self.part = int(options.get("batch", 32_000)), float(options.get("wait", 0.5)), int(options.get("part", 4_000))
        self.spool = options.get("spool")
        self.invalid, self.kept, self.socket = 0, {}, None
        if self.spool:
            os.makedirs(self.spool, exist_ok=True)
        self.seen = max([int(f.split("-")[1].split(".")[0]) for f in os.listdir(self.spool) if f.endswith(".bin")], default=0) if self.spool else 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        import select
        import socket
        import time

        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind((self.address, self.port))
        room = min(self.batch, self.limit - self.seen) if self.limit else self.batch
        until, got = time.monotonic() + self.wait, []
        while len(got) < room and (left := until - time.monotonic()) > 0 and select.select([self.socket], [], [], min(left, 0.05))[0]:
            data = self.socket.recv(1 << 16)
            if len(data) == self.size:
                got.append(data)
            else:
                self.invalid += 1
        if got:
            start, self.seen = self.seen, self.seen + len(got)
            if self.spool:
                name = os.path.join(self.spool, f"{start}-{self.seen}.bin")
                with open(f"{name}.new", "wb") as f:
                    f.write(b"".join(got))
                os.rename(f"{name}.new", name)
            else:
                self.kept[start] = b"".join(got)
        return {"n": self.seen}

    def _runs(self) -> list[tuple[int, int, str | None]]:
        """First and last packet (exclusive) of what is held, in order, and its file."""
        if not self.spool:
            return sorted((k, k + len(v) // self.size, None) for k, v in self.kept.items())
        names = [f for f in os.listdir(self.spool) if f.endswith(".bin")]
        return sorted((*map(int, f[:-4].split("-")), os.path.join(self.spool, f)) for f in names)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for a, z, file in self._runs():
            for k in range(max(a, start["n"]), min(z, end["n"]), self.part):
                n = min(k + self.part, z, end["n"]) - k
                at = (k - a) * self.size
                out.append(UdpPart(k, n, self.size, file, at, b"" if file else self.kept[a][at : at + n * self.size]))
        return out

    def commit(self, end: dict) -> None:
        for a, z, file in self._runs():
            if z <= end["n"] and file:
                os.remove(file)
            elif z <= end["n"]:
                del self.kept[a]

    def read(self, partition: UdpPart):
        data = partition.data
        if partition.file:
            with open(partition.file, "rb") as f:
                f.seek(partition.at)
                data = f.read(partition.n * partition.size)
        for k in range(partition.n):
            yield partition.start + k, data[k * partition.size : (k + 1) * partition.size]


class UdpPackets(DataSource):
    """Streaming source of raw packets: spark.dataSource.register(UdpPackets), then format("udp_packets")."""

    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return "arrival long, raw binary"

    def streamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)
