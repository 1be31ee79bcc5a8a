"""Operators on sampled signals that native expressions can state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.signal import gather


def distribute(samples: DataFrame, ports: Mapping[str, Sequence[int]], nchannels: int) -> dict[str, DataFrame]:
    """One stream for each port, with the channels named for it; ports in order of name. Channels are checked while planning."""
    for port, channels in ports.items():
        if not channels or not all(0 <= c < nchannels for c in channels):
            raise ValueError(f"port {port} names no channels or channels out of range")
    return {p: samples.withColumn("values", gather(F.col("values"), ports[p])) for p in sorted(ports)}


def distribute_long(samples: DataFrame, ports: Mapping[str, Sequence[int]]) -> DataFrame:
    """All ports in one pass over the table: the sample's columns, then port, position and value."""
    made = F.array(*[F.struct(F.lit(p).alias("port"), F.lit(k).alias("position"), F.get("values", c).alias("value")) for p in sorted(ports) for k, c in enumerate(ports[p])])
    kept = [c for c in samples.columns if c != "values"]
    return samples.select(*kept, F.explode(made).alias("_x")).select(*kept, "_x.*")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], chunk: int | None = None, name: str = "_seq") -> DataFrame:
    """Adds each row's number in its stream, from 0 on. by must not be null.

    chunk: length of a chunk of the first column of the order (of time, say). Rows are then ranked within chunks, and the
    chunks' counts are summed before, so one long stream is as many tasks as it has chunks; without, a stream is one task.
    """
    if chunk is None:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    cut = rows.withColumn("_chunk", F.floor(F.col(order[0]) / chunk))
    counts = cut.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_chunk", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)) - 1
    kept = rows.columns
    return cut.withColumn("_rank", rank).join(counts, [*by, "_chunk"]).select(*kept, (F.col("_before") + F.col("_rank")).cast("long").alias(name))


def with_halo(rows: DataFrame, seq: str, block: int, halo: int) -> DataFrame:
    """Rows by blocks of `block` numbers (_block), each with the `halo` rows before it (_own is false for those)."""
    if halo > block:
        raise ValueError("a block must be as long as what it looks back on")
    own = F.expr(f"{seq} div {block}")
    last = F.when(F.col(seq) % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(last)).withColumn("_own", F.col("_block") == own)


def rebuffer(samples: DataFrame, by: Sequence[str], order: Sequence[str], factor: int = 1, size: int = 1, keep_partial: bool = False, seconds: float | None = None, rate: float | None = None, chunk: int | None = None) -> DataFrame:
    """Every factor-th sample from the first on, packed by `size`: by, buffer, n, hw_ts (of the first sample), values.

    seconds: length of a buffer instead of its size, which then follows from the sample rate. chunk: as of `numbered`.
    """
    if seconds is not None:
        if not rate or rate <= 0:
            raise ValueError("a buffer in seconds needs the sample rate")
        size = buffer_size(seconds, rate, factor)
    if factor < 1 or size < 1:
        raise ValueError("factor and size must be 1 or more")
    kept = numbered(samples, by, order, chunk).where(F.col("_seq") % factor == 0).withColumn("_out", F.expr(f"_seq div {factor}"))
    packed = kept.groupBy(*by, F.expr(f"_out div {size}").alias("buffer")).agg(F.array_sort(F.collect_list(F.struct("_out", "hw_ts", "value"))).alias("_s"))
    packed = packed.select(*by, "buffer", F.size("_s").cast("long").alias("n"), F.get("_s", 0)["hw_ts"].alias("hw_ts"), F.transform("_s", lambda x: x["value"]).alias("values"))
    return packed if keep_partial else packed.where(F.col("n") == size)


def rebuffer_rows(samples: DataFrame, by: Sequence[str], order: Sequence[str], factor: int, size: int, chunk: int | None = None) -> DataFrame:
    """Every factor-th sample from the first on, as rows with all their columns, without those of a last partial buffer."""
    if factor < 1 or size < 1:
        raise ValueError("factor and size must be 1 or more")
    kept = numbered(samples, by, order, chunk).where(F.col("_seq") % factor == 0).withColumn("_out", F.expr(f"_seq div {factor}"))
    if size == 1:
        return kept.drop("_seq", "_out")
    whole = kept.groupBy(*by).agg(F.expr(f"count(1) div {size} * {size}").alias("_whole"))
    return kept.join(whole, list(by)).where("_out < _whole").select(*samples.columns)


def buffer_size(seconds: float, rate: float, factor: int = 1) -> int:
    """Whole samples, after decimation, of a buffer of so many seconds; one at least."""
    if seconds <= 0:
        raise ValueError("a buffer has a length")
    return max(1, round(seconds * rate / factor))


def auto_size(nsamples: int, factor: int) -> int:
    """Samples to an output buffer when none is asked for."""
    return max(1, nsamples // factor)


def fir(samples: DataFrame, taps: Sequence[float], by: Sequence[str], order: Sequence[str], value: str = "value", chunk: int | None = None, block: int = 65_536) -> DataFrame:
    """Adds filtered: the sum of taps[k] times the sample k before, zeros before the first. taps[0] goes with the newest.

    A null sample counts as zero and keeps its place. chunk: as of `numbered`; blocks of samples, each with the samples that it
    looks back on, are then filtered apart.
    """
    past = len(taps) - 1
    coefficients = F.array(*[F.lit(float(t)) for t in taps])

    def dot(w) -> Column:
        newest_first = F.reverse(F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(-past, 0)))
        return F.aggregate(F.zip_with(newest_first, F.slice(coefficients, 1, F.size(newest_first)), lambda x, c: x * c), F.lit(0.0), lambda acc, x: acc + x)

    if chunk is None:
        return samples.withColumn("filtered", dot(Window.partitionBy(*by).orderBy(*order)))
    blocks = with_halo(numbered(samples, by, order, chunk), "_seq", max(block, past), past)
    return blocks.withColumn("filtered", dot(Window.partitionBy(*by, "_block").orderBy("_seq"))).where("_own").drop("_seq", "_block", "_own")


def crossings(samples: DataFrame, threshold: float, by: Sequence[str], order: Sequence[str], upslope: bool = True, values: str = "values", chunk: int | None = None, block: int = 65_536) -> DataFrame:
    """Rows where any channel crosses the threshold; no refractory time. chunk: as of `fir`."""
    if chunk is None:
        rows = samples.withColumn("_p", F.lag(values).over(Window.partitionBy(*by).orderBy(*order)))
    else:
        blocks = with_halo(numbered(samples, by, order, chunk), "_seq", block, 1)
        rows = blocks.withColumn("_p", F.lag(values).over(Window.partitionBy(*by, "_block").orderBy("_seq"))).where("_own").drop("_seq", "_block", "_own")
    side = (lambda p, x: (p <= threshold) & (x > threshold)) if upslope else (lambda p, x: (p >= threshold) & (x < threshold))
    return rows.where(F.col("_p").isNotNull() & F.exists(F.zip_with("_p", values, side), lambda x: x)).drop("_p")


def firing_rate(spikes: DataFrame, by: Sequence[str], bin_us: int, n_spikes: str = "n_spikes", slots: int | None = None) -> DataFrame:
    """Spikes of all slots in bins of event time: by, bin_start, hw_ts (of the last buffer), n_spikes, bin_ms, mua (Hz).

    With slots, every buffer time must have that many rows, else the query fails: the streams are out of step.
    """
    if bin_us < 1:
        raise ValueError("a bin has a length")
    start = F.floor(F.col("hw_ts") / bin_us).cast("long") * bin_us
    if slots is not None:
        at = spikes.groupBy(*by, "hw_ts").agg(F.count(F.lit(1)).alias("_n"), F.sum(n_spikes).alias(n_spikes))
        spikes = at.withColumn("hw_ts", F.when(F.col("_n") == slots, F.col("hw_ts")).otherwise(F.raise_error(F.lit("spike streams are out of step"))))
    out = spikes.groupBy(*by, start.alias("bin_start")).agg(F.max("hw_ts").alias("hw_ts"), F.sum(n_spikes).cast("long").alias("n_spikes"))
    bin_ms = bin_us / 1000
    return out.withColumn("bin_ms", F.lit(bin_ms)).withColumn("mua", F.col("n_spikes") / F.lit(bin_ms) * F.lit(1000.0))


def spike_events(spikes: DataFrame, by: Sequence[str]) -> DataFrame:
    """One event for each buffer with spikes: spike for one, spikes for more."""
    return spikes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spikes"), F.min("hw_ts").alias("hw_ts")).withColumn("event", F.when(F.col("n_spikes") == 1, "spike").otherwise("spikes"))


def digital_events(column: Column) -> Column:
    """Number of set bits of a digital word."""
    return F.bit_count(column)
