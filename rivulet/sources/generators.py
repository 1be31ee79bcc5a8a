"""Signal and event generators: closed forms over a range of sample numbers, so any part of a stream can be made anywhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _stream(spark: SparkSession, n: int, rate: float, nchannels: int, value: Column) -> DataFrame:
    step = int(1_000_000 / rate)
    rows = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * step).alias("hw_ts"))
    return rows.withColumn("_v", value).select("seq", "hw_ts", F.array(*[F.col("_v")] * nchannels).alias("values"))


def uniform(number: Column, seed: int, salt: int) -> Column:
    """A number above 0 and up to 1 by the hash of seed, salt and number, so it is the same wherever it is drawn."""
    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), number).cast("binary")), 1, 12)
    return (F.conv(drawn, 16, 10).cast("long") + 1) / F.lit(float(1 << 48))


def normal(number: Column, seed: int) -> Column:
    """A standard normal number by two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(number, seed, 1))) * F.cos(F.lit(6.283185307179586) * uniform(number, seed, 2))


def _noise(sigma: float, seed: int) -> Column:
    return normal(F.col("seq"), seed) * sigma if sigma else F.lit(0.0)


def sine(spark: SparkSession, n: int, rate: float = 32_000, frequency: float = 1.0, amplitude: float = 1.0, offset: float = 0.0, noise: float = 0.0, nchannels: int = 1, seed: int = 0) -> DataFrame:
    """offset + amplitude * sin(2 pi f t), t in whole microsecond steps, the same on all channels."""
    value = F.lit(offset) + F.lit(amplitude) * F.sin(F.lit(2 * 3.141592653589793 * frequency) * F.col("hw_ts") / F.lit(1e6)) + _noise(noise, seed)
    return _stream(spark, n, rate, nchannels, value)


def square(spark: SparkSession, n: int, rate: float = 32_000, frequency: float = 1.0, amplitude: float = 1.0, duty: float = 0.5, offset: float = 0.0, noise: float = 0.0, nchannels: int = 1, seed: int = 0) -> DataFrame:
    """High for a duty share of each period, then low; both lengths in whole samples."""
    high, low = max(1, int(duty * rate / frequency)), max(1, int((1 - duty) * rate / frequency))
    value = F.when(F.col("seq") % (high + low) < high, amplitude).otherwise(-amplitude) + F.lit(offset) + _noise(noise, seed)
    return _stream(spark, n, rate, nchannels, value)


def white_noise(spark: SparkSession, n: int, rate: float = 32_000, mean: float = 0.0, sigma: float = 1.0, nchannels: int = 1, seed: int = 0) -> DataFrame:
    return _stream(spark, n, rate, nchannels, F.lit(mean) + _noise(sigma, seed))


def ripple(spark: SparkSession, n: int, rate: float = 32_000, frequency: float = 200.0, amplitude: float = 100.0, duration_ms: float = 100.0, interval_ms: float = 50.0, offset: float = 0.0, noise: float = 0.0, nchannels: int = 1, seed: int = 0) -> DataFrame:
    """Bursts: an interval of silence, then amplitude * exp(-(4c/d)^2 / 2) * cos(c w) for c from -d/2 to d/2.

    Each burst draws its amplitude around the mean from its own hash (a normal approximation of a Poisson draw), so bursts
    are the same wherever they are made.
    """
    if not 150 <= frequency <= 250:
        raise ValueError("ripples lie between 150 and 250 Hz")
    d, gap = duration_ms * rate / 1000, int(interval_ms * rate / 1000)
    period = gap + int(d)
    phase, number = F.col("seq") % period, F.expr(f"seq div {period}")
    drawn = F.greatest(F.lit(0.0), F.round(F.lit(amplitude) + normal(number, seed) * F.lit(amplitude**0.5)))
    c = phase - F.lit(gap + d / 2)
    burst = drawn * F.exp(F.lit(-0.5) * F.pow(c * 4.0 / d, F.lit(2.0))) * F.cos(c * F.lit(6.283185307179586 * frequency / rate))
    return _stream(spark, n, rate, nchannels, F.when(phase >= gap, burst).otherwise(0.0) + F.lit(offset) + _noise(noise, seed))


def random_events(spark: SparkSession, n: int, names: Sequence[str], rate: float = 1.0, seed: int = 0) -> DataFrame:
    """An event every whole 1000 / rate milliseconds, its name drawn evenly by a hash of its number."""
    if not names or rate <= 0:
        raise ValueError("names and a rate are needed")
    step = int(1000 / rate) * 1000
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")), 1, 8), 16, 10).cast("long")
    name = F.get(F.array(*map(F.lit, names)), (drawn % len(names)).cast("int"))
    return spark.range(n).select(F.col("id").alias("serial"), (F.col("id") * step).alias("hw_ts"), name.alias("event"))


#: Generators by name; the default is noise of mean 0 and deviation 1 at 32 kHz.
GENERATORS: dict[str, Callable[..., DataFrame]] = {"sine": sine, "square": square, "noise": white_noise, "ripple": ripple, "events": random_events}


def make(spark: SparkSession, spec: dict, n: int) -> DataFrame:
    """The generator named by spec's `class`, with its other entries; noise if there is none."""
    spec = dict(spec)
    name = spec.pop("class", "noise")
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}")
    return GENERATORS[name](spark, n, **spec)
