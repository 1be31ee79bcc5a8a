"""Array and scalar functions of samples, as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microvolts of one raw unit. Fixed value of the packet format.
MICROVOLTS = 0.015624999960550667


def sample_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sample_mean(values: Column) -> Column:
    """Null for a sample without channels."""
    return sample_sum(values) / F.when(F.size(values) > 0, F.size(values))


def sample_sum_abs(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def sample_mean_abs(values: Column) -> Column:
    return sample_sum_abs(values) / F.when(F.size(values) > 0, F.size(values))


def mean_power(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x) / F.when(F.size(values) > 0, F.size(values))


def gather(values: Column, channels: Sequence[int]) -> Column:
    """The named channels, in the order given; a channel may be named twice."""
    if not channels:
        raise ValueError("no channels are named")
    return F.array(*[F.get(values, c) for c in channels])


def inverted(values: Column) -> Column:
    return F.transform(values, lambda x: -x)


def scaled(values: Column, factor: float = MICROVOLTS) -> Column:
    return F.transform(values, lambda x: x.cast("double") * factor)


def z_score(x: Column, center: Column, dispersion: Column) -> Column:
    return (x - center) / dispersion


def rate_hz(n: Column, bin_ms: float) -> Column:
    return n / F.lit(bin_ms) * F.lit(1000.0)


def outlier_weight(z: Column, z0: float, h: float) -> Column:
    """1 up to z0, then halved with every h."""
    return F.when(F.abs(z) > z0, F.pow(F.lit(2.0), (F.lit(z0) - F.abs(z)) / h)).otherwise(1.0)


def xor_checksum(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("int"), lambda acc, x: acc.bitwiseXOR(x))


def bit_is_set(word: Column, bit: int) -> Column:
    return F.getbit(word.cast("long"), F.lit(bit)) == 1


def from_words(high: Column, low: Column) -> Column:
    """A number of two unsigned 32-bit words; null from 2^63 up, where it has no signed form."""
    unsigned = lambda w: w.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(high >= 0, unsigned(high) * F.lit(1 << 32) + unsigned(low))


def swap_16(word: Column) -> Column:
    """A 32-bit word with the bytes of both its halves swapped."""
    w = word.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    swapped = F.shiftleft(w.bitwiseAND(F.lit(0x00FF00FF)), 8).bitwiseOR(F.shiftright(w.bitwiseAND(F.lit(0xFF00FF00)), 8))
    return F.when(swapped >= 1 << 31, swapped - (1 << 32)).otherwise(swapped).cast("int")


def states_text(states: Column, high: str = "1", low: str = "0", spacer: str = "") -> Column:
    return F.array_join(F.transform(states, lambda s: F.when(s, high).otherwise(low)), spacer)


def set_states(states: Column, channels: Sequence[int], value: bool | None = None) -> Column:
    """Sets channels, or toggles them if value is None; channels out of range are ignored."""
    chosen = F.array(*[F.lit(c) for c in channels])
    return F.transform(states, lambda s, k: F.when(F.array_contains(chosen, k), ~s if value is None else F.lit(value)).otherwise(s))
