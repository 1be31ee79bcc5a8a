"""Raw acquisition packets and message packets: decoding, validity, time checks, gap filling. Native expressions, but for the
reading of serialized messages.

A raw packet is a row of 32-bit words: 2048, 1, channels + 10, time (high, low), status, digital word, ten reserved, the
samples, and the exclusive or of all words before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import signal as S

#: Fixed values of the packet format.
START, PACKET_ID, EXTRA, HEADER = 2048, 1, 10, 17
TIME_HIGH, TIME_LOW, DIGITAL = 3, 4, 6


def words_of(raw: Column, nchannels: int, swapped: bool = False) -> Column:
    """The little-endian 32-bit words of a binary packet; swapped: each 16-bit half has its bytes exchanged. Null where the
    packet is too short."""
    # One string of hex digits for the packet, of which each word takes four pairs, the last one first.
    word = lambda h, k: F.conv(F.concat(*[F.substring(h, 8 * k + 2 * j + 1, F.lit(2)) for j in (3, 2, 1, 0)]), 16, 10).cast("long")
    signed = lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int")
    digits = lambda h: F.transform(F.sequence(F.lit(0), F.lit(HEADER + nchannels)), lambda k: signed(word(h, k)))
    words = F.get(F.transform(F.array(F.hex(raw)), digits), 0)
    return F.transform(words, S.swap_16) if swapped else words


def error_code(words: Column, nchannels: int) -> Column:
    """0 for a valid packet; else the first of: 4 length, 2 start word, 3 packet id, 5 size field, 1 checksum."""
    return (
        F.when(F.coalesce(F.size(words), F.lit(-1)) != HEADER + nchannels + 1, 4)
        .when(F.get(words, 0) != START, 2)
        .when(F.get(words, 1) != PACKET_ID, 3)
        .when(F.get(words, 2) != nchannels + EXTRA, 5)
        .when(S.xor_checksum(words) != 0, 1)  # the last word is the checksum of all before
        .otherwise(0)
    )


def decode(packets: DataFrame, nchannels: int, channels: Sequence[int] | None = None) -> DataFrame:
    """Adds error, and for valid packets hw_ts, digital and values in microvolts (of the named channels only, if any)."""
    wanted = range(nchannels) if channels is None else channels
    if not all(0 <= c < nchannels for c in wanted):
        raise ValueError("a channel is out of range")
    w, ok = F.col("_words"), F.col("error") == 0
    values = F.array(*[F.get(w, HEADER + c).cast("double") * S.MICROVOLTS for c in wanted])
    # A generator keeps the planner from writing the packet into whatever reads of it: words that come from an expression are
    # made once for a packet, and checked once, not once for each look at a word.
    checked = F.transform(F.array("words"), lambda x: F.struct(x.alias("_words"), error_code(x, nchannels).alias("error")))
    return (
        packets.select(*[c for c in packets.columns if c != "error"], F.inline_outer(checked))
        .withColumn("hw_ts", F.when(ok, S.from_words(F.get(w, TIME_HIGH), F.get(w, TIME_LOW))))
        .withColumn("digital", F.when(ok, F.get(w, DIGITAL)))
        .withColumn("values", F.when(ok, values))
        .drop("_words")
    )


def check_times(rows: DataFrame, by: Sequence[str], order: Sequence[str], period_us: float = 31.25, chunk: int | None = None) -> DataFrame:
    """Adds status (first, duplicated, out_of_order, gap or ok) and missed (samples left out before this one).

    The time compared with is the largest one before, so a late packet does not move it. chunk: length of a chunk of the first
    column of the order; the largest times of the chunks before are then joined to each, so one long stream is many tasks.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if chunk is None:
        rows = rows.withColumn("_last", F.max("hw_ts").over(before(Window.partitionBy(*by).orderBy(*order))))
    else:
        kept = rows.columns
        cut = rows.withColumn("_chunk", F.floor(F.col(order[0]) / chunk))
        heads = cut.groupBy(*by, "_chunk").agg(F.max("hw_ts").alias("_m"))
        heads = heads.select(*by, "_chunk", F.max("_m").over(before(Window.partitionBy(*by).orderBy("_chunk"))).alias("_head"))
        own = F.max("hw_ts").over(before(Window.partitionBy(*by, "_chunk").orderBy(*order)))
        rows = cut.withColumn("_own", own).join(heads, [*by, "_chunk"]).select(*kept, F.greatest("_head", "_own").alias("_last"))
    delta, limit = F.col("hw_ts") - F.col("_last"), int(period_us) + 1
    status = F.when(F.col("_last").isNull(), "first").when(delta == 0, "duplicated").when(delta < 0, "out_of_order").when(delta > limit, "gap").otherwise("ok")
    missed = F.when(F.col("status") == "gap", F.floor(delta / period_us + 0.5).cast("long") - 1).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("status", status).withColumn("missed", missed).drop("_last")


def quality(checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of duplicated and out-of-order packets, gaps, and missed samples."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n("duplicated").alias("n_duplicated"), n("out_of_order").alias("n_out_of_order"), n("gap").alias("n_gaps"), F.sum("missed").alias("n_missed"))


def parse(packets: DataFrame, nchannels: int, by: Sequence[str], order: Sequence[str], batch: int = 2, gap_fill: str = "asap", trigger: int | None = None, period_us: float = 31.25) -> dict[str, DataFrame]:
    """Packets (by, order, words) as samples: data (by, order, copy, hw_ts, digital, values) and invalid (counts by error code).

    Valid packets are taken from the first one on whose digital word has the trigger's bit, if a trigger is named. After each
    batch the last sample is repeated for what was missed, copy counting the repeats from 1; a last partial batch is dropped.
    """
    from rivulet.operators import events, kernels, runner, signal

    (key,) = by
    decoded = decode(packets, nchannels)
    invalid = decoded.where("error <> 0").groupBy(*by, "error").agg(F.count(F.lit(1)).alias("n"))
    valid = decoded.where("error = 0").select(*by, *order, "hw_ts", "digital", "values")
    if trigger is not None:
        valid = events.one_shot_gate(valid, S.bit_is_set(F.col("digital"), trigger), by, order)
    valid = signal.rebuffer_rows(valid, by, order, 1, batch)
    filled = runner.batch(valid, key, order, kernels.GapFill(batch, gap_fill, period_us), [*order, "hw_ts", "digital", "values"])
    return {"data": repeat_rows(filled).drop("copies"), "invalid": invalid}


def repeat_rows(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row, followed by as many copies of itself; adds copy, 0 for the row itself."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies))))


def unpack_messages(messages: DataFrame, nchannels: int) -> DataFrame:
    """One row for each sample of channel-major messages: sample i has time ts + i and a value of every channel.

    A message of another number of channels makes the query fail.
    """
    right = F.when(F.col("n_channels") == nchannels, F.col("n_samples")).otherwise(F.raise_error(F.lit("unexpected number of channels")).cast("int"))
    placed = messages.withColumn("i", F.explode(F.when(right > 0, F.sequence(F.lit(0), right - 1)).otherwise(F.array().cast("array<int>"))))
    values = F.transform(F.sequence(F.lit(0), F.lit(nchannels - 1)), lambda c: F.get("samples", c * F.col("n_samples") + F.col("i")).cast("double"))
    kept = [c for c in messages.columns if c not in ("samples", "n_channels", "n_samples", "ts")]
    return placed.select(*kept, "i", (F.col("ts") + F.col("i")).alias("hw_ts"), values.alias("values"))


def message_gaps(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of places where the message number does not follow the one before."""
    step = F.col("message_id") - F.lag("message_id").over(Window.partitionBy(*by).orderBy("message_id"))
    return messages.withColumn("_step", step).groupBy(*by).agg(F.count_if(F.col("_step") != 1).alias("n_gaps"), F.count(F.lit(1)).alias("n_messages"))


#: Fields of a serialized message in the order of its table, and how each is stored. Fixed values of the message format.
MESSAGE_FIELDS = (("samples", "vector"), ("n_channels", "<u4"), ("n_samples", "<u4"), ("ts", "<u8"), ("message_id", "<u8"), ("sample_rate", "<u4"))


def read_message(data: bytes) -> dict | None:
    """A message's fields from its serialized table; None if its offsets lead outside of it. Fields left out are 0 or empty."""

    def number(kind: str, at: int) -> int:
        if at < 0:
            raise ValueError
        return int(np.frombuffer(data, kind, 1, at)[0])

    try:
        table = number("<u4", 0)
        fields = table - number("<i4", table)  # the list of where each field lies in the table
        known = (number("<u2", fields) - 4) // 2
        out = {}
        for k, (name, kind) in enumerate(MESSAGE_FIELDS):
            place = number("<u2", fields + 4 + 2 * k) if k < known else 0
            if kind == "vector":
                start = table + place + number("<u4", table + place) if place else 0
                out[name] = np.frombuffer(data, "<f4", number("<u4", start), start + 4) if place else np.zeros(0, "<f4")
            else:
                out[name] = number(kind, table + place) if place else 0
        return out
    except ValueError:
        return None


def read_messages(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The kept columns, and the fields of a column of serialized messages, as `unpack_messages` takes them. Those that can't be
    read are left out; so are nulls."""

    def run(batches):
        for batch in batches:
            found = [read_message(bytes(x)) if x is not None else None for x in batch[column]]
            good = np.array([x is not None for x in found], bool)
            out = batch[list(keep)][good].reset_index(drop=True)
            for name, kind in MESSAGE_FIELDS:
                out[name] = pd.Series([x[name] for x in found if x is not None], dtype=object if kind == "vector" else np.int64)
            yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "samples array<float>", "n_channels int", "n_samples int", "ts long", "message_id long", "sample_rate int"])
    return df.select(*keep, column).mapInPandas(run, schema)
