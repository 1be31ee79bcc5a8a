"""The registered queries: every operator over the driver's tables.

A stream is a user's events in order of time, a sample is an event's value, an event's name is its type; the matrix of
multichannel samples is `embeddings` with vec_id as the order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import filters
from rivulet.functions import signal as fs
from rivulet.model import StreamInfo
from rivulet.operators import events as ev
from rivulet.operators import kernels as K
from rivulet.operators import packets as pk
from rivulet.operators import runner
from rivulet.operators import signal as sg
from rivulet.plans import pipeline
from rivulet.sources import generators as gen

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Microseconds since 1970 of a time without zone, whatever the session's zone.
MICROSECONDS = "unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) AS hw_ts"
KEY, ORDER = "user_id", ("hw_ts", "event_id")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return raw.select("event_id", "user_id", F.expr(MICROSECONDS), *columns)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return raw.select("vec_id", F.col("embedding").cast("array<double>").alias("values"))


def run(df: DataFrame, kernel: K.Kernel, *keep: str) -> DataFrame:
    return runner.batch(df, KEY, ORDER, kernel, ["event_id", *keep])


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, F.col("event_type").alias("event"))


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "value")


def distributor(spark, sf_dir):
    return sg.distribute_long(matrix(spark, sf_dir), {"hp": [1, 2, 3], "cx": [9, 0, 9]})


def sample_stats(spark, sf_dir):
    v = F.col("values")
    made = {"total": fs.sample_sum(v), "mean": fs.sample_mean(v), "total_abs": fs.sample_sum_abs(v), "mean_abs": fs.sample_mean_abs(v), "power": fs.mean_power(v)}
    return matrix(spark, sf_dir).select("vec_id", *[F.round(x, 6).alias(n) for n, x in made.items()])


def event_convert(spark, sf_dir):
    e = named(spark, sf_dir)
    appended = ev.convert(e, "_x", replace=False).select("event_id", F.col("event").alias("appended"))
    return appended.withColumn("replaced", F.lit("stimulation"))


def event_to_state(spark, sf_dir):
    return ev.to_state(named(spark, sf_dir), "purchase").select("event_id", "event", "enabled")


def state_changes(spark, sf_dir):
    return ev.changes(ev.to_state(named(spark, sf_dir), "purchase"), [KEY], ORDER).select("event_id", KEY, "enabled")


def event_log(spark, sf_dir):
    return ev.log(named(spark, sf_dir), "purchase", [KEY])


def rebuffer(spark, sf_dir):
    packed = sg.rebuffer(valued(spark, sf_dir), [KEY], ORDER, factor=3, size=4)
    return packed.select(KEY, "buffer", "n", "hw_ts", *[F.get("values", k).alias(f"v{k}") for k in range(4)])


def firing_rate(spark, sf_dir):
    spikes = events(spark, sf_dir, F.get_json_object("props", "$.k").cast("long").alias("n_spikes"))
    return sg.firing_rate(spikes, [KEY], DAY).select(KEY, "bin_start", "hw_ts", "n_spikes", "mua")


def event_sync(spark, sf_dir):
    e = named(spark, sf_dir).select(F.col("event").alias("slot"), "hw_ts", F.col("event_id").alias("serial"), KEY)
    return ev.sync_rounds(e, F.lit(True), 5, [KEY]).select(KEY, "round", "at")


def event_sync_stateful(spark, sf_dir):
    e = named(spark, sf_dir).withColumn("slot", F.col("event")).withColumn("event", F.lit("t"))
    slots = ("click", "error", "purchase", "signup", "view")
    return run(e, K.Rendezvous("t", slots)).select(KEY, "event_id", "at", "round")


def event_filter(spark, sf_dir):
    e = named(spark, sf_dir).withColumn("stream", F.col("user_id") % 50).withColumn("slot", F.col("user_id"))
    kept = ev.coincidence_filter(e.where("event = 'purchase'"), e.where("event = 'error'"), ["stream"], 24 * HOUR, 12 * HOUR, 6 * HOUR, 2)
    return kept.select("event_id", "stream", "slot", "hw_ts", F.col("n_slots").cast("long").alias("n_slots"))


def as_of_state(spark, sf_dir):
    e = named(spark, sf_dir)
    states = e.where("event in ('signup', 'error')").select(KEY, "hw_ts", (F.col("event") == "signup").alias("enabled"))
    return ev.as_of_state(e.where("event = 'click'").select("event_id", KEY, "hw_ts"), states, [KEY]).select("event_id", "enabled")


def interleave(spark, sf_dir):
    e = named(spark, sf_dir).select("event_id", "event")
    return ev.interleave(e.where("event = 'click'"), e.where("event = 'error'"))


def first_packets(spark, sf_dir):
    return ev.first_packets(named(spark, sf_dir), 25, ["hw_ts", "event_id"])


def _digital(spark, sf_dir):
    return events(spark, sf_dir, F.get_json_object("props", "$.k").cast("long").alias("word"))


def trigger_one_shot(spark, sf_dir):
    d = _digital(spark, sf_dir)
    return ev.one_shot_gate(d, fs.bit_is_set(F.col("word"), 6), [KEY], ORDER).select("event_id")


def trigger_level(spark, sf_dir):
    return ev.level_gate(_digital(spark, sf_dir), fs.bit_is_set(F.col("word"), 6)).select("event_id", "word")


def time_check(spark, sf_dir):
    # Arrival by a scrambled order within each user, so that all kinds of disorder occur.
    e = events(spark, sf_dir).withColumn("hw_ts", F.expr("hw_ts div 3600000000")).withColumn("arrival", F.expr("event_id + (event_id % 7) * 400"))
    checked = pk.check_times(e, [KEY], ["arrival", "event_id"], 2.5)
    return pk.quality(checked, [KEY])


def level_cross_up(spark, sf_dir):
    return sg.crossings(valued(spark, sf_dir).withColumn("values", F.array("value")), 50.0, [KEY], ORDER).select("event_id")


def level_cross_down(spark, sf_dir):
    return run(valued(spark, sf_dir), K.LevelCrossing(50.0, False, 0)).select("event_id")


def level_cross_blocked(spark, sf_dir):
    return run(valued(spark, sf_dir), K.LevelCrossing(50.0, True, 2)).select("event_id")


def level_cross_channels(spark, sf_dir):
    m = matrix(spark, sf_dir).withColumn("stream", F.col("vec_id") % 8).withColumnRenamed("values", "value")
    return runner.batch(m, "stream", ["vec_id"], K.LevelCrossing(0.3, True, 3), ["vec_id"]).select("vec_id")


def smoother(spark, sf_dir):
    return run(valued(spark, sf_dir), K.Smoother(0.1)).select("event_id", F.round("smooth", 6).alias("smooth"))


def running_stats(spark, sf_dir):
    return run(valued(spark, sf_dir), K.RunningStats(0.1, 5)).select("event_id", "center", "dispersion")


def running_stats_protected(spark, sf_dir):
    return run(valued(spark, sf_dir), K.RunningStats(0.1, 5, 2.0, 2.0)).select("event_id", "center", "dispersion")


def peaks(spark, sf_dir):
    return run(valued(spark, sf_dir), K.Peak()).select("event_id", "peak_ts", "amplitude")


def ripple(spark, sf_dir):
    found = run(valued(spark, sf_dir), K.Oscillation(2.0, 10.0, 3000.0, 1.0, 1, True))
    return found.select("event_id", F.round("test_value", 4).alias("test_value"), F.round("threshold", 4).alias("threshold"), "detected", "locked")


def ripple_buckets(spark, sf_dir):
    """Thresholds set once for each bucket of 4 samples, statistics shown for every third one."""
    found = run(valued(spark, sf_dir), K.Oscillation(2.0, 10.0, 3000.0, 1.0, 4, True, 3))
    return found.select("event_id", F.round("test_value", 4).alias("test_value"), F.round("threshold", 4).alias("threshold"), "detected", "locked", "shown")


def burst(spark, sf_dir):
    rate = sg.firing_rate(events(spark, sf_dir, F.lit(1).alias("n_spikes")), [KEY], DAY)
    found = runner.batch(rate.withColumn("value", F.col("n_spikes").cast("double")), KEY, ["bin_start"], K.burst(1.0, 5.0, 2000.0, 1000.0), ["bin_start"])
    return found.select(KEY, "bin_start", F.round("test_value", 6).alias("test_value"), F.round("threshold", 6).alias("threshold"), "detected")


def spikes(spark, sf_dir):
    return run(valued(spark, sf_dir), K.Spike(60.0, False, 4)).select("event_id", "spike_ts", F.get("amplitudes", 0).alias("amplitude"))


def spike_events(spark, sf_dir):
    found = run(valued(spark, sf_dir), K.Spike(60.0, False, 4), "hw_ts").select(KEY, F.expr(f"spike_ts div {5 * DAY}").alias("buffer"), F.col("spike_ts").alias("hw_ts"))
    return sg.spike_events(found, [KEY, "buffer"])


def spikes_channels(spark, sf_dir):
    """Spikes over all 64 channels: a crossing on any of them opens the search on each."""
    m = matrix(spark, sf_dir).select("vec_id", (F.col("vec_id") % 8).alias("stream"), F.col("vec_id").alias("hw_ts"), F.col("values").alias("value"))
    out = runner.batch(m, "stream", ["vec_id"], K.Spike(0.2, True, 3), ["vec_id"])
    return out.select("vec_id", "spike_ts", F.array_join(F.transform("amplitudes", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",").alias("amplitudes"))


def fir(spark, sf_dir):
    return sg.fir(valued(spark, sf_dir), (0.5, 0.3, 0.2), [KEY], ORDER).select("event_id", F.round("filtered", 6).alias("filtered"))


def fir_kernel(spark, sf_dir):
    out = run(valued(spark, sf_dir), K.Fir((0.5, 0.3, 0.2)))
    return out.select("event_id", F.round(F.get("filtered", 0), 6).alias("filtered"))


def slope(spark, sf_dir):
    return sg.fir(valued(spark, sf_dir), filters.slope_taps(4, 1, 1), [KEY], ORDER).select("event_id", F.round("filtered", 6).alias("filtered"))


SECTIONS = ((0.2, 0.4, 0.2, 1.0, -0.5, 0.25), (1.0, -1.0, 0.0, 1.0, 0.3, 0.0))


def biquad(spark, sf_dir):
    out = run(valued(spark, sf_dir), K.Biquad(SECTIONS, 0.5))
    return out.select("event_id", F.round(F.get("filtered", 0), 6).alias("filtered"))


def multichannel_filter(spark, sf_dir):
    m = matrix(spark, sf_dir).withColumn("stream", F.col("vec_id") % 4).withColumnRenamed("values", "value")
    out = runner.batch(m, "stream", ["vec_id"], K.Fir((0.5, 0.25, 0.25)), ["vec_id"])
    return out.select("vec_id", *[F.round(F.get("filtered", c), 6).alias(f"c{c}") for c in range(64)])


def event_delayed_detection(spark, sf_dir):
    e = named(spark, sf_dir).where("event in ('click', 'view')")
    return run(e, K.Delayed("detection", 36 * HOUR, after_detection=True)).select("event_id", "at", "message")


def event_delayed_ontime(spark, sf_dir):
    e = named(spark, sf_dir).where("event in ('click', 'view')")
    return run(e, K.Delayed("ontime", 36 * HOUR)).select("event_id", "at", "message")


def event_delayed(spark, sf_dir):
    e = named(spark, sf_dir).where("event in ('click', 'view')").withColumn("delay", (F.col("event_id") % 7) * HOUR)
    return run(e, K.Delayed("delayed", 24 * HOUR)).select("event_id", "at", "message")


def gap_fill(spark, sf_dir):
    e = events(spark, sf_dir)
    filled = run(e.withColumn("hw_ts", F.expr("hw_ts div 3600000000")), K.GapFill(2, "asap", 10.0))
    return filled.select("event_id", "copies")


def gap_fill_distributed(spark, sf_dir):
    filled = run(events(spark, sf_dir).withColumn("hw_ts", F.expr("hw_ts div 3600000000")), K.GapFill(2, "distributed", 10.0))
    return pk.repeat_rows(filled).select("event_id", "copy")


def digital_state(spark, sf_dir):
    protocols = {"click": {"high": [0, 1]}, "view": {"low": [0], "toggle": [1]}, "error": {"toggle": [2]}}
    out = run(named(spark, sf_dir), K.DigitalState(protocols, 4))
    return out.select("event_id", "at", fs.states_text(F.col("state")).alias("state"))


def digital_pulse(spark, sf_dir):
    protocols = {"purchase": {"pulse": [2]}, "click": {"high": [0]}, "error": {"low": [0]}}
    out = run(named(spark, sf_dir), K.DigitalState(protocols, 4, 12 * HOUR))
    return out.select("event_id", "at", fs.states_text(F.col("state")).alias("state"))


def throttle(spark, sf_dir):
    e = events(spark, sf_dir, F.get_json_object("props", "$.k").cast("long").alias("nread"))
    return run(e, K.Throttle(200, 0.3, 0.5)).select("event_id", "kept", F.round("level", 9).alias("level"))


def packet_decode(spark, sf_dir):
    """Packets built from the events, some of them broken, then decoded and validated."""
    e = events(spark, sf_dir, "value")
    k = F.col("event_id")
    i = lambda x: x.cast("int")
    body = F.concat(
        F.array(i(F.when(k % 11 == 3, 8).otherwise(pk.START)), i(F.when(k % 13 == 5, 2).otherwise(pk.PACKET_ID)), i(F.when(k % 17 == 7, 9).otherwise(4 + pk.EXTRA))),
        F.array(i(F.expr("hw_ts div 4294967296")), i(F.expr("if(hw_ts % 4294967296 >= 2147483648, hw_ts % 4294967296 - 4294967296, hw_ts % 4294967296)"))),
        F.array(i(F.lit(0)), i(k % 256)), F.array_repeat(i(F.lit(0)), 10), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: i(F.round(F.col("value") * 100) * (c + 1) - k % 1000)),
    )
    crc = F.when(k % 19 == 9, F.lit(1)).otherwise(0).cast("int").bitwiseXOR(fs.xor_checksum(F.col("body")))
    whole = e.withColumn("body", body).withColumn("words", F.concat("body", F.array(crc)))
    whole = whole.withColumn("words", F.when(k % 23 == 11, F.slice("words", 1, 10)).otherwise(F.col("words"))).select("event_id", "words")
    return pk.decode(whole, 4).select("event_id", "error", "hw_ts", "digital", *[F.round(F.get("values", c), 9).alias(f"v{c}") for c in range(4)])


def message_unpack(spark, sf_dir):
    m = matrix(spark, sf_dir).select(F.col("vec_id").alias("message_id"), (F.col("vec_id") * 8).alias("ts"), F.lit(8).alias("n_channels"), F.lit(8).alias("n_samples"), F.col("values").alias("samples"))
    out = pk.unpack_messages(m, 8)
    return out.select("message_id", "hw_ts", *[F.round(F.get("values", c), 6).alias(f"c{c}") for c in range(8)])


def message_gaps(spark, sf_dir):
    m = named(spark, sf_dir).where("event = 'view'").withColumnRenamed("event_id", "message_id")
    return pk.message_gaps(m, [KEY])


def source_sine(spark, sf_dir):
    return gen.sine(spark, 2000, 1000.0, 5.0, 2.0, 1.0, nchannels=2).select("seq", "hw_ts", F.round(F.get("values", 1), 6).alias("value"))


def source_square(spark, sf_dir):
    return gen.square(spark, 2000, 1000.0, 4.0, 3.0, 0.3).select("seq", "hw_ts", F.get("values", 0).alias("value"))


def source_noise(spark, sf_dir):
    return gen.white_noise(spark, 2000).select("seq", "hw_ts", F.round(F.get("values", 0), 6).alias("value"))


def source_ripple(spark, sf_dir):
    return gen.ripple(spark, 4000, 8000.0).select("seq", "hw_ts", F.round(F.get("values", 0), 6).alias("value"))


def source_events(spark, sf_dir):
    return gen.random_events(spark, 1000, ["foo", "bar", "baz"], 30.0, 7)


def _stream(spark, sf_dir, cut: str) -> pipeline.Port:
    rows = valued(spark, sf_dir).where(cut).select(F.col("user_id").alias("stream_id"), "hw_ts", F.array("value").alias("values"))
    return pipeline.Port(rows, StreamInfo(sample_rate=1.0))


def graph(spark, sf_dir):
    """A graph of detectors, filter and trigger over two streams, built from a specification."""
    spec = {
        "processors": {
            "smooth": {"class": "filter", "options": {"filter": {"type": "fir", "coefficients": [0.5, 0.5]}}},
            "cross(1-2)": {"class": "levelcrossing", "options": {"threshold": 60.0, "post detect block": 1, "event": "hit"}},
            "gate": {"class": "eventfilter", "options": {"target event": "hit", "sync time": 1.0, "block duration": 43_200_000.0, "block wait time": 0.0}},
            "rename": {"class": "converter", "options": {"event name": "stimulation"}},
            "trigger": {"class": "delayed", "options": {"event trigger lockout time": {"period": 86_400_000.0}, "analysis lockout time": {"period": 0.0}}},
        },
        "connections": [["a.data", "smooth"], ["smooth.data", "cross1.data"], ["b.data", "cross2.data"], ["cross1.events", "gate.events"], ["cross2.events", "gate.blocking events"], ["gate", "rename"], ["rename", "trigger"]],
    }
    out = pipeline.build(spec, {"a": {"data": _stream(spark, sf_dir, "event_id % 2 = 0")}, "b": {"data": _stream(spark, sf_dir, "event_id % 2 = 1")}})
    return out["trigger"]["events"].df.select("stream_id", "hw_ts", "event")


def closed_loop(spark, sf_dir):
    """A trigger that switches its detector off for two days after each stimulation."""
    spec = {
        "processors": {
            "detector": {"class": "RippleDetector", "options": {"threshold dev": 2.0, "smooth time": 10.0, "analysis lockout time": 0.0}},
            "trigger": {"class": "EventDelayed", "options": {"event trigger lockout time": {"period": 0.0}, "analysis lockout time": {"period": 172_800_000.0}}},
        },
        "connections": ["in.data = detector.data", "detector.events = trigger.events"],
        "states": [["trigger.analysis enabled", "detector.detection enabled"]],
    }
    out = pipeline.build(spec, {"in": {"data": _stream(spark, sf_dir, "true")}})
    return out["trigger"]["events"].df.select("stream_id", "hw_ts", "event")


def graph_events(spark, sf_dir):
    """Sources, a filter with blocking sources, a logger and file sinks; what the filter lets pass."""
    spec = """
processors:
  source foo(1-2):
    class: EventSource
    options: {events: foo, rate: 1}
  source slow:
    class: EventSource
    options: {events: target, rate: 3}
  source fast:
    class: EventSource
    options: {events: target, rate: 20}
  source bang:
    class: EventSource
    options: {events: bang, rate: 1}
  event filter:
    class: EventFilter
    options: {target event: target, block wait time: 2, sync time: 6.5, detection criterion: any, discard warnings: false}
  sink(1-3):
    class: FileSerializer
    options: {encoding: yaml, format: full, throttle/enabled: false}
  event sink:
    class: EventLogger
    options: {target event: target}
connections:
  - source foo1.events=p:events.f:event filter
  - source slow.events=p:events.f:event filter
  - source fast.events=p:blocking events.f:event filter
  - source bang.events=p:blocking events.f:event filter
  - source foo(1-2).events=sink(1-2).data
  - event filter.events=event sink.events
  - event filter.events=sink3.data
"""
    out = pipeline.build(spec, spark=spark, seconds=200.0)
    counts = out["event sink"]["counts"].df.select("stream_id", "n_all", "n_target")
    return out["sink3"]["0"].df.join(counts, "stream_id").select("hw_ts", "event", "n_all", "n_target")


def _packets(df: DataFrame, stream, arrival, hw_ts, samples, serial=None) -> pipeline.Port:
    """Whole packets of the samples (integers), with their checksum. serial: the order of packets that arrive at one time."""
    low = hw_ts % (1 << 32)
    i = lambda x: x.cast("int")
    head = lambda n: F.array(i(F.lit(pk.START)), i(F.lit(pk.PACKET_ID)), i(n + pk.EXTRA), i(F.floor(hw_ts / (1 << 32))), i(F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)), i(F.lit(0)), i(arrival % 256))
    body = F.transform(F.array(samples), lambda x: F.concat(head(F.size(x)), F.array_repeat(i(F.lit(0)), 10), x))
    words = F.get(F.transform(body, lambda b: F.concat(b, F.array(fs.xor_checksum(b)))), 0)
    order = {"arrival": arrival} | ({} if serial is None else {"serial": serial})
    whole = df.select(stream.alias("stream_id"), *[c.alias(name) for name, c in order.items()], words.alias("words"))
    return pipeline.Port(whole, StreamInfo("packets"), order=tuple(order))


def graph_packets(spark, sf_dir):
    """Packets of 64 channels, some of them lost, parsed in batches with gaps filled, and dealt to two ports."""
    m = matrix(spark, sf_dir).where("vec_id % 40 NOT BETWEEN 5 AND 15")
    feed = _packets(m, F.lit(0), F.col("vec_id"), F.col("vec_id") * 31, F.transform("values", lambda x: F.round(x * 1000).cast("int")))
    spec = {
        "processors": {
            "reader": {"class": "NlxPureReader", "options": {"nchannels": 64}}, "parser": {"class": "NlxParser", "options": {"batch size": 10, "gap fill": "asap"}},
            "distributor": {"class": "Distributor", "options": {"channelmap": {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8]}}},
        },
        "connections": ["reader = parser", "parser.data = distributor.data"],
    }
    out = pipeline.build(spec, {"reader": {"feed": feed}})["distributor"]
    rows = [out[k].df.select(F.lit(k).alias("port"), "arrival", "copy", "hw_ts", "digital", *[F.round(F.get("values", c), 6).alias(f"v{c}") for c in range(4)]) for k in "ab"]
    return rows[0].union(rows[1])


def graph_ripple(spark, sf_dir):
    """Packets to two filtered signals, detectors on both, one blocking the other's events, and a trigger in a feedback loop."""
    e = valued(spark, sf_dir)
    samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: (F.round(F.col("value") * 100) * (c + 1) - F.col("event_id") * (c + 3) % 1000).cast("int"))
    ordered = e.withColumn("arrival", F.col("hw_ts"))
    feed = _packets(ordered, F.col("user_id"), F.col("arrival"), F.col("hw_ts"), samples, F.col("event_id"))
    detector = {"smooth time": 3.125e-4, "analysis lockout time": 0.0625}
    spec = {
        "processors": {
            "source": {"class": "NlxReader", "options": {"nchannels": 4, "batch size": 1, "channelmap": {"hp": [1, 3], "cx": [2]}}},
            "ripple_filter (1-2)": {"class": "MultiChannelFilter", "options": {"filter": {"type": "fir", "coefficients": [0.5, -0.25, 0.25]}}},
            "first": {"class": "RippleDetector", "options": detector | {"threshold dev": 1.5}},
            "second": {"class": "RippleDetector", "options": detector | {"threshold dev": 2.0, "stream statistics": False}},
            "eventfilter": {"class": "EventFilter", "options": {"target event": "ripple", "block duration": 86_400_000.0, "sync time": 1.5, "block wait time": 3_600_000.0, "detection criterion": "any"}},
            "trigger": {"class": "EventDelayed", "options": {"event trigger lockout time": {"period": 90_000_000.0, "detection": False, "stimulation": True}, "analysis lockout time": {"period": 43_200_000.0, "starting time": [0]}}},
            "serial": {"class": "SerialOutput"}, "network": {"class": "ZMQSerializer", "options": {"encoding": "binary", "format": "compact"}},
        },
        "connections": [
            "source.hp=ripple_filter1.data", "source.cx=ripple_filter2.data", "ripple_filter1.data=first.data", "ripple_filter2.data=second.data", "first.events=eventfilter.events",
            "second.events=eventfilter.blocking_events", "eventfilter.events=trigger.events", "trigger.events=serial.events", "first.statistics=network.data",
        ],
        "states": [["trigger.analysis enabled", "first.detection enabled"]],
    }
    out = pipeline.build(spec, {"source": {"feed": feed}})
    return out["serial"]["messages"].df.select("stream_id", "hw_ts", "message")


def _one_stream(spark, sf_dir):
    return valued(spark, sf_dir).withColumn("stream_id", F.lit(0))


def fir_chunked(spark, sf_dir):
    """One long stream filtered in blocks with a halo, so that it is many tasks."""
    return sg.fir(_one_stream(spark, sf_dir), (0.5, 0.3, 0.2), ["stream_id"], ORDER, chunk=DAY, block=1000).select("event_id", F.round("filtered", 6).alias("filtered"))


def level_cross_chunked(spark, sf_dir):
    rows = _one_stream(spark, sf_dir).withColumn("values", F.array("value"))
    return sg.crossings(rows, 50.0, ["stream_id"], ORDER, chunk=DAY, block=1000).select("event_id")


def rebuffer_chunked(spark, sf_dir):
    packed = sg.rebuffer(_one_stream(spark, sf_dir), ["stream_id"], ORDER, factor=3, seconds=12.0, rate=1.0, chunk=DAY)
    return packed.select("buffer", "n", "hw_ts", *[F.get("values", k).alias(f"v{k}") for k in range(4)])


def time_check_chunked(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hw_ts", F.expr("hw_ts div 3600000000")).withColumn("arrival", F.expr("event_id + (event_id % 7) * 400")).withColumn("stream_id", F.lit(0))
    return pk.quality(pk.check_times(e, ["stream_id"], ["arrival", "event_id"], 2.5, chunk=1000), ["stream_id"])


def _shared(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(configured or '/tmp/rivulet-checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # goes when the driver ends
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def streaming_level_cross(spark, sf_dir):
    """The refractory crossing as a streaming query over the events file, run to its end; equals the batch query."""
    from rivulet.streaming.runner import stateful, stream

    base = _shared(spark)
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    live = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = stream(live.select("event_id", KEY, F.expr(MICROSECONDS), "value"), KEY, ["hw_ts", "event_id"], K.LevelCrossing(50.0, True, 2), ["event_id"])
    with stateful(spark):
        query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("event_id")


def serialized(spark, sf_dir):
    """Events written to one folder a stream and read back."""
    from rivulet.sources.files import serialize

    base = _shared(spark)
    e = named(spark, sf_dir).withColumn("stream_id", F.col("event"))
    serialize(e, base)
    return spark.read.parquet(base).select("event_id", "hw_ts", F.col("stream_id").cast("string").alias("stream_id"))


QUERIES = {
    f.__name__: f
    for f in (
        event_filter, distributor, sample_stats, event_convert, event_to_state, state_changes, event_log, rebuffer, firing_rate, event_sync, event_sync_stateful, as_of_state,
        interleave, first_packets, trigger_one_shot, trigger_level, time_check, level_cross_up, level_cross_down, level_cross_blocked, level_cross_channels, smoother, running_stats,
        running_stats_protected, peaks, ripple, ripple_buckets, burst, spikes, spike_events, spikes_channels, fir, fir_kernel, slope, biquad, multichannel_filter,
        event_delayed_detection, event_delayed_ontime, event_delayed, gap_fill, gap_fill_distributed, digital_state, digital_pulse, throttle, packet_decode, message_unpack,
        message_gaps, source_sine, source_square, source_noise, source_ripple, source_events, graph, closed_loop, graph_events, graph_packets, graph_ripple,
        fir_chunked, level_cross_chunked, rebuffer_chunked, time_check_chunked, streaming_level_cross, serialized,
    )
}
