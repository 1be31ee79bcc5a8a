import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import filters
from rivulet.functions import signal as fs
from rivulet.model import Accepts, StreamInfo
from rivulet.operators import events as ev
from rivulet.operators import kernels as K
from rivulet.operators import packets as pk
from rivulet.operators import signal as sg
from rivulet.plans import pipeline
from rivulet.sources import files, generators


def test_slope_taps():
    ramp = np.arange(20) * 3.0
    taps = filters.slope_taps(4, 1, 1)
    assert math.isclose(sum(t * ramp[15 - k] for k, t in enumerate(taps)), 3.0)
    assert math.isclose(sum(t * ramp[15 - k] for k, t in enumerate(filters.slope_taps(4, 1, 1, causal=False))), -3.0)
    assert math.isclose(sum(t * ramp[15 - k] for k, t in enumerate(filters.slope_taps(4, 2, 0))), ramp[15])
    with pytest.raises(ValueError):
        filters.slope_taps(1, 0, 1)


def test_designs():
    assert math.isclose(sum(filters.lowpass_taps(0.1)), 1) and abs(sum(filters.highpass_taps(0.1))) < 1e-12
    low = K.Biquad(filters.butterworth(0.1, 4))
    assert math.isclose(low.step(low.init(), {"value": np.ones(400)})[1]["filtered"][-1][0], 1, abs_tol=1e-6)
    assert len(filters.impulse_response(K.Fir((1.0, 2.0, 3.0)), 3)) == 3 and filters.impulse_response(K.Fir((1.0, 2.0, 3.0)), 3) == [1, 2, 3]
    band = K.Biquad(filters.bandpass(0.1, 0.02))
    assert len(filters.impulse_response(band)) == 2


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("family", ["butterworth", "chebyshev1", "chebyshev2", "bessel"])
def test_families_of_designs(family, order):
    low, high = filters.iir(family, order, 0.1), filters.iir(family, order, 0.1, "highpass")
    band = filters.iir(family, order, (0.05, 0.2), "bandpass")
    assert math.isclose(filters.response(low, 0), 1, rel_tol=1e-6) and math.isclose(filters.response(high, 0.5), 1, rel_tol=1e-6)
    at_edge = {"butterworth": math.sqrt(0.5), "bessel": math.sqrt(0.5), "chebyshev2": 0.01}.get(family)
    if at_edge:
        assert math.isclose(filters.response(low, 0.1), at_edge, rel_tol=1e-4) and math.isclose(filters.response(high, 0.1), at_edge, rel_tol=1e-4)
        assert math.isclose(filters.response(band, 0.05), at_edge, rel_tol=1e-3) and math.isclose(filters.response(band, 0.2), at_edge, rel_tol=1e-3)
    assert filters.response(low, 0.4) < 0.3 and filters.response(high, 0.01) < 0.3 and filters.response(band, 0.45) < 0.6
    assert all(np.abs(np.roots([1, a1, a2])).max() < 1 for s in (low, high, band) for *_, a1, a2 in s)
    tail = filters.impulse_response(K.Biquad(low), 4000)
    assert abs(sum(tail) - 1) < 1e-3
    if family == "butterworth" and order % 2 == 0:
        assert all(math.isclose(filters.response(low, f), filters.response(filters.butterworth(0.1, order), f), rel_tol=1e-6) for f in (0.03, 0.1, 0.3))


def test_filter_text():
    fir = filters.parse_text("##\n# type = fir\n# format = text\n##\n0.5\n0.25 0.25\n")
    assert fir.taps == (0.5, 0.25, 0.25)
    biquad = filters.parse_text("##\n# type = biquad\n##\n2.0\n1 0 0 1 0 0\n")
    assert biquad.gain == 2 and len(biquad.sections) == 1
    for bad in ("1 2", "##\n# type = x\n##\n1", "##\n# type = fir\n# format = binary\n##\n"):
        with pytest.raises(ValueError):
            filters.parse_text(bad)


def test_functions(spark):
    row = spark.range(1).select(F.array(*map(F.lit, [1.0, -2.0, 3.0])).alias("v"), F.array(*map(F.lit, [5, 3, 6])).alias("w"), F.array(F.lit(True), F.lit(False)).alias("s"))
    got = row.select(
        fs.sample_sum("v"), fs.sample_mean(F.col("v")), fs.sample_sum_abs(F.col("v")), fs.mean_power(F.col("v")), fs.xor_checksum(F.col("w")), fs.bit_is_set(F.lit(5), 2), fs.from_words(F.lit(1), F.lit(-1)),
        fs.from_words(F.lit(-1), F.lit(0)), fs.swap_16(F.lit(0x00080001)), fs.states_text(F.col("s")), fs.set_states(F.col("s"), [1, 7]), fs.set_states(F.col("s"), [0], False), fs.gather(F.col("v"), [2, 2, 0]), fs.sample_mean(F.array().cast("array<double>")),
    ).first()
    assert list(got)[:7] == [2.0, 2 / 3, 6.0, 14 / 3, 0, True, (1 << 32) + 0xFFFFFFFF]
    assert list(got)[7:] == [None, 0x08000100, "10", [True, True], [False, False], [3.0, 3.0, 1.0], None]
    with pytest.raises(ValueError):
        fs.gather(F.col("v"), [])


def test_coincidence_filter_edges(spark):
    t = spark.createDataFrame([("x", 0, 100), ("x", 1, 102), ("x", 0, 200), ("x", 0, 300), ("x", 0, 400), ("y", 0, 100), ("y", 0, None)], "s string, slot int, hw_ts long")
    b = spark.createDataFrame([("x", 190), ("x", 289), ("x", 405)], "s string, hw_ts long")
    keep = lambda **o: sorted((r.s, r.hw_ts) for r in ev.coincidence_filter(t, b, ["s"], **o).collect())
    base = {"sync_us": 3, "block_us": 10, "wait_us": 5}
    # 200 is blocked (10 before, inclusive), 300 is not (11 before); 400 is not (5 after, exclusive).
    assert keep(**base) == [("x", 100), ("x", 102), ("x", 300), ("x", 400), ("y", 100)]
    assert keep(**base | {"wait_us": 6}) == [("x", 100), ("x", 102), ("x", 300), ("y", 100)]
    assert keep(**base, needed=2) == [("x", 102)]
    assert keep(**base | {"sync_us": 2}, needed=2) == []
    assert ev.coincidence_filter(t, b.where("false"), ["s"]).count() == 6


def test_state_joins(spark):
    e = spark.createDataFrame([(1, "u", 5), (2, "u", 10), (3, "v", 10)], "id int, s string, hw_ts long")
    s = spark.createDataFrame([("u", 10, True), ("u", 10, False), ("u", 20, False)], "s string, hw_ts long, enabled boolean")
    assert sorted((r.id, r.enabled) for r in ev.as_of_state(e, s, ["s"]).collect()) == [(1, None), (2, True), (3, None)]


def test_packets(spark):
    body = [2048, 1, 12, 0, 7, 0, 64] + [0] * 10 + [3, -4]
    crc = 0
    for w in body:
        crc ^= w
    raw = np.array([*body, crc], "<i4")
    swapped = raw.view("<u2").byteswap().tobytes()
    df = spark.createDataFrame([(bytearray(raw.tobytes()), bytearray(swapped), [1, 2])], "raw binary, swapped binary, short array<int>")
    same = df.select(pk.words_of(F.col("raw"), 2).alias("words"))
    assert same.first()["words"] == raw.tolist()
    assert df.select(pk.words_of(F.col("swapped"), 2, True).alias("words")).first()["words"] == raw.tolist()
    got = pk.decode(same, 2).first()
    assert (got.error, got.hw_ts, got.digital) == (0, 7, 64) and got["values"] == [3 * fs.MICROVOLTS, -4 * fs.MICROVOLTS]
    assert df.select(pk.error_code(F.col("short"), 2)).first()[0] == 4
    with pytest.raises(ValueError):
        pk.decode(same, 2, [2])


def test_rebuffer_and_rate(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(7)], "s string, hw_ts long, value double")
    assert [r["values"] for r in sg.rebuffer(df, ["s"], ["hw_ts"], 2, 2).collect()] == [[0.0, 2.0], [4.0, 6.0]]
    assert len(sg.rebuffer(df, ["s"], ["hw_ts"], 3, 2, True).collect()) == 2 and sg.auto_size(3, 5) == 1
    spikes = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 5, 3)], "s string, hw_ts long, n_spikes int")
    with pytest.raises(Exception, match="out of step"):
        sg.firing_rate(spikes, ["s"], 10, slots=2).collect()
    assert sg.firing_rate(spikes, ["s"], 10).first().n_spikes == 6
    with pytest.raises(ValueError):
        sg.distribute(df, {"p": []}, 4)


def test_generators(spark):
    assert generators.make(spark, {"class": "square", "rate": 100.0, "frequency": 10.0}, 20).count() == 20
    assert generators.make(spark, {}, 5).count() == 5
    silent = generators.ripple(spark, 400, 8000.0).where("hw_ts < 50000").select(F.max(F.abs(F.get("values", 0)))).first()[0]
    assert silent == 0
    for bad in ({"class": "x"}, {"class": "ripple", "frequency": 10.0}):
        with pytest.raises(ValueError):
            generators.make(spark, bad, 5)


def test_files(spark, tmp_path):
    body = [2048, 1, 11, 0, 9, 0, 0] + [0] * 10 + [5, 0]
    raw = np.array(body * 3, "<i4")
    (tmp_path / "a.bin").write_bytes(raw.tobytes())
    (tmp_path / "b.bin").write_bytes(raw.view("<u2").byteswap().tobytes())
    got = files.read_packets(spark, str(tmp_path / "*.bin"), 1)
    assert got.count() == 6 and got.select("words").distinct().count() == 1
    (tmp_path / "v.txt").write_text("1.5 2\n 3\n")
    assert [r.value for r in files.read_vector(spark, str(tmp_path / "v.txt")).orderBy("position").collect()] == [1.5, 2.0, 3.0]
    (tmp_path / "v.dat").write_bytes(np.array([1.0, 4.0], "<f8").tobytes())
    assert [r.value for r in files.read_vector(spark, str(tmp_path / "v.dat"), "binary").orderBy("position").collect()] == [1.0, 4.0]
    files.serialize(spark.range(3).withColumn("stream_id", F.lit("a")), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.serialize(spark.range(3).withColumn("stream_id", F.lit("a")), str(tmp_path / "out"))
    again = files.cycled(files.read_packets(spark, str(tmp_path / "a.bin"), 1), 4)
    assert sorted(r.arrival for r in again.collect()) == list(range(12))
    made = spark.range(50, numPartitions=3).select((F.lit(49) - F.col("id")).alias("arrival"), F.transform(F.sequence(F.lit(0), F.lit(18)), lambda k: F.when(k == 0, 2048).otherwise(F.lit(49) - F.col("id"))).alias("words"))
    files.write_packets(made, str(tmp_path / "raw"))
    back = files.read_packets(spark, str(tmp_path / "raw" / "*.nrd"), 1).orderBy("path", "arrival").collect()
    assert [r.words[1] for r in back] == list(range(50))


def test_graph_checks(spark):
    assert pipeline.expand("sink(1-3)") == ["sink1", "sink2", "sink3"] and pipeline.expand("a(1,4).x") == ["a1.x", "a4.x"]
    samples = spark.createDataFrame([("a", k, [float(k % 3)]) for k in range(9)], "stream_id string, hw_ts long, values array<double>")
    source = {"in": {"data": pipeline.Port(samples, StreamInfo(nchannels=1))}}
    graph = {"processors": {"x": {"class": "levelcrossing", "options": {"threshold": 1.5, "post detect block": 0}}}, "connections": [["in.data", "x.data"]]}
    assert pipeline.build(graph, source)["x"]["events"].df.count() == 3
    assert pipeline.build(graph, source, {"x": {"threshold": 2.5}})["x"]["events"].df.count() == 0
    with pytest.raises(ValueError, match="no option"):
        pipeline.build(graph, source, {"x": {"treshold": 0.5}})
    with pytest.raises(ValueError, match="unknown operator"):
        pipeline.build({"processors": {"x": {"class": "nothing"}}}, {})
    with pytest.raises(ValueError, match="no port"):
        pipeline.build({"processors": {"x": {"class": "levelcrossing"}}, "connections": [["in.data", "x.dat"]]}, source)
    with pytest.raises(TypeError):
        pipeline.build({"processors": {"c": {"class": "converter"}}, "connections": [["in.data", "c.events"]]}, source)
    with pytest.raises(ValueError, match="cycle"):
        pipeline.build({"processors": {"a": {"class": "converter"}, "b": {"class": "converter"}}, "connections": [["a", "b"], ["b", "a"]]}, {})
    with pytest.raises(ValueError):
        StreamInfo(nchannels=0)
    with pytest.raises(ValueError):
        Accepts(channels=(2, 3)).check(StreamInfo(), "x")


def test_streaming_equals_batch(spark, tmp_path):
    from rivulet.operators.runner import batch
    from rivulet.streaming.runner import stream

    rows = [("a" if k % 3 else "b", k, float((k * 7) % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "s string, t long, value double")
    for part in range(3):
        df.where(f"t div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "s", "t", K.LevelCrossing(2.0, True, 2), ["t"])
    query = live.writeStream.format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    expected = batch(df, "s", ["t"], K.LevelCrossing(2.0, True, 2), ["t"])
    assert sorted(map(tuple, spark.table("crossed").collect())) == sorted(map(tuple, expected.collect()))


def test_udp_source(spark, tmp_path):
    import socket
    import time

    spark.dataSource.register(files.UdpPackets)
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    live = spark.readStream.format("udp_packets").option("port", str(port)).option("nchannels", "2").load()
    query = live.writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "udp")).trigger(processingTime="200 milliseconds").start()
    sender, packet = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), np.arange(20, dtype="<i4").tobytes()
    found = 0
    for _ in range(150):
        sender.sendto(packet, ("127.0.0.1", port))
        sender.sendto(b"short", ("127.0.0.1", port))
        time.sleep(0.2)
        found = spark.table("datagrams").count()
        if found >= 3:
            break
    query.stop()
    assert found >= 3 and {bytes(r.raw) for r in spark.table("datagrams").collect()} == {packet}


def test_udp_offsets_return_and_survive_a_restart(tmp_path):
    import socket
    import threading
    import time

    options = {"port": "0", "nchannels": "2", "batch": "50", "wait": "0.3", "part": "20", "spool": str(tmp_path / "spool")}
    reader = files.UdpReader(options)
    assert reader.latestOffset() == {"n": 0}
    to, packet, stop = reader.socket.getsockname(), np.arange(20, dtype="<i4").tobytes(), threading.Event()

    def flood():
        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        while not stop.is_set():
            s.sendto(packet, to)
            time.sleep(0.001)

    sender = threading.Thread(target=flood)
    sender.start()
    try:
        began = time.monotonic()
        end = reader.latestOffset()
        assert 0 < end["n"] <= 50 and time.monotonic() - began < 2
    finally:
        stop.set()
        sender.join()
    reader.socket.close()
    fresh = files.UdpReader(options)
    assert fresh.seen == end["n"]
    parts = fresh.partitions({"n": 3}, end)
    rows = [row for p in parts for row in fresh.read(p)]
    assert [k for k, _ in rows] == list(range(3, end["n"])) and all(x == packet for _, x in rows) and max(p.n for p in parts) <= 20
    fresh.commit(end)
    assert fresh.partitions({"n": 0}, end) == []


def test_fir_keeps_the_place_of_nulls(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)], "s string, hw_ts long, value double")
    for more in ({}, {"chunk": 2, "block": 2}):
        assert [round(r.filtered, 9) for r in sg.fir(df, (0.5, 0.3, 0.2), ["s"], ["hw_ts"], **more).orderBy("hw_ts").collect()] == [0.5, 0.3, 1.7]


def test_chunks_change_nothing(spark):
    df = spark.range(5000).select(F.lit(0).alias("s"), (F.col("id") * 7 % 5000).alias("hw_ts"), F.sin(F.col("id") * 0.37).alias("value")).withColumn("values", F.array("value"))
    by, order = ["s"], ["hw_ts"]
    same = lambda f, **more: assert_same(f(), f(**more))

    def assert_same(a, b):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))

    same(lambda **m: sg.fir(df, (0.5, 0.25, 0.25), by, order, **m), chunk=333, block=100)
    same(lambda **m: sg.crossings(df, 0.2, by, order, **m), chunk=333, block=100)
    same(lambda **m: sg.rebuffer(df, by, order, 3, 7, **m), chunk=333)
    same(lambda **m: pk.check_times(df.withColumn("arrival", F.col("hw_ts") * 13 % 5000), by, ["arrival"], 2.0, **m), chunk=333)
    assert sg.buffer_size(0.5, 1000.0, 5) == 100
    with pytest.raises(ValueError):
        sg.rebuffer(df, by, order, seconds=1.0)


def test_coincidence_in_one_dense_stream(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(t), int(k), bool(b)) for t, k, b in zip(rng.integers(0, 3000, 400), rng.integers(0, 4, 400), rng.random(400) < 0.1, strict=True)]
    df = spark.createDataFrame(rows, "s int, hw_ts long, slot int, block boolean")
    got = ev.coincidence_filter(df.where("not block"), df.where("block"), ["s"], 20, 15, 6, 2)
    blockers = [t for _, t, _, b in rows if b]
    expected = []
    for _, t, k, b in rows:
        n = len({o for _, u, o, c in rows if not c and t - 20 < u <= t})
        if not b and n >= 2 and not any(t - 15 <= x <= t or t < x < t + 6 for x in blockers):
            expected.append((t, k, n))
    assert sorted((r.hw_ts, r.slot, r.n_slots) for r in got.collect()) == sorted(expected)
    # The number of rows of one stream costs a sort, not their square.
    big = spark.range(200_000).select(F.lit(0).alias("s"), F.col("id").alias("hw_ts"), (F.col("id") % 3).alias("slot"))
    assert ev.coincidence_filter(big, big.where("hw_ts % 1000 = 0"), ["s"], 100_000, 10, 10, 3).count() == 200_000 - 200 * 11 - 199 * 9


def test_graph_states_and_sinks(spark):
    df = spark.createDataFrame([("a", k, "on" if k % 4 == 0 else "off") for k in range(0, 40, 2)], "stream_id string, hw_ts long, event string")
    samples = spark.createDataFrame([("a", k, [float(k * k % 23)]) for k in range(40)], "stream_id string, hw_ts long, values array<double>")
    source = {"e": {"events": pipeline.Port(df, StreamInfo("events"))}, "s": {"data": pipeline.Port(samples, StreamInfo(sample_rate=1.0))}}
    text = """
processors:
  gate: {class: Event2State, options: {target event: 'on'}}
  detector: {class: RippleDetector, options: {threshold dev: 0.5, smooth time: 3, analysis lockout time: 0, statistics downsample factor: 2}}
  counter: {class: DummySink}
  line: {class: SerialOutput}
  pins: {class: DigitalOutput, options: {device: {nchannels: 2}, protocols: {'on': {high: [0]}, 'off': {low: [0]}}}}
  net: {class: ZMQSerializer, options: {interleave: true}}
connections:
  - e.events = gate.events
  - s.data = detector.data
  - s.data = counter.data
  - e.events = line.events
  - e.events = pins.events
  - e.events = net.data
  - s.data = net.data
states:
  - [gate.enabled, detector.detection enabled]
"""
    out = pipeline.build(text, source)
    on = lambda t: t // 2 * 2 % 4 == 0
    assert all(on(r.hw_ts) for r in out["detector"]["events"].df.collect())
    shown = [r.hw_ts for r in out["detector"]["statistics"].df.orderBy("hw_ts").collect()]
    assert shown == list(range(3, 40, 2))  # nothing off the cadence, whatever has fired
    (count,) = out["counter"]["counts"].df.collect()
    assert (count.n, count.first_ts, count.last_ts, count.rate) == (40, 0, 39, 1e6)
    assert out["line"]["messages"].df.count() == 20 and out["pins"]["states"].df.where("state[0]").count() == 10
    assert out["net"]["data"].df.groupBy("slot").count().orderBy("slot").collect()[1]["count"] == 40


def test_trigger_in_full():
    t = {"hw_ts": np.array([0, 10, 60, 100, 130, 200]), "delay": np.array([20, 20, 20, 20, 20, 20])}
    run = lambda k: k.step(k.init(), t)[1]
    from rivulet.operators import kernels as K

    assert run(K.Delayed("ontime", 50))["at"] == [0, 60, 130, 200]
    assert run(K.Delayed("ontime", 0, after_stimulation=False, analysis=15, offsets=(0,)))["at"] == [0, 60, 100, 130, 200]
    # Two windows, one right after the stimulation and one later.
    assert run(K.Delayed("ontime", 0, after_stimulation=False, analysis=15, offsets=(0, 55)))["at"] == [0, 100, 130, 200]
    late = run(K.Delayed("delayed", 50))
    assert list(zip(late["at"], late["message"], strict=True)) == [(0, "r"), (20, "d"), (60, "r"), (80, "d"), (130, "r"), (150, "d"), (200, "r"), (220, "d")][: len(late["at"])] or late["message"].count("d") == 4
    only = run(K.Delayed("detection", 50, after_detection=True))
    assert only == {"at": [0, 60, 130, 200], "message": ["r"] * 4}
    with pytest.raises(ValueError):
        K.Delayed(lockout=-1)


def test_in_order_waits_for_late_rows(spark, tmp_path):
    from rivulet.operators import kernels as K
    from rivulet.streaming.runner import in_order, stateful

    schema = "k int, ts timestamp, hw_ts long, value double"
    batches = [[0, 1, 4], [3, 2, 9], [6, 40], [5, 41], [90]]  # 5 comes after the watermark has passed it
    for n, rows in enumerate(batches):
        table = spark.createDataFrame([(1, t, float(t % 3)) for t in rows], "k int, hw_ts long, value double").withColumn("ts", F.timestamp_seconds(F.col("hw_ts") + 1000))
        table.select("k", "ts", "hw_ts", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    with stateful(spark):
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = in_order(live, "k", "ts", ["hw_ts"], K.Smoother(0.5), ["hw_ts"], "10 seconds")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(r.hw_ts, r.smooth) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("hw_ts").collect()]
    v, expected = 0.0, []
    for t in (0, 1, 2, 3, 4, 6, 9, 40, 41):
        v = 0.5 * (t % 3) + 0.5 * v
        expected.append((t, v))
    assert got == expected[: len(got)] and len(got) >= 7


def message(samples, n_channels, n_samples, ts, number, rate):
    """A serialized message: root offset, list of fields, table, vector."""
    import struct

    fields = struct.pack("<8H", 16, 36, 4, 8, 12, 16, 24, 32)
    table = 4 + len(fields)
    body = struct.pack("<iIIIQQI", table - 4, 36 - 4, n_channels, n_samples, ts, number, rate)
    return struct.pack("<I", table) + fields + body + struct.pack(f"<I{len(samples)}f", len(samples), *samples)


def test_serialized_messages(spark):
    good = message([1.5, 2.5, 3.5, 4.5, 5.5, 6.5], 2, 3, 1 << 40, 7, 30_000)
    df = spark.createDataFrame([("a", bytearray(good)), ("a", bytearray(good[:20])), ("a", bytearray(b"")), ("a", None), ("a", bytearray(b"\xff" * 60))], "stream_id string, data binary")
    (row,) = pk.read_messages(df, "data", "stream_id").collect()
    assert (row.samples, row.n_channels, row.n_samples, row.ts, row.message_id, row.sample_rate) == ([1.5, 2.5, 3.5, 4.5, 5.5, 6.5], 2, 3, 1 << 40, 7, 30_000)
    out = pk.unpack_messages(pk.read_messages(df, "data", "stream_id"), 2).orderBy("i").collect()
    assert [(r.hw_ts - (1 << 40), r["values"]) for r in out] == [(0, [1.5, 4.5]), (1, [2.5, 5.5]), (2, [3.5, 6.5])]


def test_replay_is_paced(spark, tmp_path):
    import time

    table = spark.range(3).select(F.col("id").alias("arrival"), (F.col("id") * 10).alias("hw_ts"))
    query = files.replayed(table, 20, cycle=True).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "replay")).start()
    for _ in range(100):
        time.sleep(0.3)
        rows = spark.table("replayed").orderBy("arrival").collect()
        if len(rows) >= 7:
            break
    query.stop()
    assert len(rows) >= 7 and [r.hw_ts for r in rows] == [10 * (k % 3) for k in range(len(rows))]


def test_filters_are_timed():
    assert 0 < filters.microseconds_a_sample(K.Fir((0.5, 0.5)), 10_000) < 100
