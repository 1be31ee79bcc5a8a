"""The operators of graphs, each by its own name and by the class name that graph files use."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import filters
from rivulet.model import Accepts, StreamInfo
from rivulet.operators import events as E
from rivulet.operators import kernels as K
from rivulet.operators import packets as P
from rivulet.operators import runner
from rivulet.operators import signal as S
from rivulet.plans.pipeline import Context, Loop, Port, operator
from rivulet.sources import generators

EVENTS, ANY = Accepts("events"), Accepts("any")


def us(milliseconds: float) -> int:
    return round(1000 * milliseconds)


def run(port: Port, kernel: K.Kernel, keep=("hw_ts",), df: DataFrame | None = None) -> DataFrame:
    source = port.df if df is None else df
    source = source if "value" in source.columns or "values" not in source.columns else source.withColumn("value", F.col("values"))
    return runner.batch(source, port.key, port.order, kernel, dict.fromkeys([*keep, *port.order]))


def with_filter(port: Port, kernel: K.Kernel) -> tuple[Port, K.Kernel]:
    """The stream and kernel that give the same as this kernel on this port. A filter before it becomes a part of the kernel:
    samples are then dealt and handed over once for both."""
    if port.filtered is None:
        return port, kernel
    source, first = port.filtered
    return source, K.Chain(first, kernel)


def events_port(df: DataFrame, like: Port) -> Port:
    return Port(df.select(like.key, "hw_ts", "event"), StreamInfo("events"), like.key, ("hw_ts",))


# Sources. Packets and messages come in by the port `feed`, from files or a streaming source.


def _fed(c: Context) -> Port:
    if "feed" not in c.inputs:
        raise ValueError(f"{c.name} reads from outside: give its packets as the source {c.name}.feed")
    return c.one("feed")


def _first(df: DataFrame, n: int, port: Port) -> DataFrame:
    """The first n valid packets of each stream; 0 means all."""
    return S.numbered(df, [port.key], port.order, name="_n").where(F.col("_n") < n).drop("_n") if n else df


@operator("purereader", "NlxPureReader", options={"npackets": 0, "nchannels": 128})
def _pure(c: Context):
    """Packets of the right size, and how many others there were."""
    p = _fed(c)
    right = F.coalesce(F.size("words") == P.HEADER + 1 + c["nchannels"], F.lit(False))
    kept = _first(p.df.where(right), c["npackets"], p)
    invalid = p.df.groupBy(p.key).agg(F.count_if(~right).alias("n_invalid"))
    return {"udp": Port(kept, StreamInfo("packets", c["nchannels"], 1, 32_000.0), p.key, p.order), "invalid": Port(invalid, StreamInfo("counts"), p.key, ())}


@operator("parser", "NlxParser", options={"batch size": 2, "trigger": {"enabled": False, "channel": 0}, "gap fill": "asap"}, udp=Accepts("packets"))
def _parser(c: Context):
    """Valid packets as samples (data) and digital words (ttl), with gaps filled; n_invalid by code; whole batches only."""
    p = c.one("udp")
    out = P.parse(p.df, p.info.nchannels, [p.key], p.order, c["batch size"], c["gap fill"], c["trigger"]["channel"] if c["trigger"]["enabled"] else None)
    info, order = p.info.with_(kind="samples", nsamples=c["batch size"]), (*p.order, "copy")
    return {
        "data": Port(out["data"], info, p.key, order), "ttl": Port(out["data"].select(p.key, *order, "hw_ts", F.array(F.col("digital").cast("double")).alias("values")), info.with_(nchannels=1), p.key, order),
        "invalid": Port(out["invalid"], StreamInfo("counts"), p.key, ()),
    }


@operator("reader", "NlxReader", options={"channelmap": None, "npackets": 0, "batch size": 1, "nchannels": 128, "trigger": {"enabled": False, "channel": 0}, "hardware trigger channel": 0})
def _reader(c: Context):
    """Valid packets by a channel map: a port for each of its keys. The trigger is a level: it gates every packet."""
    p = _fed(c)
    if not c["channelmap"]:
        raise ValueError(f"{c.name} needs a channel map")
    named = {str(k): list(v) for k, v in c["channelmap"].items()}
    decoded = P.decode(p.df, c["nchannels"]).where("error = 0")
    if c["trigger"]["enabled"]:
        decoded = E.level_gate(decoded, P.S.bit_is_set(F.col("digital"), c["trigger"]["channel"]))
    decoded = _first(decoded.select(*dict.fromkeys([p.key, *p.order, "hw_ts", "values"])), c["npackets"], p)
    made = S.distribute(decoded, named, c["nchannels"])
    return {k: Port(df, StreamInfo("samples", len(named[k]), c["batch size"], 32_000.0), p.key, p.order) for k, df in made.items()}


@operator("messages", "OpenEphysZMQ", options={"npackets": 0, "batch size": 1, "nchannels": 384})
def _messages(c: Context):
    p = _fed(c)
    df = P.unpack_messages(_first(p.df, c["npackets"], p), c["nchannels"])
    order = tuple(o if o in df.columns else "message_id" for o in p.order)
    return {"data": Port(df, StreamInfo("samples", c["nchannels"], c["batch size"]), p.key, (*dict.fromkeys((*order, "i")),)), "gaps": Port(P.message_gaps(p.df, [p.key]), StreamInfo("counts"), p.key, ())}


@operator("eventsource", "EventSource", options={"events": "none", "rate": 1.0, "seed": 0})
def _eventsource(c: Context):
    if c.spark is None or c.seconds is None:
        raise ValueError(f"{c.name} needs a session and the seconds to run for")
    names = c["events"] if isinstance(c["events"], list) else [c["events"]]
    made = generators.random_events(c.spark, max(0, int(c.seconds * 1_000_000) // (int(1000 / c["rate"]) * 1000)), names, c["rate"], c["seed"])
    return {"events": Port(made.withColumn("stream_id", F.lit(0)), StreamInfo("events"))}


# Signals.


@operator("distributor", "Distributor", options={"channelmap": None}, data=Accepts())
def _distributor(c: Context):
    p = c.one("data")
    named = {str(k): list(v) for k, v in (c["channelmap"] or {}).items()}
    made = S.distribute(p.df, named, p.info.nchannels)
    return {k: Port(df, p.info.with_(nchannels=len(named[k])), p.key, p.order) for k, df in made.items()}


@operator("filter", "MultiChannelFilter", options={"filter": {}}, data=Accepts(channels=(1, 384)))
def _filter(c: Context):
    p = c.one("data")
    source, kernel = with_filter(p, filters.from_spec(c["filter"]))
    out = run(source, kernel).withColumnRenamed("filtered", "values")
    return {"data": Port(out, p.info, p.key, p.order, (source, kernel))}


@operator("rebuffer", "Rebuffer", options={"downsample factor": 1, "buffer size": 0}, data=Accepts(channels=(1, 256)))
def _rebuffer(c: Context):
    """Every k-th sample; a buffer's size is in samples, in seconds (`0.5 s`), or 0 for what its input gives. Samples of a
    last partial buffer are dropped."""
    p, factor, size = c.one("data"), c["downsample factor"], c["buffer size"]
    if isinstance(size, str):
        number, _, unit = size.strip().partition(" ")
        if unit not in ("s", "ms", "samples"):
            raise ValueError(f"a buffer of {size!r} is neither in samples nor in seconds")
        size = int(number) if unit == "samples" else S.buffer_size(float(number) * (1.0 if unit == "s" else 1e-3), p.info.sample_rate, factor)
    size = size or S.auto_size(p.info.nsamples, factor)
    out = S.rebuffer_rows(p.df, [p.key], p.order, factor, size)
    return {"data": Port(out, p.info.with_(nsamples=size, sample_rate=p.info.sample_rate / factor), p.key, p.order)}


@operator("runningstats", "RunningStats", options={"integration time": 1.0, "outlier": {"protection": False, "zscore": 6.0, "half life": 2.0}}, data=Accepts(channels=(1, 256)))
def _runningstats(c: Context):
    p, o = c.one("data"), c["outlier"]
    n = max(1, int(c["integration time"] * p.info.sample_rate))
    out = run(*with_filter(p, K.RunningStats(1 / n, n, o["zscore"] if o["protection"] else None, o["half life"])))
    return {"data": Port(out.select(p.key, *dict.fromkeys((*p.order, "hw_ts")), F.array("center", "dispersion").alias("values")), p.info.with_(nchannels=2), p.key, p.order)}


@operator("levelcrossing", "LevelCrossingDetector", options={"threshold": 0.0, "upslope": True, "post detect block": 2, "event": "threshold_crossing"}, data=Accepts(channels=(1, 256)))
def _levels(c: Context):
    p = c.one("data")
    out = run(*with_filter(p, K.LevelCrossing(c["threshold"], c["upslope"], c["post detect block"])))
    return {"events": events_port(out.withColumn("event", F.lit(c["event"])), p)}


DETECTOR = {"threshold dev": 6.0, "smooth time": 10.0, "analysis lockout time": 30.0, "detection lockout time": None, "stream events": True, "stream statistics": True, "statistics downsample factor": 1, "use power": True}


def _oscillation(c: Context, p: Port, rate: float, power: bool, gated: bool = False) -> K.Oscillation:
    lockout = c["analysis lockout time"] if c["detection lockout time"] is None else c["detection lockout time"]
    return K.Oscillation(c["threshold dev"], c["smooth time"], lockout, rate, p.info.nsamples if p.info.kind == "samples" else 1, power, c["statistics downsample factor"], gated)


def _detections(c: Context, p: Port, out: DataFrame, event: str) -> dict[str, Port]:
    ports = {}
    if c["stream events"]:
        ports["events"] = events_port(out.where("detected").withColumn("event", F.lit(event)), p)
    if c["stream statistics"]:
        ports["statistics"] = Port(out.where("shown").select(p.key, "hw_ts", "test_value", "threshold"), StreamInfo("statistics"), p.key, ("hw_ts",))
    return ports


@operator("ripple", "RippleDetector", options=DETECTOR, data=Accepts(channels=(1, 256)))
def _ripple(c: Context):
    p = c.one("data")
    source, kernel = with_filter(p, _oscillation(c, p, p.info.sample_rate, c["use power"], c.enabled is not None))
    df = source.df
    if c.enabled is not None:  # off until the state is first set on
        df = E.as_of_state(df, c.enabled.df.select(p.key, "hw_ts", "enabled"), [p.key]).withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    out = run(source, kernel, df=df)
    return _detections(c, p, out, "ripple")


@operator("burst", "BurstDetector", options={k: v for k, v in DETECTOR.items() if k != "use power"}, data=Accepts("mua"))
def _burst(c: Context):
    p = c.one("data")
    out = run(p, _oscillation(c, p, p.info.sample_rate, False), df=p.df.withColumn("value", F.col("mua")))
    return _detections(c, p, out, "burst")


@operator("spike", "SpikeDetector", options={"threshold": 60.0, "invert signal": True, "buffer size": 0.5, "peak lifetime": 8}, data=Accepts(channels=(1, 8)))
def _spike(c: Context):
    """spikes: one row for each, with its buffer; events: spike or spikes for each buffer that has some."""
    p = c.one("data")
    out = run(*with_filter(p, K.Spike(c["threshold"], c["invert signal"], c["peak lifetime"])))
    found = out.select(p.key, F.floor(F.col("spike_ts") / us(c["buffer size"])).cast("long").alias("buffer"), F.col("spike_ts").alias("hw_ts"), "amplitudes")
    return {"spikes": Port(found, StreamInfo("spikes", p.info.nchannels), p.key, ("hw_ts",)), "events": events_port(S.spike_events(found, [p.key, "buffer"]), p)}


@operator("mua", "MUAEstimator", options={"bin size": 10.0}, spikes=Accepts("spikes"))
def _mua(c: Context):
    found = c.inputs.get("spikes", [])
    if not found:
        raise ValueError(f"{c.name}: port spikes takes one stream or more")
    p = found[0]
    every = p.df.select(p.key, "hw_ts")
    for other in found[1:]:
        every = every.union(other.df.select(p.key, "hw_ts"))
    out = S.firing_rate(every.withColumn("n_spikes", F.lit(1)), [p.key], us(c["bin size"]))
    return {"mua": Port(out.withColumn("hw_ts", F.col("bin_start")), StreamInfo("mua", sample_rate=1000 / c["bin size"]), p.key, ("hw_ts",))}


# Events.


@operator("converter", "EventConverter", options={"event name": "stimulation", "replace": True}, events=EVENTS)
def _converter(c: Context):
    p = c.one("events")
    return {"events": Port(E.convert(p.df, c["event name"], c["replace"]), p.info, p.key, p.order)}


@operator("event2state", "Event2State", options={"target event": "none"}, events=EVENTS)
def _event2state(c: Context):
    p = c.inputs["events"][0]
    made = E.to_state(p.df, c["target event"])
    return {"events": events_port(made, p), "states": Port(made.select(p.key, "hw_ts", "enabled"), StreamInfo("states"), p.key, p.order)}


def _slots(c: Context, port: str) -> DataFrame | None:
    """All streams of a port with the number of their slot."""
    out = None
    for k, p in enumerate(c.inputs.get(port, [])):
        one = p.df.select(F.col(p.key).alias("stream_id"), "hw_ts", "event").withColumn("slot", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@operator("eventsync", "EventSync", options={"target event": "none"}, events=EVENTS)
def _eventsync(c: Context):
    """The k-th events of all slots are a round; one in which all are the target is an event at its latest time."""
    every = _slots(c, "events").withColumn("serial", F.col("event"))
    out = E.sync_rounds(every, F.col("event") == c["target event"], len(c.inputs["events"]), ["stream_id"])
    return {"events": Port(out.select("stream_id", F.col("at").alias("hw_ts"), F.lit(c["target event"]).alias("event")), StreamInfo("events"))}


FILTER = {"target event": "none", "block duration": 10.0, "block wait time": 1.5, "sync time": 3.5, "detection criterion": 1}


def _criterion(c: Context, slots: int) -> int:
    return {"any": 1, "all": slots}.get(c["detection criterion"], c["detection criterion"])


@operator("eventfilter", "EventFilter", options=FILTER, events=EVENTS, blocking_events=EVENTS)
def _eventfilter(c: Context):
    targets = _slots(c, "events").where(F.col("event") == c["target event"])
    blockers = _slots(c, "blocking events")
    blockers = targets.where("false") if blockers is None else blockers.where(F.col("event") == c["target event"])
    needed = _criterion(c, len(c.inputs["events"]))
    if needed not in range(1, len(c.inputs["events"]) + 1):
        raise ValueError(f"{c.name}: {needed} of {len(c.inputs['events'])} slots can't be asked for")
    out = E.coincidence_filter(targets, blockers, ["stream_id"], us(c["sync time"]), us(c["block duration"]), us(c["block wait time"]), needed)
    return {"events": Port(out.select("stream_id", "hw_ts", "event"), StreamInfo("events"))}


DELAYED = {
    "detection only mode": False, "delayed mode": False, "delayed range": [150, 200], "event trigger lockout time": {"period": 50.0, "detection": False, "stimulation": True},
    "analysis lockout time": {"period": 50.0, "starting time": [0]}, "message": {"detection": "r", "delayed": "d", "ontime": "o"}, "seed": 0, "saving events": None, "prefix": None,
}


def _trigger(c: Context) -> K.Delayed:
    mode = "detection" if c["detection only mode"] else "delayed" if c["delayed mode"] else "ontime"
    lockout, analysis, said = c["event trigger lockout time"], c["analysis lockout time"], c["message"]
    offsets = tuple(us(x) for x in dict.fromkeys(analysis["starting time"]))
    return K.Delayed(mode, us(lockout["period"]), lockout["stimulation"], lockout["detection"], us(analysis["period"]), offsets, said["detection"], said["ontime"], said["delayed"])


def _wait(c: Context):
    """A uniform delay in whole milliseconds by a hash of the event's time, in microseconds."""
    low, high = c["delayed range"]
    return (F.lit(low) + F.pmod(F.xxhash64("hw_ts", F.lit(c["seed"])), F.lit(max(1, high - low + 1)))) * 1000


@operator("delayed", "EventDelayed", options=DELAYED, events=EVENTS)
def _delayed(c: Context):
    """events: the messages; serials: the number of the detection that each message goes with."""
    p = c.one("events")
    df = S.numbered(p.df.withColumn("delay", _wait(c)), [p.key], ("hw_ts",), name="serial")
    out = run(p, _trigger(c), ("hw_ts", "serial"), df)
    messages = out.select(p.key, F.col("at").alias("hw_ts"), F.col("message").alias("event"))
    return {"events": Port(messages, p.info, p.key, ("hw_ts",)), "serials": Port(out.select(p.key, "message", "serial"), StreamInfo("counts"), p.key, ())}


# Sinks. Each is a table of what it would write; files are written by `write`.


@operator("logger", "EventLogger", options={"target event": "none"}, events=EVENTS)
def _logger(c: Context):
    p = c.one("events")
    return {"counts": Port(E.log(p.df, c["target event"], [p.key]), StreamInfo("counts"), p.key, ())}


@operator("digitaloutput", "DigitalOutput", options={"pulse width": 400, "device": {"type": "dummy", "nchannels": 16}, "protocols": {}, "enabled": True}, events=EVENTS)
def _digital(c: Context):
    p = c.one("events")
    out = run(p, K.DigitalState({k: dict(v) for k, v in c["protocols"].items()}, c["device"]["nchannels"], c["pulse width"]), df=p.df)
    return {"states": Port(out.select(p.key, F.col("at").alias("hw_ts"), "state"), StreamInfo("states"), p.key, ("hw_ts",))}


@operator("serialoutput", "SerialOutput", events=EVENTS)
def _serial(c: Context):
    """Messages as a serial line would get them: one a row, by slot."""
    return {"messages": Port(_slots(c, "events").select("stream_id", "slot", "hw_ts", F.col("event").alias("message")), StreamInfo("messages"))}


@operator("dummysink", "DummySink", data=ANY)
def _dummy(c: Context):
    """Number of packets, first and last time, and packets a second."""
    p = c.one("data")
    out = p.df.groupBy(p.key).agg(F.count(F.lit(1)).alias("n"), F.min("hw_ts").alias("first_ts"), F.max("hw_ts").alias("last_ts"))
    return {"counts": Port(out.withColumn("rate", F.when(F.col("last_ts") > F.col("first_ts"), (F.col("n") - 1) * 1e6 / (F.col("last_ts") - F.col("first_ts")))), StreamInfo("counts"), p.key, ())}


def _as_given(c: Context) -> dict[str, Port]:
    """Each slot's rows."""
    return {str(k): p for k, p in enumerate(c.inputs.get("data", []))}


@operator("fileserializer", "FileSerializer", options={"path": None, "encoding": "binary", "format": "full", "overwrite": False, "throttle": {"enabled": False, "threshold": 0.3, "smooth": 0.5}}, data=ANY)
def _files(c: Context):
    if c["throttle"]["enabled"]:
        raise ValueError("rows are not shed by a sink; use the throttle kernel, or a streaming source's own limits")
    return _as_given(c)


@operator("zmqserializer", "ZMQSerializer", options={"encoding": "binary", "format": "full", "interleave": False}, data=ANY)
def _published(c: Context):
    """A stream for each slot, or one of all slots' rows as JSON by time."""
    if not c["interleave"]:
        return _as_given(c)
    rows = [p.df.select(F.col(p.key).alias("stream_id"), "hw_ts", F.to_json(F.struct(*p.df.columns)).alias("packet")) for p in c.inputs["data"]]
    return {"data": Port(E.interleave(*rows, name="slot"), StreamInfo("messages"), "stream_id", ("hw_ts", "slot"))}


def write(built: dict[str, dict[str, Port]], graph: dict, folder: str, form: str = "parquet") -> list[str]:
    """Writes the slots of a graph's file sinks, one folder each, and returns the folders. Existing ones are an error unless
    the sink may overwrite."""
    from rivulet.plans.pipeline import expand

    out = []
    for raw, spec in graph["processors"].items():
        if spec["class"] not in ("fileserializer", "FileSerializer"):
            continue
        for name in expand(raw):
            for slot, p in built[name].items():
                out.append(f"{folder.rstrip('/')}/{name.replace(' ', '_')}.{slot}")
                p.df.write.mode("overwrite" if (spec.get("options") or {}).get("overwrite") else "errorifexists").format(form).save(out[-1])
    return out


# Feedback.


@dataclass
class LoopKernel(K.Kernel):
    """Detector, filter and trigger in one kernel, for graphs where the trigger's analysis windows switch the detector off.

    Such a cycle has no order of operators: each sample is detected with the state that the messages before it have left.
    `blocked` says whether a detection at a sample's time would be filtered out.
    """

    detector: K.Oscillation = field(default_factory=K.Oscillation)
    trigger: K.Delayed = field(default_factory=K.Delayed)
    reads = ("value", "hw_ts", "delay", "blocked")
    returns = "at long, message string, detected boolean, passed boolean, shown boolean, test_value double, threshold double"

    def init(self):
        return SimpleNamespace(detector=self.detector.init(), trigger=self.trigger.init())

    def step(self, state, columns):
        rows, out = [], {"at": [], "message": [], "detected": [], "passed": [], "shown": [], "test_value": [], "threshold": []}

        def tell(k, at=None, message=None, detected=False, passed=False, shown=False, test=None, threshold=None) -> None:
            rows.append(k)
            for x, y in zip(out.values(), (at, message, detected, passed, shown, test, threshold), strict=True):
                x.append(y)

        for k, (t, v, blocked) in enumerate(zip(columns["hw_ts"].tolist(), self.detector.levels(columns["value"]), columns["blocked"].tolist(), strict=True)):
            found = self.detector.one(state.detector, v, not self.trigger.off(state.trigger, t))
            if found is None:
                continue
            test, threshold, fired, _, show = found
            passed = fired and not blocked
            tell(k, detected=fired, passed=passed, shown=show, test=test, threshold=threshold)
            if passed:
                _, told = self.trigger.step(state.trigger, {c: columns[c][k : k + 1] for c in ("hw_ts", "delay")})
                for at, message in zip(told["at"], told["message"], strict=True):
                    tell(k, at, message)
        return rows, out


def closed_loop(loop: Loop, parts: dict[str, Context]) -> dict[str, dict[str, Port]]:
    """The outputs of the loop's processors."""
    d, t = parts[loop.detector], parts[loop.trigger]
    p = d.one("data")
    source, kernel = with_filter(p, LoopKernel(_oscillation(d, p, p.info.sample_rate, d["use power"]), _trigger(t)))
    df = source.df.withColumn("delay", _wait(t)).withColumn("blocked", F.lit(False))
    if loop.filter:
        f = parts[loop.filter]
        if f.inputs.get("events") or f["target event"] not in ("ripple",):
            raise ValueError("in a loop a filter takes the detector's events only")
        blockers = _slots(f, "blocking events")
        if blockers is not None:
            # A detection is on a slot of its own within any time that is not zero.
            found = blockers.where("event = 'ripple'").select(F.col("stream_id").alias(p.key), "hw_ts")
            free = E.unblocked(df, found, [p.key], us(f["block duration"]), us(f["block wait time"]), "_free")
            df = free.withColumn("blocked", ~F.col("_free") if us(f["sync time"]) > 0 else F.lit(True)).drop("_free")
    out = run(source, kernel, df=df)
    made = {loop.detector: _detections(d, p, out, "ripple"), loop.trigger: {"events": events_port(out.where("message is not null").select(p.key, F.col("at").alias("hw_ts"), F.col("message").alias("event")), p)}}
    if loop.filter:
        made[loop.filter] = {"events": events_port(out.where("passed").withColumn("event", F.lit("ripple")), p)}
    return made
