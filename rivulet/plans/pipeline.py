"""Graphs of named operators, from a dict or YAML text, as one lazy plan.

{"processors": {name: {"class": ..., "options": {...}}}, "connections": [...], "states": [...]}. A connection is
`from = to` or [from, to]; an end is `name`, `name.port` or `name.port.slot`, or parts marked `p:port`, `f:name` and `s:slot`
in any order. Names like `sink(1-3)` stand for several; ranges on both ends of a connection pair up. A state pair lets one
processor's state switch another: an event state switches a detector as of its time; a trigger that switches the detector
before it closes a loop, and detector, filter and trigger then become one kernel.

Streams are checked against what an input takes before anything is built, and so are options: an unknown one fails. What
concerns acquisition hardware, threads or logs only (addresses, priorities, intervals of messages) is taken and has no effect.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rivulet.model import Accepts, StreamInfo
from rivulet.operators.kernels import Kernel


def expand(name: str) -> list[str]:
    """source(1-3) is source1, source2, source3; lists (1,4) too."""
    m = re.fullmatch(r"([^()]*?)\s*\(([^()]*)\)(.*)", name)
    if not m:
        return [name.strip()]
    numbers: list[int] = []
    for part in m[2].split(","):
        a, _, b = part.strip().partition("-")
        numbers += range(int(a), int(b or a) + 1)
    return [f"{m[1].strip()}{k}{m[3].strip()}" for k in numbers]


@dataclass
class Port:
    """A stream with its description. key tells streams apart; order is their order in time.

    filtered: for a filter's output, the stream it takes and its kernel, so that a kernel after it can run in the same pass.
    """

    df: DataFrame
    info: StreamInfo
    key: str = "stream_id"
    order: tuple[str, ...] = ("hw_ts",)
    filtered: tuple[Port, Kernel] | None = None


@dataclass
class Context:
    """What a processor is built from: its inputs by port, its options, the session and the seconds of generated sources."""

    inputs: dict[str, list[Port]]
    options: dict
    spark: SparkSession | None = None
    seconds: float | None = None
    name: str = ""
    #: State rows (key, hw_ts, enabled) that switch this processor, if any.
    enabled: Port | None = None

    def one(self, port: str) -> Port:
        if len(self.inputs.get(port, [])) != 1:
            raise ValueError(f"{self.name}: port {port} takes one stream")
        return self.inputs[port][0]

    def __getitem__(self, option: str):
        return self.options[option]


@dataclass
class Operator:
    takes: dict[str, Accepts]
    options: dict
    build: Callable[[Context], dict[str, Port]]


OPERATORS: dict[str, Operator] = {}
#: Options of any processor that have no effect on results.
IDLE = {"address": None, "port": None, "update interval": None, "discard warnings": None, "event logging": None, "port address": None, "baud rate": None, "statistics buffer size": None, "strict time bin check": None}


def operator(*names: str, options: dict | None = None, **takes: Accepts):
    """Registers an operator under its names: build(context) returns outputs by port. options: their defaults, by name; a
    nested dict holds an option's parts."""

    def register(build):
        for name in names:
            OPERATORS[name] = Operator({k.replace("_", " "): v for k, v in takes.items()}, options or {}, build)
        return build

    return register


def options_of(name: str, known: dict, given: dict) -> dict:
    """The defaults under what is given. `a/b` stands for part b of a; underscores are spaces."""
    out = {k: dict(v) if isinstance(v, dict) and v else v for k, v in known.items()}
    for raw, value in (given or {}).items():
        key, _, part = str(raw).replace("_", " ").partition("/")
        if part:
            value = {part: value}
        if key not in known:
            if key in IDLE:
                continue
            raise ValueError(f"{name} has no option {raw!r}")
        if isinstance(known[key], dict) and known[key]:
            out[key] = options_of(f"{name}: {key}", out[key], value)
        else:
            out[key] = value
    return out


def _overlaid(options: dict, more: dict) -> dict:
    return {k: _overlaid(options[k], more[k]) if isinstance(options.get(k), dict) and isinstance(more.get(k), dict) else more.get(k, options.get(k)) for k in {**options, **more}}


def load(text: str) -> dict:
    """A graph from YAML text."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading graphs from YAML needs a YAML parser; pass a dict instead") from e
    graph = yaml.safe_load(text)
    if not isinstance(graph, dict) or "processors" not in graph:
        raise ValueError("a graph has processors")
    return graph


@dataclass(frozen=True)
class End:
    name: str
    port: str = ""
    slot: str = ""


def end_of(text: str) -> End:
    """name.port.slot, or parts marked f: (or n:), p: and s: in any order."""
    parts = [p.strip() for p in re.split(r"\.", text)]
    marked = {p[:2]: p[2:].strip() for p in parts if re.match(r"[fnps]:", p)}
    plain = [p for p in parts if not re.match(r"[fnps]:", p)]
    name = marked.get("f:") or marked.get("n:") or (plain.pop(0) if plain else "")
    port = marked.get("p:") or (plain.pop(0) if plain else "")
    return End(name, port.replace("_", " "), marked.get("s:") or (plain.pop(0) if plain else ""))


def edges_of(graph: dict) -> list[tuple[End, End]]:
    edges = []
    for c in graph.get("connections") or []:
        a, b = c.split("=") if isinstance(c, str) else c
        left, right = expand(a), expand(b)
        if len(left) != len(right) and 1 not in (len(left), len(right)):
            raise ValueError(f"{a} and {b} do not pair up")
        n = max(len(left), len(right))
        edges += [(end_of(x), end_of(y)) for x, y in zip(left * (n if len(left) == 1 else 1), right * (n if len(right) == 1 else 1), strict=True)]
    return edges


@dataclass
class Loop:
    """Processors that one feedback binds together: a detector, its trigger, and the filter between them, if any."""

    detector: str
    trigger: str
    filter: str | None = None
    members: set = field(default_factory=set)


def loops_of(graph: dict, edges: list[tuple[End, End]], kinds: dict[str, str]) -> tuple[list[Loop], dict[str, str]]:
    """Feedback loops, and which processor's state switches which other one."""
    loops, switched = [], {}
    for pair in graph.get("states") or []:
        (source, said), (target, asked) = (tuple(x.strip() for x in p.split(".", 1)) for p in pair)
        if asked != "detection enabled" or said not in ("analysis enabled", "enabled"):
            raise ValueError(f"state {said!r} of {source} does not switch {asked!r} of {target}")
        if said == "enabled":
            switched[target] = source
            continue
        after = {b.name for a, b in edges if a.name == target and kinds.get(b.name) in ("EventDelayed", "EventFilter", "delayed", "eventfilter") and b.port in ("", "events")}
        between = [n for n in after if n != source and any(a.name == n and b.name == source for a, b in edges)]
        if source not in after and len(between) != 1:
            raise ValueError(f"no way from {target} to {source} that could be one kernel")
        middle = None if source in after else between[0]
        loops.append(Loop(target, source, middle, {target, source} | ({middle} if middle else set())))
    return loops, switched


def build(graph: dict | str, sources: dict[str, dict[str, Port]] | None = None, overrides: dict | None = None, spark: SparkSession | None = None, seconds: float | None = None) -> dict[str, dict[str, Port]]:
    """Outputs of every processor, by name and port.

    sources: outputs of processors that the graph does not define; for one that reads from outside (packets, messages) its
    port `feed`. seconds: how long generated sources run. overrides: options laid over the graph's, by processor.
    """
    from rivulet.plans import graph_operators  # registers the operators

    graph = load(graph) if isinstance(graph, str) else graph
    processors = {n: spec for raw, spec in graph["processors"].items() for n in expand(raw)}
    for name, more in (overrides or {}).items():
        processors[name] = processors[name] | {"options": _overlaid(processors[name].get("options") or {}, more)}
    for name, spec in processors.items():
        if spec["class"] not in OPERATORS:
            raise ValueError(f"unknown operator {spec['class']!r}")
        if extra := set(spec) - {"class", "options", "advanced"}:
            raise ValueError(f"{name} has unknown parts {sorted(extra)}")
    edges = edges_of(graph)
    for a, b in edges:
        for e in (a, b):
            if e.name not in processors and e.name not in (sources or {}):
                raise ValueError(f"no processor {e.name!r}")
    loops, switched = loops_of(graph, edges, {n: s["class"] for n, s in processors.items()})
    bound = {n: loop for loop in loops for n in loop.members}
    done: dict[str, dict[str, Port]] = {n: p for n, p in (sources or {}).items() if n not in processors}
    waiting = dict(processors)

    def context(name: str, without: set = frozenset()) -> Context:
        op = OPERATORS[processors[name]["class"]]
        placed: dict[str, list[tuple[int, Port]]] = {}
        for k, (a, b) in enumerate(e for e in edges if e[1].name == name and e[0].name not in without):
            port = b.port or next(iter(op.takes), "")
            if port not in op.takes:
                raise ValueError(f"{name} has no port {port!r}")
            out = a.port or next(iter(done[a.name]))
            if out not in done[a.name]:
                raise ValueError(f"{a.name} has no port {out!r}")
            op.takes[port].check(done[a.name][out].info, f"{name}.{port}")
            placed.setdefault(port, []).append((int(b.slot) if b.slot else 1000 + k, done[a.name][out]))
        inputs = {p: [x for _, x in sorted(found, key=lambda y: y[0])] for p, found in placed.items()}
        if "feed" in (sources or {}).get(name, {}):
            inputs["feed"] = [sources[name]["feed"]]
        options = options_of(name, op.options, processors[name].get("options") or {})
        made = Context(inputs, options, spark, seconds, name)
        if name in switched:
            made.enabled = done[switched[name]]["states"]
        return made

    def needs(name: str) -> set[str]:
        """What must be done before a processor, and with it the others of its loop, can be built."""
        own = bound[name].members if name in bound else {name}
        before = {a.name for a, b in edges if b.name in own} | {switched[n] for n in own if n in switched}
        return before - own if name in bound else before

    while waiting:
        ready = [n for n in waiting if needs(n) <= done.keys()]
        if not ready:
            raise ValueError(f"a cycle or a missing source at {sorted(waiting)}")
        for name in ready:
            if name not in waiting:
                continue
            if name in bound:
                loop = bound[name]
                parts = {n: context(n, loop.members) for n in loop.members}
                done |= graph_operators.closed_loop(loop, parts)
                for n in loop.members:
                    waiting.pop(n)
                continue
            waiting.pop(name)
            done[name] = OPERATORS[processors[name]["class"]].build(context(name))
    return done
