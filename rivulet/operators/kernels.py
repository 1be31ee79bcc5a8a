"""Sequential operators as kernels over one ordered stream.

A kernel has init() for a stream's first state and step(state, columns) for its next rows, in order. step changes the state in
place and returns the positions of the input rows it speaks of and its output columns, one value for each. The result does not
depend on where a stream is cut into steps, so the same kernel serves batches, Arrow batches and micro-batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache
from types import SimpleNamespace

import numpy as np

Step = tuple[list[int], dict[str, list]]
#: Samples of a block in the recursive filter.
BLOCK = 64


class Kernel:
    #: Columns that step reads, and the DDL of those it returns.
    reads: tuple[str, ...] = ("value",)
    returns: str = ""

    def init(self) -> SimpleNamespace:
        raise NotImplementedError

    def step(self, state: SimpleNamespace, columns: dict[str, np.ndarray]) -> Step:
        raise NotImplementedError


def vectors(x: np.ndarray) -> np.ndarray:
    """Samples as rows of channels, whether they come as numbers or as arrays."""
    if x.dtype == object:
        rows = x.tolist()
        if not rows:
            return np.zeros((0, 1))
        if len({len(v) for v in rows}) > 1:
            raise ValueError("samples of one stream differ in their number of channels")
        return np.concatenate(rows).astype(float).reshape(len(rows), len(rows[0]))
    if x.ndim == 2:
        return x
    return x.astype(float).reshape(len(x), 1)


@dataclass
class LevelCrossing(Kernel):
    """An event where any channel crosses the threshold; then `block` samples cannot, and the last of them is the new previous."""

    threshold: float = 0.0
    upslope: bool = True
    block: int = 2
    returns = "crossed boolean"

    def __post_init__(self):
        if self.block < 0:
            raise ValueError("block must not be negative")

    def init(self):
        return SimpleNamespace(left=0, prev=None)

    def step(self, state, columns):
        x = vectors(columns["value"])
        if not len(x):
            return [], {"crossed": []}
        side = x if self.upslope else -x
        limit = self.threshold if self.upslope else -self.threshold
        before = np.concatenate([side[:1] if state.prev is None else state.prev[None], side[:-1]])
        at = np.flatnonzero(((before <= limit) & (side > limit)).any(1))
        # Where it crosses is known for all samples at once; what remains is to go from one event past its block to the next.
        out, free = [], state.left
        k = int(np.searchsorted(at, free))
        while k < len(at):
            out.append(int(at[k]))
            free = out[-1] + self.block + 1
            k = int(np.searchsorted(at, free))
        state.left, state.prev = max(0, free - len(x)), side[-1]
        return out, {"crossed": [True] * len(out)}


class MeanMad:
    """Running mean and mean absolute deviation, with a burn-in and, if asked, less weight for outliers."""

    __slots__ = ("alpha", "burn_in", "seen", "center", "dispersion", "z0", "h")

    def __init__(self, alpha: float, burn_in: int, z0: float | None = None, h: float = 1.0):
        if not 0 <= alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")
        self.alpha, self.burn_in, self.z0, self.h = alpha, burn_in, z0, h
        self.seen, self.center, self.dispersion = 0, 0.0, 0.0

    @property
    def burning_in(self) -> bool:
        return self.seen < self.burn_in

    def add(self, x: float) -> None:
        a = self.alpha
        if self.burning_in:
            self.seen += 1
            a = self.alpha + (1 - self.alpha) / self.seen
        elif self.z0 is not None and self.dispersion > 0:
            z = abs((x - self.center) / self.dispersion)
            if z > self.z0:
                a = self.alpha * 2.0 ** ((self.z0 - z) / self.h)
        self.center = (1 - a) * self.center + a * x
        self.dispersion = (1 - a) * self.dispersion + a * abs(x - self.center)


@dataclass
class RunningStats(Kernel):
    """Center and dispersion after every sample of the first channel."""

    alpha: float = 0.1
    burn_in: int = 0
    z0: float | None = None
    h: float = 2.0
    returns = "center double, dispersion double"

    def init(self):
        return SimpleNamespace(stats=MeanMad(self.alpha, self.burn_in, self.z0, self.h))

    def step(self, state, columns):
        center, dispersion = [], []
        for x in vectors(columns["value"])[:, 0].tolist():
            state.stats.add(x)
            center.append(state.stats.center)
            dispersion.append(state.stats.dispersion)
        return list(range(len(center))), {"center": center, "dispersion": dispersion}


@dataclass
class Smoother(Kernel):
    """Exponential smoothing from an initial value."""

    alpha: float = 0.1
    start: float = 0.0
    returns = "smooth double"

    def __post_init__(self):
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")

    def init(self):
        return SimpleNamespace(value=self.start)

    def step(self, state, columns):
        out, v, a = [], state.value, self.alpha
        for x in vectors(columns["value"])[:, 0].tolist():
            v = a * x + (1 - a) * v
            out.append(v)
        state.value = v
        return list(range(len(out))), {"smooth": out}


@dataclass
class Peak(Kernel):
    """Local maxima: at the first lower sample after a rise, reports the sample before it. Plateaus count once, at their end."""

    reads = ("value", "hw_ts")
    returns = "peak_ts long, amplitude double"

    def init(self):
        return SimpleNamespace(prev=None, ts=None, up=False)

    def step(self, state, columns):
        rows, at, amplitude = [], [], []
        for k, (x, t) in enumerate(zip(vectors(columns["value"])[:, 0].tolist(), columns["hw_ts"].tolist(), strict=True)):
            if state.prev is not None:
                if x < state.prev:
                    if state.up:
                        rows.append(k)
                        at.append(state.ts)
                        amplitude.append(state.prev)
                    state.up = False
                elif x > state.prev:
                    state.up = True
            state.prev, state.ts = x, t
        return rows, {"peak_ts": at, "amplitude": amplitude}


@dataclass
class Oscillation(Kernel):
    """Detector of bursts of power against a running mean and deviation, with a burn-in, an adaptive threshold and a lockout.

    The threshold is `deviations` times the running deviation and is set once for each bucket of samples. The burn-in takes
    whole buckets. Locked and disabled samples change neither the crossing state nor the statistics. A column `enabled`, if it
    is there, switches detection by sample. With power, a sample is the mean of its channels' squares, else their mean.
    With downsample only every so many samples are shown; one that fires is returned all the same, with shown false.
    """

    deviations: float = 6.0
    smooth_s: float = 10.0
    lockout_ms: float = 30.0
    rate: float = 1.0
    bucket: int = 1
    power: bool = True
    downsample: int = 1
    gated: bool = False
    returns = "test_value double, threshold double, detected boolean, locked boolean, shown boolean"

    def __post_init__(self):
        self.reads = ("value", "enabled") if self.gated else ("value",)
        self.burn_in = max(1, math.trunc(self.smooth_s * self.rate))
        self.block = math.trunc(self.lockout_ms * self.rate / 1000)

    def init(self):
        return SimpleNamespace(stats=MeanMad(1 / self.burn_in, self.burn_in), at=0, warm=False, threshold=0.0, prev=math.inf, left=0, seen=0)

    def levels(self, samples: np.ndarray) -> list[float]:
        """What the detector sees of each sample."""
        x = vectors(samples)
        return ((x * x) if self.power else x).mean(1).tolist()

    def one(self, state, value: float, enabled: bool) -> tuple | None:
        """Takes one sample. What it says of it, in the order of `returns`; None if it says nothing."""
        stats = state.stats
        if state.at == 0 and not stats.burning_in:
            state.warm = True
            state.threshold = self.deviations * stats.dispersion
            stats.alpha = min(1.0, 1 / (self.smooth_s * self.rate))
        state.at = (state.at + 1) % self.bucket
        if not state.warm:
            stats.add(value)
            return None
        test = abs(value - stats.center)
        show = state.seen % self.downsample == 0
        state.seen += 1
        locked, fired = state.left > 0, False
        if locked:
            state.left -= 1
        elif enabled:
            fired = state.prev <= state.threshold < test
            state.prev = test
            if fired:
                state.left = self.block
            stats.add(value)
        return (test, state.threshold, fired, locked, show) if show or fired else None

    def step(self, state, columns):
        v = self.levels(columns["value"])
        on = columns["enabled"].tolist() if self.gated else [True] * len(v)
        rows, said = [], []
        for k, (value, enabled) in enumerate(zip(v, on, strict=True)):
            if (found := self.one(state, value, enabled)) is not None:
                rows.append(k)
                said.append(found)
        names = [x.split()[0] for x in self.returns.split(", ")]
        return rows, {c: [x[k] for x in said] for k, c in enumerate(names)}


def burst(deviations: float = 6.0, smooth_s: float = 10.0, lockout_ms: float = 30.0, bin_ms: float = 10.0) -> Oscillation:
    """The same detector on firing rates, one to a bucket."""
    return Oscillation(deviations, smooth_s, lockout_ms, 1000 / bin_ms, 1, False)


@dataclass
class Spike(Kernel):
    """Threshold crossing on any channel, then a search for each channel's peak within `life` samples."""

    threshold: float = 60.0
    invert: bool = True
    life: int = 8
    reads = ("value", "hw_ts")
    returns = "spike_ts long, amplitudes array<double>"

    def __post_init__(self):
        if self.life < 1:
            raise ValueError("life must be 1 or more")

    def init(self):
        return SimpleNamespace(prev=None, slopes=None, searching=False, left=0, ts=0, peaks=None, amplitudes=None)

    def step(self, s, columns):
        x = vectors(columns["value"])
        x = -x if self.invert else x
        rows, ts, amplitudes = [], [], []
        for k, (now, t) in enumerate(zip(x, columns["hw_ts"].tolist(), strict=True)):
            if s.prev is None:
                s.prev, s.slopes = np.zeros(len(now)), np.zeros(len(now))
            done = False
            if s.searching:
                fresh = ~s.peaks & (s.slopes > 0) & (now < s.prev)
                s.amplitudes = np.where(fresh, s.prev, s.amplitudes)
                s.peaks = s.peaks | fresh
                s.left -= 1
                if s.left == 0 or s.peaks.all():
                    s.searching, done = False, True
                    if s.peaks.any():
                        rows.append(k)
                        ts.append(s.ts)
                        amplitudes.append((-s.amplitudes if self.invert else s.amplitudes).tolist())
            elif ((s.prev <= self.threshold) & (now > self.threshold)).any():
                s.searching, s.left, s.ts = True, self.life, t
                s.peaks, s.amplitudes = np.zeros(len(now), bool), s.prev
            if s.searching and not done:
                s.slopes = np.where(now != s.prev, now - s.prev, s.slopes)
            s.prev = now
        return rows, {"spike_ts": ts, "amplitudes": amplitudes}


@dataclass
class Fir(Kernel):
    """Finite impulse response by channel; the first samples see zeros before them."""

    taps: tuple[float, ...] = (1.0,)
    returns = "filtered array<double>"

    def init(self):
        return SimpleNamespace(past=None)

    def filtered(self, state, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        n = len(self.taps) - 1
        past = np.zeros((n, x.shape[1])) if state.past is None else state.past
        both = np.concatenate([past, x])
        y = sum(c * both[n - k : n - k + len(x)] for k, c in enumerate(self.taps))
        state.past = both[len(both) - n :]
        return y

    def step(self, state, columns):
        y = self.filtered(state, vectors(columns["value"]))
        return list(range(len(y))), {"filtered": y.tolist()}


@dataclass
class Biquad(Kernel):
    """Cascade of second-order sections (b0, b1, b2, a0, a1, a2; a0 is taken as 1), then a gain; registers start at zero.

    Samples go in blocks: a section's output over a block is a matrix product of the block and of its two registers.
    """

    sections: tuple[tuple[float, ...], ...] = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0),)
    gain: float = 1.0
    returns = "filtered array<double>"

    def init(self):
        return SimpleNamespace(w=None)

    def filtered(self, state, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        if state.w is None:
            state.w = [np.zeros((2, x.shape[1])) for _ in self.sections]
        y = np.empty_like(x)
        for lo in range(0, len(x), BLOCK):
            part = x[lo : lo + BLOCK]
            n = len(part)
            for k, section in enumerate(self.sections):
                forced, free, into, over = block_response(section)
                w = state.w[k]
                # The registers after n samples are the free and forced responses of the recursive part.
                state.w[k] = over[n] @ w + into[:, BLOCK - n :] @ part
                part = forced[:n, :n] @ part + free[:n] @ w
            y[lo : lo + n] = part * self.gain
        return y

    def step(self, state, columns):
        y = self.filtered(state, vectors(columns["value"]))
        return list(range(len(y))), {"filtered": y.tolist()}


@dataclass
class Chain(Kernel):
    """A filter (one that has `filtered`), and a kernel on what it gives, as one kernel."""

    first: Kernel
    then: Kernel

    def __post_init__(self):
        self.reads = tuple(dict.fromkeys((*self.first.reads, *self.then.reads)))
        self.returns = self.then.returns

    def init(self):
        return SimpleNamespace(first=self.first.init(), then=self.then.init())

    def filtered(self, state, x: np.ndarray) -> np.ndarray:
        return self.then.filtered(state.then, self.first.filtered(state.first, x))

    def step(self, state, columns):
        return self.then.step(state.then, columns | {"value": self.first.filtered(state.first, vectors(columns["value"]))})


@lru_cache(256)
def block_response(section: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a section over a block: outputs by input (lower triangular), outputs by register, registers at the end of n samples
    by input (the last n columns), and by register for every n."""
    b0, b1, b2, _, a1, a2 = section
    move = np.array([[-a1, -a2], [1.0, 0.0]])
    over = [np.eye(2)]
    for _ in range(BLOCK):
        over.append(move @ over[-1])
    over = np.stack(over)
    out = np.array([b1 - a1 * b0, b2 - a2 * b0])
    free = np.stack([out @ p for p in over[:BLOCK]])
    pulse = np.concatenate([[b0], free[: BLOCK - 1, 0]])
    i, j = np.indices((BLOCK, BLOCK))
    forced = np.where(i >= j, pulse[np.maximum(i - j, 0)], 0.0)
    into = over[:BLOCK, :, 0][::-1].T
    return forced, free, into, over


@dataclass
class GapFill(Kernel):
    """After each batch of valid packets, says how many times its last sample is repeated to make up for missed ones.

    asap fills all whole batches missed at once, distributed one batch at a time, none nothing.
    """

    batch: int = 2
    mode: str = "asap"
    period_us: float = 31.25
    reads = ("hw_ts",)
    returns = "copies long"

    def __post_init__(self):
        if self.mode not in ("asap", "distributed", "none"):
            raise ValueError(f"unknown mode {self.mode}")

    def init(self):
        return SimpleNamespace(last=None, missed=0, filled=0, n=0)

    def step(self, s, columns):
        limit = math.trunc(self.period_us) + 1
        out = []
        for t in columns["hw_ts"].tolist():
            if s.last is None or t > s.last:
                if s.last is not None and t - s.last > limit:
                    s.missed += math.floor((t - s.last) / self.period_us + 0.5) - 1
                s.last = t
            s.n += 1
            more = 0
            if s.n % self.batch == 0 and self.mode != "none" and s.missed - s.filled >= self.batch:
                more = (s.missed - s.filled) // self.batch if self.mode == "asap" else 1
                s.filled += more * self.batch
            out.append(more * self.batch)
        return list(range(len(out))), {"copies": out}


@dataclass
class DigitalState(Kernel):
    """State of digital channels after each event: its protocol's actions high, low, toggle, then pulse (high, and low again
    after the pulse width, if nothing has set the channel since). Channels out of range are ignored, as are other events."""

    protocols: dict = field(default_factory=dict)
    nchannels: int = 16
    pulse_us: int = 400
    reads = ("event", "hw_ts")
    returns = "at long, state array<boolean>"

    def init(self):
        return SimpleNamespace(state=[False] * self.nchannels, due={})

    def step(self, s, columns):
        rows, at, states = [], [], []

        def show(k: int, t: int) -> None:
            rows.append(k)
            at.append(t)
            states.append(list(s.state))

        for k, (event, t) in enumerate(zip(columns["event"].tolist(), columns["hw_ts"].tolist(), strict=True)):
            for due in sorted({d for d in s.due.values() if d <= t}):
                for c in [c for c, d in s.due.items() if d == due]:
                    s.state[c] = False
                    del s.due[c]
                show(k, due)
            actions = self.protocols.get(event)
            if actions is None:
                continue
            for name in ("high", "low", "toggle", "pulse"):
                for c in actions.get(name, ()):
                    if 0 <= c < self.nchannels:
                        s.state[c] = {"high": True, "low": False, "toggle": not s.state[c], "pulse": True}[name]
                        s.due.pop(c, None)
                        if name == "pulse":
                            s.due[c] = t + self.pulse_us
            show(k, t)
        return rows, {"at": at, "state": states}


@dataclass
class Throttle(Kernel):
    """Load shedding: for each batch of `nread` packets, which are kept. The level follows how full the buffer was."""

    capacity: int = 100
    threshold: float = 0.3
    smooth: float = 0.5
    reads = ("nread",)
    returns = "level double, kept long"

    def init(self):
        return SimpleNamespace(level=0.0)

    def step(self, s, columns):
        levels, kept = [], []
        for n in columns["nread"].tolist():
            s.level *= 1 - self.smooth
            if n > self.threshold * self.capacity:
                s.level += self.smooth
            far = 0.5 - abs(s.level - 0.5)
            every = math.inf if far == 0 else math.floor(1 / far)
            if s.level < 0.5:
                keep = n if every > n else n - len(range(0, n, int(every)))
            else:
                keep = 0 if every > n else len(range(0, n, int(every)))
            levels.append(s.level)
            kept.append(keep)
        return list(range(len(kept))), {"level": levels, "kept": kept}


@dataclass
class Delayed(Kernel):
    """Detections to trigger messages: at once or after a delay, with lockouts and analysis windows in event time.

    Modes: detection (emits `detection` only), ontime (emits `ontime` at the detection), delayed (emits `detection` at once and
    `delayed` at the detection plus its delay). Each stimulation (the delayed or ontime message) at time at turns the analysis
    off in [at + offset, at + offset + analysis) for each of the offsets: detections that fall there are dropped, and so are
    stimulations of earlier decisions. Columns: hw_ts and, for the delayed mode, delay.
    """

    mode: str = "ontime"
    lockout: int = 50_000
    after_stimulation: bool = True
    after_detection: bool = False
    analysis: int = 0
    offsets: tuple[int, ...] = (0,)
    detection: str = "r"
    ontime: str = "o"
    delayed: str = "d"
    returns = "at long, message string"

    def __post_init__(self):
        if self.lockout < 0 or self.analysis < 0:
            raise ValueError("a lockout must not be negative")
        if self.mode not in ("detection", "ontime", "delayed"):
            raise ValueError(f"unknown mode {self.mode}")
        self.reads = ("hw_ts", "delay") if self.mode == "delayed" else ("hw_ts",)

    def init(self):
        return SimpleNamespace(prev=-math.inf, last=-math.inf, windows=[])

    def off(self, s, t) -> bool:
        return any(a <= t < a + self.analysis for a in s.windows)

    def step(self, s, columns):
        rows, at, messages = [], [], []
        delays = columns["delay"].tolist() if self.mode == "delayed" else [0] * len(columns["hw_ts"])

        def emit(k, t, message) -> None:
            rows.append(k)
            at.append(t)
            messages.append(message)

        def block(t) -> None:
            if self.analysis:
                s.windows += [t + offset for offset in self.offsets]

        for k, (t, wait) in enumerate(zip(columns["hw_ts"].tolist(), delays, strict=True)):
            s.windows = [a for a in s.windows if a + self.analysis > t]
            if self.off(s, t):
                continue
            if self.mode == "detection":
                if not (self.after_detection and t - s.prev <= self.lockout):
                    emit(k, t, self.detection)
                    s.prev = t if self.after_detection else s.prev
            elif self.mode == "ontime":
                if not ((self.after_detection or self.after_stimulation) and t - s.prev <= self.lockout):
                    emit(k, t, self.ontime)
                    block(t)
                    s.prev = t
            else:
                due = t + wait
                if (self.after_stimulation and due - s.last <= self.lockout) or (self.after_detection and t - s.prev <= self.lockout):
                    continue
                emit(k, t, self.detection)
                if not self.off(s, due):
                    emit(k, due, self.delayed)
                    block(due)
                    s.last = max(s.last, due)
                s.prev = t if self.after_detection else s.prev
        return rows, {"at": at, "message": messages}


@dataclass
class Rendezvous(Kernel):
    """Emits once every slot has had the target since the last emission, at the last one's time."""

    target: str = "none"
    slots: tuple = ()
    reads = ("event", "slot", "hw_ts")
    returns = "at long, round long"

    def init(self):
        return SimpleNamespace(seen=set(), at=0, n=0)

    def step(self, s, columns):
        rows, at, rounds = [], [], []
        for k, (event, slot, t) in enumerate(zip(columns["event"].tolist(), columns["slot"].tolist(), columns["hw_ts"].tolist(), strict=True)):
            if event != self.target or slot not in self.slots:
                continue
            s.seen.add(slot)
            s.at = max(s.at, t)
            if len(s.seen) == len(self.slots):
                rows.append(k)
                at.append(s.at)
                rounds.append(s.n)
                s.seen, s.at, s.n = set(), 0, s.n + 1
        return rows, {"at": at, "round": rounds}


@dataclass
class Coincidence(Kernel):
    """The coincidence filter over rows as they come, for streams that have no end to look back from: targets on at least
    `needed` slots within `sync`, unless a blocker came at most `block` before or at the same time, or comes less than `wait`
    after. A target is decided with the first row that comes `wait` or more after it, so each waits a bounded time.

    Columns: hw_ts, slot, and target (false for blockers). Rows of one time are looked at together.
    """

    sync: int = 3_500
    block: int = 10_000
    wait: int = 1_500
    needed: int = 1
    reads = ("hw_ts", "slot", "target")
    returns = "at long, slot long, n_slots long"

    def init(self):
        return SimpleNamespace(now=None, targets=[], blocked=False, seen={}, blocker=-math.inf, waiting=[])

    def _close(self, s) -> None:
        """What the rows of the time that is over say."""
        if s.blocked:
            s.blocker = s.now
        for slot in s.targets:
            s.seen[slot] = s.now
        s.seen = {slot: t for slot, t in s.seen.items() if t > s.now - self.sync}
        if s.targets and s.now - s.blocker > self.block and len(s.seen) >= self.needed:
            s.waiting += [(s.now, slot, len(s.seen)) for slot in s.targets]
        s.targets, s.blocked = [], False

    def step(self, s, columns):
        rows, out = [], {"at": [], "slot": [], "n_slots": []}
        for k, (t, slot, target) in enumerate(zip(columns["hw_ts"].tolist(), columns["slot"].tolist(), columns["target"].tolist(), strict=True)):
            if s.now is not None and t != s.now:
                self._close(s)
            s.now = t
            ready = [x for x in s.waiting if t - x[0] >= self.wait]
            for x in ready:
                rows.append(k)
                for c, v in zip(out.values(), x, strict=True):
                    c.append(v)
            s.waiting = [x for x in s.waiting if t - x[0] < self.wait and (target or t <= x[0])]
            if target:
                s.targets.append(slot)
            else:
                s.blocked = True
        return rows, out
