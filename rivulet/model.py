"""Canonical schemas, and the static description that goes with a stream."""

from __future__ import annotations

from dataclasses import dataclass, replace

SCHEMAS = {
    "samples": "stream_id string, seq long, hw_ts long, values array<double>",
    "events": "stream_id string, slot int, serial long, hw_ts long, event string",
    "spikes": "stream_id string, buffer_id long, hw_ts long, amplitudes array<double>",
    "spike_buffers": "stream_id string, buffer_id long, hw_ts long, n_spikes int",
    "mua": "stream_id string, bin_start long, hw_ts long, n_spikes int, bin_ms double, mua double",
    "packets": "stream_id string, arrival long, raw binary",
    "message_packets": "stream_id string, message_id long, ts long, n_channels int, n_samples int, samples array<float>",
    "control": "name string, hw_ts long, value boolean",
    "statistics": "stream_id string, hw_ts long, test_value double, threshold double",
}


@dataclass(frozen=True)
class StreamInfo:
    """What is fixed for a stream: type, channels, samples to a buffer, sample rate in Hz. Checked when a plan is built."""

    kind: str = "samples"
    nchannels: int = 1
    nsamples: int = 1
    sample_rate: float = 1.0

    def __post_init__(self):
        if self.nchannels < 1 or self.nsamples < 1 or self.sample_rate <= 0:
            raise ValueError(f"impossible stream: {self}")

    @property
    def stream_rate(self) -> float:
        """Buffers a second."""
        return self.sample_rate / self.nsamples

    def with_(self, **changes) -> StreamInfo:
        return replace(self, **changes)


@dataclass(frozen=True)
class Accepts:
    """What an input takes; ranges include their ends."""

    kind: str = "samples"
    channels: tuple[int, int] = (1, 4096)

    def check(self, info: StreamInfo, where: str) -> None:
        if self.kind == "any":
            return
        if info.kind != self.kind:
            raise TypeError(f"{where} takes {self.kind}, not {info.kind}")
        if info.kind == "samples" and not self.channels[0] <= info.nchannels <= self.channels[1]:
            raise ValueError(f"{where} takes {self.channels[0]} to {self.channels[1]} channels, not {info.nchannels}")
