"""Filter designs and specifications. Everything here runs while a plan is built."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np

from rivulet.operators.kernels import Biquad, Fir, Kernel


def slope_taps(m: int = 4, order: int = 1, derivative: int = 1, causal: bool = True) -> tuple[float, ...]:
    """Least-squares smoothing or slope over 2m + 1 points at the newest one; newest tap first.

    A polynomial of the order is fitted to the points at 1 - n to 0, and its derivative is taken at 0: that is the row of the
    pseudo-inverse of the points' powers that belongs to the derivative, times its factorial.
    causal=False gives the taps in the order oldest first, which a filter then applies to the newest sample first: a rising
    ramp then has a falling slope.
    """
    if m < 1 or order < derivative or derivative < 0 or order > 2 * m:
        raise ValueError("the window must hold the order, and the order the derivative")
    places = np.arange(-2 * m, 1) / (2 * m)  # scaled, so that high powers stay well conditioned
    oldest_first = np.linalg.pinv(np.vander(places, order + 1, increasing=True))[derivative] * math.factorial(derivative) / (2 * m) ** derivative
    taps = tuple(oldest_first.tolist())
    return taps[::-1] if causal else taps


def lowpass_taps(cutoff: float, n: int = 101) -> tuple[float, ...]:
    """Windowed sinc; cutoff as a fraction of the sample rate, below one half."""
    if not 0 < cutoff < 0.5 or n < 1:
        raise ValueError("cutoff lies between 0 and 0.5")
    middle = (n - 1) / 2
    sinc = lambda t: 2 * cutoff if t == 0 else math.sin(2 * math.pi * cutoff * t) / (math.pi * t)
    taps = [sinc(k - middle) * (0.54 - 0.46 * math.cos(2 * math.pi * k / max(1, n - 1))) for k in range(n)]
    total = sum(taps)
    return tuple(t / total for t in taps)


def highpass_taps(cutoff: float, n: int = 101) -> tuple[float, ...]:
    """Spectral inversion of the low pass; n is odd."""
    if n % 2 == 0:
        raise ValueError("a high pass needs an odd number of taps")
    return tuple((k == n // 2) - t for k, t in enumerate(lowpass_taps(cutoff, n)))


def butterworth(cutoff: float, order: int = 2, kind: str = "lowpass") -> tuple[tuple[float, ...], ...]:
    """Second-order sections of a Butterworth low or high pass of even order, by the bilinear transform."""
    if order < 2 or order % 2 or not 0 < cutoff < 0.5:
        raise ValueError("order must be even, cutoff between 0 and 0.5")
    k, out = math.tan(math.pi * cutoff), []
    for i in range(order // 2):
        q = 1 / (2 * math.cos(math.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        a1, a2 = 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm
        b = (k * k * norm, 2 * k * k * norm, k * k * norm) if kind == "lowpass" else (norm, -2 * norm, norm)
        out.append((*b, 1.0, a1, a2))
    return tuple(out)


def prototype(family: str, order: int, ripple: float = 1.0, attenuation: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and poles of an analogue low pass of unit cutoff: butterworth, chebyshev1 (ripple in dB in the pass band),
    chebyshev2 (attenuation in dB in the stop band, which begins at the cutoff), bessel (3 dB at the cutoff)."""
    angle = np.pi * (2 * np.arange(order) + 1) / (2 * order)
    circle = 1j * np.exp(1j * angle)  # the left half of the unit circle
    none = np.zeros(0, complex)
    if family == "butterworth":
        return none, circle
    if family in ("chebyshev1", "chebyshev2"):
        epsilon = np.sqrt(10 ** (ripple / 10) - 1) if family == "chebyshev1" else 1 / np.sqrt(10 ** (attenuation / 10) - 1)
        width = np.arcsinh(1 / epsilon) / order
        ellipse = circle.real * np.sinh(width) + 1j * circle.imag * np.cosh(width)
        if family == "chebyshev1":
            return none, ellipse
        inverse = np.cos(angle)
        return 1j / inverse[np.abs(inverse) > 1e-9], 1 / ellipse
    if family == "bessel":
        falling = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order, -1, -1)]
        poles = np.roots(falling)
        gain = lambda w: abs(np.prod(-poles) / np.prod(1j * w - poles))
        low, high = 1e-3, 1e3
        for _ in range(200):  # where it has fallen by 3 dB
            middle = math.sqrt(low * high)
            low, high = (middle, high) if gain(middle) > math.sqrt(0.5) else (low, middle)
        return none, poles / low
    raise ValueError(f"unknown family {family!r}")


def sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> tuple[tuple[float, ...], ...]:
    """Second-order sections of a digital filter; complex roots come in conjugate pairs, the gain goes to the first section."""

    def pairs(roots: np.ndarray) -> list[np.ndarray]:
        upper = [np.poly([r, np.conj(r)]).real for r in roots if r.imag > 1e-12]
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-12)
        return upper + [np.poly(real[k : k + 2]) for k in range(0, len(real), 2)]

    top, bottom = pairs(zeros), pairs(poles)
    n = max(len(top), len(bottom))
    pad = lambda p: np.concatenate([p, np.zeros(3 - len(p))])
    top, bottom = [[pad(p) for p in side] + [pad(np.ones(1))] * (n - len(side)) for side in (top, bottom)]
    return tuple((*(b * (gain if k == 0 else 1.0)).tolist(), *a.tolist()) for k, (b, a) in enumerate(zip(top, bottom, strict=True)))


def iir(family: str, order: int, cutoff: float | tuple[float, float], kind: str = "lowpass", ripple: float = 1.0, attenuation: float = 40.0) -> tuple[tuple[float, ...], ...]:
    """Second-order sections of a low, high or band pass of any order, by the bilinear transform. cutoff is a fraction of the
    sample rate, two of them for a band pass; the gain is one in the middle of the pass band (at zero for a low pass)."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if order < 1 or (edges <= 0).any() or (edges >= 0.5).any() or len(edges) != (2 if kind == "bandpass" else 1) or (np.diff(edges) <= 0).any():
        raise ValueError("an order of 1 or more, and cutoffs between 0 and 0.5")
    zeros, poles = prototype(family, order, ripple, attenuation)
    warped = 2 * np.tan(np.pi * edges)
    if kind == "lowpass":
        zeros, poles, at = zeros * warped[0], poles * warped[0], 0.0
    elif kind == "highpass":
        lacking = len(poles) - len(zeros)
        zeros, poles, at = np.concatenate([warped[0] / zeros, np.zeros(lacking)]), warped[0] / poles, 0.5
    elif kind == "bandpass":
        width, middle = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        lacking = len(poles) - len(zeros)
        split = lambda r: np.concatenate([r * width / 2 + np.sqrt((r * width / 2) ** 2 - middle**2 + 0j), r * width / 2 - np.sqrt((r * width / 2) ** 2 - middle**2 + 0j)])
        zeros, poles, at = np.concatenate([split(zeros), np.zeros(lacking)]), split(poles), math.atan(middle / 2) / math.pi
    else:
        raise ValueError(f"unknown kind {kind!r}")
    lacking = len(poles) - len(zeros)
    z, p = np.concatenate([(2 + zeros) / (2 - zeros), -np.ones(lacking)]), (2 + poles) / (2 - poles)
    # Zeros on the circle are kept on it, so that pairs are found.
    z = np.where(np.abs(np.abs(z) - 1) < 1e-9, z / np.abs(z), z)
    one = np.exp(2j * np.pi * at)
    gain = abs(np.prod(one - p) / np.prod(one - z))
    return sections(z, p, float(gain))


def response(sos: Sequence[Sequence[float]], frequency: float, gain: float = 1.0) -> float:
    """Amplification at a frequency, as a fraction of the sample rate."""
    z = np.exp(-2j * np.pi * frequency)
    return float(abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos])) * gain)


def bandpass(center: float, width: float, sections: int = 1) -> tuple[tuple[float, ...], ...]:
    """Constant-peak band pass sections; center and width as fractions of the sample rate."""
    w, q = 2 * math.pi * center, center / width
    alpha = math.sin(w) / (2 * q)
    a0 = 1 + alpha
    return ((alpha / a0, 0.0, -alpha / a0, 1.0, -2 * math.cos(w) / a0, (1 - alpha) / a0),) * sections


def from_spec(spec: dict) -> Kernel:
    """A filter kernel of a specification: type fir (coefficients), biquad (coefficients, gain) or slope (window size, order,
    derivative), or the text of a filter file under `text`."""
    if "text" in spec:
        return parse_text(spec["text"])
    kind = spec.get("type")
    if kind == "fir":
        return Fir(tuple(map(float, spec["coefficients"])))
    if kind == "biquad":
        sections = tuple(tuple(map(float, s)) for s in spec["coefficients"])
        if any(len(s) != 6 for s in sections):
            raise ValueError("a section has six coefficients")
        return Biquad(sections, float(spec.get("gain", 1.0)))
    if kind == "slope":
        return Fir(slope_taps(int(spec.get("window size", 4)), int(spec.get("order", 1)), int(spec.get("derivative", 1)), bool(spec.get("causal", True))))
    raise ValueError(f"unknown filter type {kind!r}")


def parse_text(text: str) -> Kernel:
    """A filter file: a header of `# key = value` lines between `##` lines, then numbers. Only the text format is known."""
    lines = [x.strip() for x in text.strip().splitlines()]
    if not lines or not lines[0].startswith("##"):
        raise ValueError("a filter file starts with ##")
    end = next((k for k, x in enumerate(lines[1:], 1) if x.startswith("##")), None)
    if end is None:
        raise ValueError("the header has no end")
    pairs = (re.match(r"#\s*([^=]+?)\s*=\s*(.*)", x) for x in lines[1:end])
    header = {m[1].lower(): m[2].strip() for m in pairs if m}
    if header.get("format", "text") != "text":
        raise ValueError("only text filter files can be read")
    rows: list[Sequence[float]] = [[float(v) for v in x.replace(",", " ").split()] for x in lines[end + 1 :] if x and not x.startswith("#")]
    if header.get("type") == "fir":
        return from_spec({"type": "fir", "coefficients": [v for r in rows for v in r]})
    if header.get("type") == "biquad":
        return from_spec({"type": "biquad", "gain": rows[0][0], "coefficients": rows[1:]})
    raise ValueError(f"unknown filter type {header.get('type')!r}")


def impulse_response(kernel: Kernel, n: int | None = None) -> list[float]:
    """What the filter makes of a one and n - 1 zeros; n is by default the filter's order."""
    order = len(kernel.taps) - 1 if isinstance(kernel, Fir) else 2 * len(kernel.sections)
    x = np.zeros(max(1, n if n is not None else order))
    x[0] = 1
    return [y[0] for y in kernel.step(kernel.init(), {"value": x})[1]["filtered"]]


def microseconds_a_sample(kernel: Kernel, n: int = 1_000_000) -> float:
    """What the filter takes for a sample of one channel, over n of them in one call."""
    import time

    x, state = np.sin(np.arange(n) * 0.01), kernel.init()
    began = time.perf_counter()
    kernel.step(state, {"value": x})
    return (time.perf_counter() - began) / n * 1e6
