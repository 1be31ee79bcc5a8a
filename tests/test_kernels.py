import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.operators import kernels as K
from rivulet.operators.runner import batch, run_segments

KERNELS = [
    K.LevelCrossing(1.0, True, 2), K.LevelCrossing(1.0, False, 0), K.RunningStats(0.2, 3), K.RunningStats(0.2, 2, 1.0, 2.0), K.Smoother(0.3), K.Peak(), K.Oscillation(1.0, 4.0, 2000.0, 1.0, 1),
    K.Oscillation(1.0, 3.0, 1000.0, 1.0, 4, False, 2), K.burst(1.0, 3.0, 1000.0, 1000.0), K.Spike(1.0, False, 3), K.Spike(1.0, True, 1), K.Fir((0.5, 0.25, 0.25)), K.Biquad(((0.2, 0.4, 0.2, 1, -0.5, 0.25),), 2.0),
    K.GapFill(2, "asap", 10.0), K.GapFill(3, "distributed", 10.0), K.GapFill(2, "none"), K.DigitalState({"a": {"high": [0], "pulse": [1]}, "b": {"toggle": [0, 9]}}, 3, 15), K.Throttle(10),
    K.Delayed("detection", 20, after_detection=True), K.Delayed("ontime", 20), K.Delayed("delayed", 20), K.Delayed("ontime", 5, analysis=30, offsets=(1, 40)), K.Rendezvous("a", (0, 1)), K.Coincidence(30, 20, 15, 1),
]


def columns(values, steps):
    n = len(values)
    return {
        "value": np.array(values, float), "hw_ts": np.cumsum(np.array(steps[:n], np.int64)) if n else np.zeros(0, np.int64), "event": np.array(["a" if v > 0 else "b" for v in values], object),
        "slot": np.array([k % 2 for k in range(n)]), "nread": np.array([abs(int(10 * v)) for v in values]), "delay": np.array([k % 7 for k in range(n)]), "enabled": np.ones(n, bool), "target": np.array([v > -2 for v in values], bool),
    }


def cut(c, a, b):
    return {k: v[a:b] for k, v in c.items()}


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: type(k).__name__)
@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.sampled_from([-3.0, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 4.0]), max_size=24), where=st.integers(0, 24), steps=st.lists(st.integers(0, 40), min_size=24, max_size=24))
def test_steps_may_be_cut_anywhere(kernel, values, where, steps):
    c = columns(values, steps)
    whole = kernel.step(kernel.init(), c)
    state, at = kernel.init(), min(where, len(values))
    r1, o1 = kernel.step(state, cut(c, 0, at))
    r2, o2 = kernel.step(state, cut(c, at, len(values)))
    assert whole[0] == r1 + [at + k for k in r2]
    joined = {k: o1[k] + o2[k] for k in o1}
    if isinstance(kernel, K.Biquad):  # blocks begin at the cut, so sums may round differently
        assert np.allclose(whole[1]["filtered"], joined["filtered"], atol=1e-12)
    else:
        assert whole[1] == joined


def test_biquad_blocks_follow_the_recursion():
    sections, x = ((0.2, 0.4, 0.2, 1.0, -0.5, 0.25), (1.0, -1.0, 0.0, 1.0, 0.3, 0.0)), np.random.default_rng(1).normal(size=400)
    w, expected = [[0.0, 0.0] for _ in sections], []
    for y in x:
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            u = y - a1 * w[k][0] - a2 * w[k][1]
            y, w[k] = b0 * u + b1 * w[k][0] + b2 * w[k][1], [u, w[k][0]]
        expected.append(0.5 * y)
    kernel = K.Biquad(sections, 0.5)
    state, got = kernel.init(), []
    for a, b in ((0, 3), (3, 70), (70, 301), (301, 302), (302, 400)):
        got += [y for (y,) in kernel.step(state, {"value": x[a:b]})[1]["filtered"]]
    assert np.allclose(got, expected, atol=1e-12)


def fired(kernel, values, **more):
    return kernel.step(kernel.init(), columns(values, [10] * len(values)) | more)[0]


def test_crossing():
    assert fired(K.LevelCrossing(1.0, True, 0), [0, 1, 2, 2, 0, 3]) == [2, 5]
    assert fired(K.LevelCrossing(1.0, True, 0), [5, 5]) == []
    assert fired(K.LevelCrossing(1.0, False, 0), [2, 1, 0, 2, 0]) == [2, 4]
    # The two samples after an event can't fire; the second is the new previous one.
    assert fired(K.LevelCrossing(1.0, True, 2), [0, 2, 0, 0, 2]) == [1, 4]
    assert fired(K.LevelCrossing(1.0, True, 2), [0, 2, 0, 2, 3]) == [1]
    two = np.array([[0.0, 0], [0, 2], [2, 2]], float)
    assert K.LevelCrossing(1.0, True, 0).step(K.LevelCrossing(1.0, True, 0).init(), {"value": np.array([*map(list, two), None], object)[:-1]})[0] == [1, 2]
    with pytest.raises(ValueError):
        K.LevelCrossing(block=-1)


def test_worked_statistics():
    x = [4.0, -1.5, 0.25, 7.0, 2.0, -3.5]
    c = d = 0.0
    for v in x:
        c = 0.9 * c + 0.1 * v
        d = 0.9 * d + 0.1 * abs(v - c)
    out = K.RunningStats(0.1).step(K.RunningStats(0.1).init(), columns(x, [1] * 6))[1]
    assert math.isclose(out["center"][-1], c) and math.isclose(out["dispersion"][-1], d)
    s = 0.0
    for v in x:
        s = 0.1 * v + 0.9 * s
    assert math.isclose(K.Smoother(0.1).step(SimpleNamespace(value=0.0), columns(x, [1] * 6))[1]["smooth"][-1], s)
    with pytest.raises(ValueError):
        K.Smoother(1.5)


def test_burn_in_averages():
    x = [4.0, 8.0, 6.0]
    out = K.RunningStats(0.0, 3).step(K.RunningStats(0.0, 3).init(), columns(x, [1] * 3))[1]
    assert [round(v, 9) for v in out["center"]] == [4, 6, 6]


def test_peak_and_plateau():
    k = K.Peak()
    rows, out = k.step(k.init(), columns([0, 1, 3, 3, 2, 1, 2, 0], [10] * 8))
    assert rows == [4, 7] and out["amplitude"] == [3, 2]


def test_spike():
    k = K.Spike(1.0, False, 4)
    rows, out = k.step(k.init(), columns([0, 2, 4, 3, 0, 0], [10] * 6))
    assert rows == [3] and out["spike_ts"] == [20] and out["amplitudes"] == [[4.0]]
    # The life is over before a peak shows: no spike.
    assert fired(K.Spike(1.0, False, 1), [0, 2, 4, 8]) == []
    with pytest.raises(ValueError):
        K.Spike(life=0)


def test_oscillation_lockout_and_gate():
    x = [1.0, 2.0] * 5 + [1.5, 20.0, 0.0, 20.0, 1.0]
    k = K.Oscillation(2.0, 10.0, 2000.0, 1.0, 1, False)
    rows, out = k.step(k.init(), columns(x, [1] * 15))
    assert rows == list(range(10, 15)) and out["detected"] == [False, True, False, False, False] and out["locked"][2:4] == [True, True]
    gated = K.Oscillation(2.0, 10.0, 2000.0, 1.0, 1, False, gated=True)
    off = columns(x, [1] * 15) | {"enabled": np.zeros(15, bool)}
    assert not any(gated.step(gated.init(), off)[1]["detected"])


def test_delayed_modes():
    t = {"hw_ts": np.array([0, 10, 25, 60]), "delay": np.array([5, 5, 5, 5])}
    on = K.Delayed("ontime", 20)
    assert on.step(on.init(), t)[1]["at"] == [0, 25, 60]
    late = K.Delayed("delayed", 20)
    assert late.step(late.init(), t)[1] == {"at": [0, 5, 25, 30, 60, 65], "message": ["r", "d"] * 3}
    blind = K.Delayed("ontime", 0, analysis=30)
    assert blind.step(blind.init(), t)[1]["at"] == [0, 60]
    for bad in ({"lockout": -1}, {"mode": "x"}):
        with pytest.raises(ValueError):
            K.Delayed(**bad)


def test_digital_pulse_ends():
    k = K.DigitalState({"a": {"pulse": [1]}}, 2, 15)
    _, out = k.step(k.init(), {"event": np.array(["a", "x", "a"], object), "hw_ts": np.array([0, 10, 40])})
    assert out["at"] == [0, 15, 40] and out["state"] == [[False, True], [False, False], [False, True]]


def test_gap_fill():
    k = K.GapFill(2, "asap", 10.0)
    assert k.step(k.init(), {"hw_ts": np.array([0, 10, 60, 70])})[1]["copies"] == [0, 0, 0, 4]
    k = K.GapFill(2, "distributed", 10.0)
    assert k.step(k.init(), {"hw_ts": np.array([0, 10, 60, 70])})[1]["copies"] == [0, 0, 0, 2]


def test_runner_keeps_streams_apart_and_handles_empty(spark):
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([0, 2, 0, 2])] + [("b", k, float(v)) for k, v in enumerate([2, 0, 2])] + [(None, 0, 1.0)], "s string, t long, value double")
    out = batch(df, "s", ["t"], K.LevelCrossing(1.0, True, 0), ["t"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, True), ("a", 3, True), ("b", 2, True)]
    assert batch(df.where("false"), "s", ["t"], K.Smoother(), ["t"]).count() == 0


def test_segments_carry_state():
    rows = pd.DataFrame({"k": [1, 1, 2, 2], "value": [0.0, 2.0, 0.0, 2.0]})
    states: dict = {}
    k = K.LevelCrossing(1.0, True, 0)
    parts = [run_segments(k, states, rows.iloc[a:b], "k", ["k"], True) for a, b in ((0, 1), (1, 3), (3, 4))]
    assert pd.concat(parts)["k"].tolist() == [1, 2]


def test_coincidence_as_rows_come():
    rng = np.random.default_rng(5)
    rows = sorted((int(t), int(k), bool(b)) for t, k, b in zip(rng.integers(0, 4000, 500), rng.integers(0, 4, 500), rng.random(500) > 0.1, strict=True))
    rows.append((10**6, 0, True))  # the end decides what waits
    kernel = K.Coincidence(20, 15, 6, 2)
    state, got = kernel.init(), []
    for a, b in ((0, 7), (7, 200), (200, 501)):
        out = kernel.step(state, {c: np.array([r[i] for r in rows[a:b]]) for i, c in enumerate(("hw_ts", "slot", "target"))})[1]
        got += zip(out["at"], out["slot"], out["n_slots"], strict=True)
    blockers = [t for t, _, x in rows if not x]
    expected = []
    for t, k, x in rows[:-1]:
        n = len({o for u, o, y in rows if y and t - 20 < u <= t})
        if x and n >= 2 and not any(t - 15 <= b <= t or t < b < t + 6 for b in blockers):
            expected.append((t, k, n))
    assert sorted(got) == sorted(expected)
