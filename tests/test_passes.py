"""How often rows are handed to Python and made again; and times that repeat."""

import contextlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import events as ev
from rivulet.operators import kernels as K
from rivulet.operators import packets as pk
from rivulet.plans.oracle import ORACLE
from rivulet.plans.queries import QUERIES


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_ripple_graph_takes_one_pass_a_signal(spark, data):
    found = plan(QUERIES["graph_ripple"](spark, data))
    assert found.count("MapInPandas") == 2 and "Join" not in found


def test_packets_are_made_once(spark):
    made = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda k: (k + F.col("id")).cast("int")).alias("words"))
    assert plan(pk.decode(made, 4).where("error = 0")).count("sequence(0, 21") + plan(pk.decode(made, 4).where("error = 0")).count("UnsafeArrayData") == 1


def test_ripple_graph_with_repeated_times(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT (i * 7919) % 3000 AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 8 * 11) HOUR AS ts, i % 4 AS user_id, 'view' AS event_type, (hash(i) % 10007) / 100.0::DOUBLE AS value, '{{}}' AS props
      FROM range(3000) t(i)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.sql(f"SELECT stream_id, hw_ts, message FROM ({ORACLE['graph_ripple']})").fetchall()
    assert expected and sorted(map(tuple, QUERIES["graph_ripple"](spark, str(tmp_path)).select("stream_id", "hw_ts", "message").collect())) == sorted(expected)


def test_unblocked_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(t), k) for k, (u, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 400, 80), strict=True))] + [(0, None, 80)]
    blocks = [(int(u), int(t)) for u, t in zip(rng.integers(0, 3, 12), rng.integers(0, 400, 12), strict=True)] + [(0, None)]
    out = ev.unblocked(spark.createDataFrame(rows, "u long, hw_ts long, k long"), spark.createDataFrame(blocks, "u long, hw_ts long"), ["u"], 20, 7)
    free = lambda u, t: t is not None and not any(v == u and b is not None and (0 <= t - b <= 20 or 0 < b - t < 7) for v, b in blocks)
    assert {r.k: r.free for r in out.collect()} == {k: free(u, t) for u, t, k in rows}


@pytest.mark.parametrize("first", [K.Fir((0.5, -0.25, 0.25)), K.Biquad(((0.2, 0.4, 0.2, 1.0, -0.3, 0.1),))])
@pytest.mark.parametrize("then", [K.LevelCrossing(0.5, True, 1), K.Oscillation(1.0, 4.0, 1000.0, 1.0), K.Chain(K.Fir((1.0, 1.0)), K.Spike(0.5, True, 3))])
def test_chain_equals_its_kernels_in_turn(first, then):
    rng = np.random.default_rng(5)
    x = {"value": np.array([*map(list, rng.normal(size=(200, 2)))] + [None], object)[:-1], "hw_ts": np.arange(200)}
    _, made = first.step(first.init(), x)
    expected = then.step(then.init(), x | {"value": np.array([*made["filtered"], None], object)[:-1]})
    chain = K.Chain(first, then)
    state, rows, out = chain.init(), [], {c: [] for c in expected[1]}
    for lo, hi in ((0, 1), (1, 64), (64, 64), (64, 200)):
        found, values = chain.step(state, {c: v[lo:hi] for c, v in x.items()})
        rows += [lo + k for k in found]
        for c in out:
            out[c] += values[c]
    assert rows == expected[0] and rows
    for c in out:
        assert np.allclose(np.array(out[c], float), np.array(expected[1][c], float))


def test_ragged_samples_fail():
    with pytest.raises(ValueError, match="number of channels"):
        K.vectors(np.array([[1.0, 2.0], [1.0, 2.0, 3.0]], object))
