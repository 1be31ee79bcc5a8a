"""DuckDB SQL with the results of the registered queries. Sequential kernels are recursive queries, a row at a time."""

from __future__ import annotations

HOUR, DAY = 3_600_000_000, 86_400_000_000
E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS hw_ts, event_type AS event, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
DIV = "(hw_ts // 3600000000)"


def fold(init: str, step: str, out: str, where: str = "true", state_filter: str = "true", extra: str = "", source: str = "e", key: str = "user_id", order: str = "hw_ts, event_id", carry: str = "*") -> str:
    """A kernel: state columns start as init and become step from the state r and the next row s; out is read from r."""
    return f"""
WITH RECURSIVE {E}{extra}, s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} WHERE {where}),
r AS (
  SELECT NULL::BIGINT AS id, {key} AS u, 0::BIGINT AS n, {init} FROM (SELECT DISTINCT {key} FROM s)
  UNION ALL
  SELECT s.id_, s.{key}, s.rn, {step} FROM r JOIN (SELECT *, event_id AS id_ FROM s) s ON s.{key} = r.u AND s.rn = r.n + 1
)
SELECT {out} FROM r WHERE n > 0 AND {state_filter}"""


def fir(taps: tuple[float, ...]) -> str:
    w = "(PARTITION BY user_id ORDER BY hw_ts, event_id)"
    terms = " + ".join(f"coalesce(lag(value, {k}) OVER {w}, 0::DOUBLE) * {t!r}::DOUBLE" for k, t in enumerate(taps))
    return f"WITH {E} SELECT event_id, round({terms}, 6) AS filtered FROM e"


def mean_mad(protect: str | None) -> str:
    alpha = "CASE WHEN n < 5 THEN 0.1::DOUBLE + 0.9::DOUBLE / (n + 1) " + (f"WHEN {protect} THEN 0.1::DOUBLE * pow(2::DOUBLE, (2::DOUBLE - abs((value - c) / d)) / 2::DOUBLE) " if protect else "") + "ELSE 0.1::DOUBLE END"
    return fold(
        "0::DOUBLE AS c, 0::DOUBLE AS d",
        f"(1 - ({alpha})) * c + ({alpha}) * value, (1 - ({alpha})) * d + ({alpha}) * abs(value - ((1 - ({alpha})) * c + ({alpha}) * value))",
        "id AS event_id, c AS center, d AS dispersion",
    )


def oscillation(v: str, burn: int, dev: float, block: int, alpha: float, out: str, **options) -> str:
    """One sample to a bucket; in the burn-in the weight of sample k is a + (1 - a) / k."""
    a0, a = f"({1 / burn!r}::DOUBLE + (1 - {1 / burn!r}::DOUBLE) / (n + 1))", f"{alpha!r}::DOUBLE"
    test, thr = f"abs({v} - c)", f"{dev!r}::DOUBLE * d"
    live, open_ = f"n >= {burn}", "left_ = 0"
    add_c = lambda w: f"((1 - {w}) * c + {w} * {v})"
    add_d = lambda w: f"((1 - {w}) * d + {w} * abs({v} - {add_c(w)}))"
    fire = f"({live} AND {open_} AND prev <= {thr} AND {test} > {thr})"
    step = f"""CASE WHEN NOT {live} THEN {add_c(a0)} WHEN {open_} THEN {add_c(a)} ELSE c END, CASE WHEN NOT {live} THEN {add_d(a0)} WHEN {open_} THEN {add_d(a)} ELSE d END,
      CASE WHEN {live} AND {open_} THEN {test} ELSE prev END, CASE WHEN {fire} THEN {block} WHEN {live} AND left_ > 0 THEN left_ - 1 ELSE left_ END,
      {test}, {thr}, {fire}, {live} AND left_ > 0, {live}"""
    init = "0::DOUBLE AS c, 0::DOUBLE AS d, 'infinity'::DOUBLE AS prev, 0 AS left_, 0::DOUBLE AS test, 0::DOUBLE AS thr, false AS fired, false AS locked, false AS live"
    return fold(init, step, out, state_filter="live", **options)


LEVEL = lambda p, x, up: f"{p} <= 50 AND {x} > 50" if up else f"{p} >= 50 AND {x} < 50"
W = "OVER (PARTITION BY user_id ORDER BY hw_ts, event_id)"
SLOPE = tuple(k / 60 for k in (4, 3, 2, 1, 0, -1, -2, -3, -4))

BLOCKED = fold(
    "NULL::DOUBLE AS prev, 0 AS left_, false AS fired",
    "CASE WHEN left_ = 0 OR left_ = 1 THEN value ELSE prev END, CASE WHEN left_ > 0 THEN left_ - 1 WHEN prev <= 50 AND value > 50 THEN 2 ELSE 0 END, left_ = 0 AND coalesce(prev <= 50 AND value > 50, false)",
    "id AS event_id", state_filter="fired",
)

SPIKES = fold(
    "0::DOUBLE AS prev, 0::DOUBLE AS slope, false AS searching, 0 AS left_, 0::BIGINT AS ts, 0::DOUBLE AS amp, false AS done, false AS peaked",
    """value,
      CASE WHEN searching AND (left_ = 1 OR (slope > 0 AND value < prev)) THEN slope WHEN (searching OR (prev <= 60 AND value > 60)) AND value <> prev THEN value - prev ELSE slope END,
      CASE WHEN searching THEN NOT (left_ = 1 OR (slope > 0 AND value < prev)) ELSE prev <= 60 AND value > 60 END,
      CASE WHEN searching THEN left_ - 1 WHEN prev <= 60 AND value > 60 THEN 4 ELSE left_ END,
      CASE WHEN NOT searching AND prev <= 60 AND value > 60 THEN hw_ts ELSE ts END,
      CASE WHEN NOT searching AND prev <= 60 AND value > 60 THEN prev WHEN searching AND slope > 0 AND value < prev THEN prev ELSE amp END,
      searching AND slope > 0 AND value < prev, true""",
    "id AS event_id, ts AS spike_ts, amp AS amplitude", state_filter="done",
)

SECTION = "value + 0.5::DOUBLE * p0 - 0.25::DOUBLE * p1"
FIRST = f"(0.2::DOUBLE * ({SECTION}) + 0.4::DOUBLE * p0 + 0.2::DOUBLE * p1)"
SECOND = f"({FIRST} - 0.3::DOUBLE * q0)"
CLICKS = "event IN ('click', 'view')"

MISSED = f"missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END"
#: A standard normal number by the hash of seed, salt and number n.
UNIFORM = "((('0x' || substr(md5('{{k}}:{salt}:' || {{n}}), 1, 12))::BIGINT + 1) / 281474976710656::DOUBLE)"
NORMAL = f"(sqrt(-2 * ln({UNIFORM.format(salt=1)})) * cos(6.283185307179586::DOUBLE * {UNIFORM.format(salt=2)}))"


def detector(v: str, burn: int, warm: int, dev: float, block: int, alpha: float, bucket: int = 1, on: str = "true") -> dict[str, str]:
    """Next values of an oscillation detector's state: c, d, thr, prev, left_, and what it says of the row."""
    a0, a = f"({1 / burn!r}::DOUBLE + (1 - {1 / burn!r}::DOUBLE) / (n + 1))", f"{alpha!r}::DOUBLE"
    live, open_ = f"n >= {warm}", f"(left_ = 0 AND {on})"
    thr = f"CASE WHEN {live} AND n % {bucket} = 0 THEN {dev!r}::DOUBLE * d ELSE thr END"
    test = f"abs({v} - c)"
    c = lambda w: f"((1 - {w}) * c + {w} * {v})"
    d = lambda w: f"((1 - {w}) * d + {w} * abs({v} - {c(w)}))"
    pick = lambda f, same: f"CASE WHEN n < {burn} THEN {f(a0)} WHEN n < {warm} THEN {f(f'{1 / burn!r}::DOUBLE')} WHEN {open_} THEN {f(a)} ELSE {same} END"
    fired = f"({live} AND {open_} AND prev <= ({thr}) AND {test} > ({thr}))"
    return {
        "c": pick(c, "c"), "d": pick(d, "d"), "thr": thr, "prev": f"CASE WHEN {live} AND {open_} THEN {test} ELSE prev END", "left_": f"CASE WHEN {fired} THEN {block} WHEN {live} AND left_ > 0 THEN left_ - 1 ELSE left_ END",
        "test": test, "fired": fired, "locked": f"{live} AND left_ > 0", "live": live,
    }


START = {"c": "0::DOUBLE", "d": "0::DOUBLE", "thr": "0::DOUBLE", "prev": "'infinity'::DOUBLE", "left_": "0", "test": "0::DOUBLE", "fired": "false", "locked": "false", "live": "false"}


def loop(step: dict[str, str], out: str, more: dict[str, tuple[str, str]], **options) -> str:
    """A fold of a detector's state and more: (first value, next value) by name."""
    init = ", ".join([f"{START[k]} AS {k}" for k in step] + [f"{x} AS {k}" for k, (x, _) in more.items()])
    return fold(init, ", ".join([*step.values(), *(y for _, y in more.values())]), out, **options)


BUCKETS = loop(
    detector("(value * value)", 10, 12, 2.0, 3, 0.1, 4), "id AS event_id, round(test, 4) AS test_value, round(thr, 4) AS threshold, fired AS detected, locked, shown",
    {"shown": ("false", "n >= 12 AND (n - 12) % 3 = 0")}, state_filter="(shown OR fired)",
)
CLOSED = loop(
    detector("(value * value)", 10, 10, 2.0, 0, 0.1, 1, "hw_ts >= until"), "u AS stream_id, t AS hw_ts, 'o' AS event",
    {"until": ("0::BIGINT", f"CASE WHEN {detector('(value * value)', 10, 10, 2.0, 0, 0.1, 1, 'hw_ts >= until')['fired']} THEN hw_ts + {2 * DAY} ELSE until END"), "t": ("0::BIGINT", "hw_ts")}, state_filter="fired",
)

HIT = (
    "NULL::DOUBLE AS prev, 0 AS left_, false AS fired, 0::BIGINT AS t",
    "CASE WHEN left_ <= 1 THEN value ELSE prev END, CASE WHEN left_ > 0 THEN left_ - 1 WHEN prev <= 60 AND value > 60 THEN 1 ELSE 0 END, left_ = 0 AND coalesce(prev <= 60 AND value > 60, false), hw_ts",
    "u AS user_id, t AS hw_ts",
)
HALF = "0.5::DOUBLE * value + 0.5::DOUBLE * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY hw_ts, event_id), 0)"
LAST = lambda hits, blocks, before, after: f"""SELECT h.* FROM ({hits}) h WHERE NOT EXISTS (SELECT 1 FROM ({blocks}) b WHERE b.user_id = h.user_id AND b.hw_ts >= h.hw_ts - {before} AND b.hw_ts <= h.hw_ts)
  AND NOT EXISTS (SELECT 1 FROM ({blocks}) b WHERE b.user_id = h.user_id AND b.hw_ts > h.hw_ts AND b.hw_ts < h.hw_ts + {after})"""  # noqa: E731
GRAPH = fold(
    "NULL::BIGINT AS prev, false AS fired", f"CASE WHEN prev IS NULL OR hw_ts - prev > {DAY} THEN hw_ts ELSE prev END, prev IS NULL OR hw_ts - prev > {DAY}", "u AS stream_id, prev AS hw_ts, 'o' AS event", state_filter="fired",
    extra=f""", ha AS ({fold(*HIT, state_filter="fired", source="x", extra=f", x AS (SELECT event_id, user_id, hw_ts, {HALF} AS value FROM e WHERE event_id % 2 = 0)")}),
      hb AS ({fold(*HIT, "event_id % 2 = 1", "fired")}), g AS (SELECT hw_ts AS event_id, user_id, hw_ts FROM ({LAST("SELECT * FROM ha", "SELECT * FROM hb", DAY // 2, 0)}))""",
    source="g", order="hw_ts",
)

GRAPH_EVENTS = """
WITH t AS (SELECT i * 333000 AS hw_ts FROM range(600) t(i)), b AS (SELECT i * 50000 AS hw_ts FROM range(4000) t(i)),
f AS (SELECT t.hw_ts FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.hw_ts BETWEEN t.hw_ts - 10000 AND t.hw_ts) AND NOT EXISTS (SELECT 1 FROM b WHERE b.hw_ts > t.hw_ts AND b.hw_ts < t.hw_ts + 2000))
SELECT hw_ts, 'target' AS event, (SELECT count(*) FROM f) AS n_all, (SELECT count(*) FROM f) AS n_target FROM f"""

GRAPH_PACKETS = """
WITH p AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS total, 31 * (vec_id - lag(vec_id) OVER (ORDER BY vec_id)) AS gap FROM embeddings WHERE vec_id % 40 NOT BETWEEN 5 AND 15),
m AS (SELECT *, sum(CASE WHEN gap > 32 THEN CAST(floor(gap / 31.25::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END) OVER (ORDER BY n) AS missed FROM p WHERE n <= total // 10 * 10),
c AS (SELECT *, CASE WHEN n % 10 = 0 THEN 10 * (missed // 10 - coalesce(lag(missed, 10) OVER (ORDER BY n), 0) // 10) ELSE 0 END::BIGINT AS copies FROM m),
r AS (SELECT *, unnest(range(copies + 1)) AS copy FROM c)
""" + " UNION ALL ".join(f"SELECT '{port}' AS port, vec_id AS arrival, copy, vec_id * 31 AS hw_ts, (vec_id % 256)::INTEGER AS digital, " + ", ".join(f"round(round(embedding[{k + c + 1}]::DOUBLE * 1000) * 0.015624999960550667::DOUBLE, 6) + 0::DOUBLE AS v{c}" for c in range(4)) + " FROM r" for port, k in (("a", 1), ("b", 5)))

RAW = lambda c: f"((round(value * 100) * {c + 1} - event_id * {c + 3} % 1000) * 0.015624999960550667::DOUBLE)"
FILTERED = lambda c: f"(0.5::DOUBLE * x{c} - 0.25::DOUBLE * coalesce(lag(x{c}) {W}, 0) + 0.25::DOUBLE * coalesce(lag(x{c}, 2) {W}, 0))"
SIGNALS = f", w AS (SELECT event_id, user_id, hw_ts, {', '.join(f'{RAW(c)} AS x{c}' for c in (1, 2, 3))} FROM e), y AS (SELECT event_id, user_id, hw_ts, {', '.join(f'{FILTERED(c)} AS y{c}' for c in (1, 2, 3))} FROM w)"
SECOND_ = loop(detector("v", 10, 10, 2.0, 2, 0.1), "u AS user_id, t AS hw_ts", {"t": ("0::BIGINT", "hw_ts")}, state_filter="fired", source="z", extra=SIGNALS + ", z AS (SELECT event_id, user_id, hw_ts, y2 * y2 AS v FROM y)")
FIRST_ = detector("v", 10, 10, 1.5, 2, 0.1, 1, "hw_ts >= until")
SENT = f"({FIRST_['fired']} AND free AND (told IS NULL OR hw_ts - told > {25 * HOUR}))"
GRAPH_RIPPLE = loop(
    FIRST_, "u AS stream_id, told AS hw_ts, 'o' AS message",
    {"until": ("0::BIGINT", f"CASE WHEN {SENT} THEN hw_ts + {12 * HOUR} ELSE until END"), "told": ("NULL::BIGINT", f"CASE WHEN {SENT} THEN hw_ts ELSE told END"), "sent": ("false", f"coalesce({SENT}, false)")},
    state_filter="sent", source="z",
    extra=SIGNALS + f""", k AS ({SECOND_}), z AS (SELECT event_id, user_id, hw_ts, (y1 * y1 + y3 * y3) / 2 AS v,
      NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = y.user_id AND k.hw_ts >= y.hw_ts - {DAY} AND k.hw_ts <= y.hw_ts) AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = y.user_id AND k.hw_ts > y.hw_ts AND k.hw_ts < y.hw_ts + {HOUR}) AS free FROM y)""",
)

PULSES = f"""
WITH {E}, q AS (SELECT *, last_value(CASE event WHEN 'click' THEN 1 WHEN 'error' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hw_ts, event_id) AS c0,
  last_value(CASE event WHEN 'click' THEN 1 WHEN 'error' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hw_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0_before,
  max(CASE WHEN event = 'purchase' THEN hw_ts END) {W} AS pulsed FROM e),
p AS (SELECT user_id, hw_ts + {12 * HOUR} AS due, lead(hw_ts) {W} AS again FROM e WHERE event = 'purchase')
SELECT event_id, hw_ts AS at, coalesce(c0, 0) || '0' || coalesce(hw_ts - pulsed < {12 * HOUR}, false)::INTEGER || '0' AS state FROM q WHERE event IN ('purchase', 'click', 'error')
UNION ALL
SELECT q.event_id, p.due AS at, coalesce(q.c0_before, 0) || '000' AS state FROM p ASOF JOIN q ON p.user_id = q.user_id AND p.due <= q.hw_ts WHERE again IS NULL OR again >= due"""

NOW = "list_transform(embedding, lambda x: -(x::DOUBLE))"
FRESH = f"list_transform({NOW}, lambda x, i: NOT peaks[i] AND slopes[i] > 0 AND x < prev[i])"
PEAKED = f"list_transform({FRESH}, lambda f, i: peaks[i] OR f)"
AMPS = f"list_transform({FRESH}, lambda f, i: CASE WHEN f THEN prev[i] ELSE amps[i] END)"
OPEN_ = f"list_bool_or(list_transform({NOW}, lambda x, i: prev[i] <= 0.2::DOUBLE AND x > 0.2::DOUBLE))"
DONE = f"(searching AND (left_ = 1 OR list_bool_and({PEAKED})))"
SPIKES_64 = fold(
    "list_transform(range(64), lambda i: 0::DOUBLE) AS prev, list_transform(range(64), lambda i: 0::DOUBLE) AS slopes, false AS searching, 0 AS left_, 0::BIGINT AS ts, list_transform(range(64), lambda i: false) AS peaks, list_transform(range(64), lambda i: 0::DOUBLE) AS amps, false AS done",
    f"""{NOW}, CASE WHEN (searching AND NOT {DONE}) OR (NOT searching AND {OPEN_}) THEN list_transform({NOW}, lambda x, i: CASE WHEN x <> prev[i] THEN x - prev[i] ELSE slopes[i] END) ELSE slopes END,
      CASE WHEN searching THEN NOT {DONE} ELSE {OPEN_} END, CASE WHEN searching THEN left_ - 1 WHEN {OPEN_} THEN 3 ELSE left_ END, CASE WHEN NOT searching AND {OPEN_} THEN event_id ELSE ts END,
      CASE WHEN searching THEN {PEAKED} WHEN {OPEN_} THEN list_transform(range(64), lambda i: false) ELSE peaks END, CASE WHEN searching THEN {AMPS} WHEN {OPEN_} THEN prev ELSE amps END,
      {DONE} AND list_bool_or({PEAKED})""",
    "id AS vec_id, ts AS spike_ts, array_to_string(list_transform(amps, lambda a: round(-a * 1000000)::BIGINT::VARCHAR), ',') AS amplitudes", state_filter="done",
    extra=", m AS (SELECT vec_id AS event_id, vec_id % 8 AS stream, embedding FROM embeddings)", source="m", key="stream", order="event_id",
)

ORACLE = {
    "distributor": "SELECT vec_id, port, position, embedding[c + 1]::DOUBLE AS value FROM embeddings, (VALUES ('cx', 0, 9), ('cx', 1, 0), ('cx', 2, 9), ('hp', 0, 1), ('hp', 1, 2), ('hp', 2, 3)) t(port, position, c)",
    "sample_stats": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
      SELECT vec_id, round(list_sum(v), 6) AS total, round(list_sum(v) / len(v), 6) AS mean, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS total_abs,
        round(list_sum(list_transform(v, lambda x: abs(x))) / len(v), 6) AS mean_abs, round(list_sum(list_transform(v, lambda x: x * x)) / len(v), 6) AS power FROM v""",
    "event_convert": "SELECT event_id, event_type || '_x' AS appended, 'stimulation' AS replaced FROM events",
    "event_to_state": "SELECT event_id, 'purchase' AS event, event_type = 'purchase' AS enabled FROM events",
    "state_changes": f"WITH {E}, c AS (SELECT *, lag(event = 'purchase') {W} AS before FROM e) SELECT event_id, user_id, event = 'purchase' AS enabled FROM c WHERE before IS NULL OR before <> (event = 'purchase')",
    "event_log": "SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE event_type = 'purchase') AS n_target, count(*) FILTER (WHERE event_type <> 'purchase') AS n_other FROM events GROUP BY user_id",
    "rebuffer": f"""WITH {E}, q AS (SELECT *, row_number() {W} - 1 AS i FROM e), k AS (SELECT *, i // 3 AS o FROM q WHERE i % 3 = 0)
      SELECT user_id, (o // 4)::BIGINT AS buffer, 4::BIGINT AS n, min(hw_ts) AS hw_ts, max(value) FILTER (WHERE o % 4 = 0) AS v0, max(value) FILTER (WHERE o % 4 = 1) AS v1,
        max(value) FILTER (WHERE o % 4 = 2) AS v2, max(value) FILTER (WHERE o % 4 = 3) AS v3 FROM k GROUP BY user_id, o // 4 HAVING count(*) = 4""",
    "firing_rate": f"WITH {E} SELECT user_id, (hw_ts // {DAY} * {DAY})::BIGINT AS bin_start, max(hw_ts) AS hw_ts, sum(k)::BIGINT AS n_spikes, sum(k)::BIGINT / 86400000.0::DOUBLE * 1000.0::DOUBLE AS mua FROM e GROUP BY ALL",
    "event_sync": f"""WITH {E}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id, event ORDER BY hw_ts, event_id) AS round FROM e)
      SELECT user_id, round, max(hw_ts) AS at FROM q GROUP BY ALL HAVING count(*) = 5""",
    "event_sync_stateful": fold(
        "[]::VARCHAR[] AS seen, 0::BIGINT AS at, 0::BIGINT AS round, false AS fired, 0::BIGINT AS at_out",
        """CASE WHEN len(list_distinct(list_append(seen, event))) = 5 THEN [] ELSE list_distinct(list_append(seen, event)) END, CASE WHEN len(list_distinct(list_append(seen, event))) = 5 THEN 0 ELSE hw_ts END,
          round + (len(list_distinct(list_append(seen, event))) = 5)::BIGINT, len(list_distinct(list_append(seen, event))) = 5, hw_ts""",
        "u AS user_id, id AS event_id, at_out AS at, round - 1 AS round", state_filter="fired",
    ),
    "event_filter": f"""WITH {E}, t AS (SELECT event_id, user_id % 50 AS stream, user_id AS slot, hw_ts FROM e WHERE event = 'purchase'), b AS (SELECT user_id % 50 AS stream, hw_ts FROM e WHERE event = 'error'),
      n AS (SELECT t.event_id, t.stream, t.slot, t.hw_ts, count(DISTINCT o.slot) AS n_slots FROM t JOIN t o ON o.stream = t.stream AND o.hw_ts <= t.hw_ts AND o.hw_ts > t.hw_ts - {24 * HOUR} GROUP BY ALL)
      SELECT * FROM n WHERE n_slots >= 2 AND NOT EXISTS (SELECT 1 FROM b WHERE b.stream = n.stream AND b.hw_ts >= n.hw_ts - {12 * HOUR} AND b.hw_ts <= n.hw_ts)
        AND NOT EXISTS (SELECT 1 FROM b WHERE b.stream = n.stream AND b.hw_ts > n.hw_ts AND b.hw_ts < n.hw_ts + {6 * HOUR})""",
    "as_of_state": f"""WITH {E}, s AS (SELECT user_id, hw_ts, event = 'signup' AS enabled FROM e WHERE event IN ('signup', 'error')), c AS (SELECT * FROM e WHERE event = 'click')
      SELECT c.event_id, s.enabled FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.hw_ts >= s.hw_ts""",
    "interleave": "SELECT event_id, event_type AS event, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS stream_id FROM events WHERE event_type IN ('click', 'error')",
    "first_packets": f"WITH {E} SELECT event_id, user_id, hw_ts, event FROM e ORDER BY hw_ts, event_id LIMIT 25",
    "trigger_one_shot": f"WITH {E}, o AS (SELECT *, max(k & 64) {W} AS open FROM e) SELECT event_id FROM o WHERE open > 0",
    "trigger_level": f"WITH {E} SELECT event_id, k AS word FROM e WHERE k & 64 > 0",
    "time_check": f"""WITH {E}, a AS (SELECT user_id, event_id, {DIV} AS t, event_id + (event_id % 7) * 400 AS arrival FROM e),
      l AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a)
      SELECT user_id, count(*) AS n, count(*) FILTER (WHERE t = last) AS n_duplicated, count(*) FILTER (WHERE t < last) AS n_out_of_order, count(*) FILTER (WHERE t - last > 3) AS n_gaps,
        coalesce(sum(CAST(floor((t - last) / 2.5::DOUBLE + 0.5) AS BIGINT) - 1) FILTER (WHERE t - last > 3), 0)::BIGINT AS n_missed FROM l GROUP BY user_id""",
    "level_cross_up": f"WITH {E}, p AS (SELECT *, lag(value) {W} AS p FROM e) SELECT event_id FROM p WHERE {LEVEL('p', 'value', True)}",
    "level_cross_down": f"WITH {E}, p AS (SELECT *, lag(value) {W} AS p FROM e) SELECT event_id FROM p WHERE {LEVEL('p', 'value', False)}",
    "level_cross_blocked": BLOCKED,
    "streaming_level_cross": BLOCKED,
    "level_cross_channels": fold(
        "NULL::FLOAT[] AS prev, 0 AS left_, false AS fired",
        """CASE WHEN left_ <= 1 THEN embedding ELSE prev END, CASE WHEN left_ > 0 THEN left_ - 1 WHEN prev IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x, i: prev[i]::DOUBLE <= 0.3::DOUBLE AND x::DOUBLE > 0.3::DOUBLE)) THEN 3 ELSE 0 END,
          left_ = 0 AND prev IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x, i: prev[i]::DOUBLE <= 0.3::DOUBLE AND x::DOUBLE > 0.3::DOUBLE))""",
        "id AS vec_id", state_filter="fired", extra=", m AS (SELECT vec_id AS event_id, vec_id % 8 AS stream, embedding FROM embeddings)", source="m", key="stream", order="event_id",
    ),
    "smoother": fold("0::DOUBLE AS v", "0.1::DOUBLE * value + (1 - 0.1::DOUBLE) * v", "id AS event_id, round(v, 6) AS smooth"),
    "running_stats": mean_mad(None),
    "running_stats_protected": mean_mad("d > 0 AND abs((value - c) / d) > 2"),
    "peaks": fold(
        "NULL::DOUBLE AS prev, NULL::BIGINT AS ts, false AS up, false AS fired, NULL::BIGINT AS peak_ts, NULL::DOUBLE AS amplitude",
        "value, hw_ts, CASE WHEN value < prev THEN false WHEN value > prev THEN true ELSE up END, coalesce(value < prev AND up, false), ts, prev",
        "id AS event_id, peak_ts, amplitude", state_filter="fired",
    ),
    "ripple": oscillation("(value * value)", 10, 2.0, 3, 0.1, "id AS event_id, round(test, 4) AS test_value, round(thr, 4) AS threshold, fired AS detected, locked"),
    "burst": oscillation("v", 5, 1.0, 2, 0.2, "u AS user_id, id AS bin_start, round(test, 6) AS test_value, round(thr, 6) AS threshold, fired AS detected",
        extra=f", b AS (SELECT user_id, (hw_ts // {DAY} * {DAY})::BIGINT AS event_id, count(*)::DOUBLE AS v FROM e GROUP BY ALL)", source="b", order="event_id"),
    "spikes": SPIKES,
    "spike_events": f"WITH x AS ({SPIKES.replace('id AS event_id, ts', 'u AS user_id, ts')}) SELECT user_id, spike_ts // {5 * DAY} AS buffer, count(*) AS n_spikes, min(spike_ts) AS hw_ts, CASE count(*) WHEN 1 THEN 'spike' ELSE 'spikes' END AS event FROM x GROUP BY ALL",
    "fir": fir((0.5, 0.3, 0.2)),
    "fir_kernel": fir((0.5, 0.3, 0.2)),
    "slope": fir(SLOPE),
    "biquad": fold(
        "0::DOUBLE AS p0, 0::DOUBLE AS p1, 0::DOUBLE AS q0, 0::DOUBLE AS y",
        f"{SECTION}, p0, {SECOND}, 0.5::DOUBLE * ({SECOND} - q0)", "id AS event_id, round(y, 6) AS filtered",
    ),
    "multichannel_filter": """WITH m AS (SELECT vec_id, embedding AS x, lag(embedding, 1) OVER w AS y, lag(embedding, 2) OVER w AS z FROM embeddings WINDOW w AS (PARTITION BY vec_id % 4 ORDER BY vec_id))
      SELECT vec_id, """ + ", ".join(f"round(0.5::DOUBLE * x[{c + 1}]::DOUBLE + 0.25::DOUBLE * coalesce(y[{c + 1}], 0)::DOUBLE + 0.25::DOUBLE * coalesce(z[{c + 1}], 0)::DOUBLE, 6) AS c{c}" for c in range(64)) + " FROM m",
    "event_delayed_detection": fold("NULL::BIGINT AS prev, false AS fired", f"CASE WHEN prev IS NULL OR hw_ts - prev > {36 * HOUR} THEN hw_ts ELSE prev END, prev IS NULL OR hw_ts - prev > {36 * HOUR}", "id AS event_id, prev AS at, 'r' AS message", CLICKS, "fired"),
    "event_delayed_ontime": fold("NULL::BIGINT AS prev, false AS fired", f"CASE WHEN prev IS NULL OR hw_ts - prev > {36 * HOUR} THEN hw_ts ELSE prev END, prev IS NULL OR hw_ts - prev > {36 * HOUR}", "id AS event_id, prev AS at, 'o' AS message", CLICKS, "fired"),
    "event_delayed": "SELECT event_id, CASE m WHEN 'r' THEN t ELSE last END AS at, m AS message FROM (" + fold(
        "NULL::BIGINT AS last, false AS fired, 0::BIGINT AS t",
        f"CASE WHEN last IS NULL OR hw_ts + event_id % 7 * {HOUR} - last > {24 * HOUR} THEN hw_ts + event_id % 7 * {HOUR} ELSE last END, last IS NULL OR hw_ts + event_id % 7 * {HOUR} - last > {24 * HOUR}, hw_ts",
        "id AS event_id, last, t", CLICKS, "fired",
    ) + "), (VALUES ('r'), ('d')) v(m)",
    "digital_state": fold(
        "[false, false, false, false] AS st, false AS shown, 0::BIGINT AS t",
        """CASE event WHEN 'click' THEN [true, true, st[3], st[4]] WHEN 'view' THEN [false, NOT st[2], st[3], st[4]] WHEN 'error' THEN [st[1], st[2], NOT st[3], st[4]] ELSE st END, event IN ('click', 'view', 'error'), hw_ts""",
        "id AS event_id, t AS at, list_aggregate(list_transform(st, lambda b: CASE WHEN b THEN '1' ELSE '0' END), 'string_agg', '') AS state", state_filter="shown",
    ),
    "throttle": f"SELECT event_id, round(level, 9) AS level, CASE WHEN level < 0.5 THEN CASE WHEN level = 0 OR every > k THEN k ELSE k - (k + every - 1) // every END ELSE CASE WHEN level = 1 OR every > k THEN 0 ELSE (k + every - 1) // every END END::BIGINT AS kept FROM (SELECT *, CASE WHEN 0.5 - abs(level - 0.5) > 0 THEN floor(1 / (0.5::DOUBLE - abs(level - 0.5::DOUBLE)))::BIGINT ELSE 1 END AS every FROM ("
    + fold("0::DOUBLE AS level, 0::BIGINT AS k", "level * (1 - 0.5::DOUBLE) + CASE WHEN s.k > 0.3::DOUBLE * 200 THEN 0.5::DOUBLE ELSE 0 END, s.k", "id AS event_id, level, k") + "))",
    "gap_fill": fold(
        "NULL::BIGINT AS last, 0::BIGINT AS missed, 0::BIGINT AS filled, 0::BIGINT AS copies",
        f"""greatest(last, {DIV}), missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END,
          filled + CASE WHEN (n + 1) % 2 = 0 AND missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END - filled >= 2
            THEN (missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END - filled) // 2 * 2 ELSE 0 END,
          CASE WHEN (n + 1) % 2 = 0 AND missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END - filled >= 2
            THEN (missed + CASE WHEN {DIV} - last > 11 THEN CAST(floor(({DIV} - last) / 10.0::DOUBLE + 0.5) AS BIGINT) - 1 ELSE 0 END - filled) // 2 * 2 ELSE 0 END""",
        "id AS event_id, copies",
    ),
    "packet_decode": f"""WITH {E}, p AS (SELECT event_id, hw_ts, value, CASE WHEN event_id % 23 = 11 THEN 4 WHEN event_id % 11 = 3 THEN 2 WHEN event_id % 13 = 5 THEN 3 WHEN event_id % 17 = 7 THEN 5 WHEN event_id % 19 = 9 THEN 1 ELSE 0 END AS error FROM e)
      SELECT event_id, error, CASE WHEN error = 0 THEN hw_ts END AS hw_ts, CASE WHEN error = 0 THEN (event_id % 256)::INTEGER END AS digital, """
    + ", ".join(f"CASE WHEN error = 0 THEN round((round(value * 100) * {c + 1} - event_id % 1000)::DOUBLE * 0.015624999960550667::DOUBLE, 9) END AS v{c}" for c in range(4)) + " FROM p",
    "message_unpack": "SELECT vec_id AS message_id, vec_id * 8 + i AS hw_ts, " + ", ".join(f"round(embedding[{c} * 8 + i + 1]::DOUBLE, 6) AS c{c}" for c in range(8)) + " FROM embeddings, range(8) t(i)",
    "message_gaps": "WITH v AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events WHERE event_type = 'view') SELECT user_id, count(*) FILTER (WHERE d <> 1) AS n_gaps, count(*) AS n_messages FROM v GROUP BY user_id",
    "source_sine": "SELECT i AS seq, i * 1000 AS hw_ts, round(1.0 + 2.0 * sin(2 * 3.141592653589793::DOUBLE * 5.0 * (i * 1000) / 1e6), 6) AS value FROM range(2000) t(i)",
    "source_square": "SELECT i AS seq, i * 1000 AS hw_ts, CASE WHEN i % 250 < 75 THEN 3.0::DOUBLE ELSE -3.0::DOUBLE END AS value FROM range(2000) t(i)",
    "source_events": "SELECT i AS serial, i * 33000 AS hw_ts, ['foo', 'bar', 'baz'][1 + ('0x' || substr(md5('7:' || i), 1, 8))::BIGINT % 3] AS event FROM range(1000) t(i)",
    "source_noise": f"SELECT i AS seq, i * 31 AS hw_ts, round({NORMAL.format(k='0', n='i')}, 6) AS value FROM range(2000) t(i)",
    "source_ripple": f"""WITH x AS (SELECT i AS seq, i * 125 AS hw_ts, i % 1200 AS phase, i // 1200 AS n FROM range(4000) t(i)),
      d AS (SELECT *, greatest(0, round(100 + {NORMAL.format(k='0', n='n')} * 10)) AS drawn, phase - 800::DOUBLE AS c FROM x)
      SELECT seq, hw_ts, round(CASE WHEN phase >= 400 THEN drawn * exp(-0.5 * pow(c * 4.0 / 800, 2)) * cos(c * (6.283185307179586::DOUBLE * 200 / 8000)) ELSE 0 END, 6) + 0::DOUBLE AS value FROM d""",
    "ripple_buckets": BUCKETS,
    "spikes_channels": SPIKES_64,
    "gap_fill_distributed": "SELECT event_id, unnest(range(copies + 1)) AS copy FROM (" + fold(
        "NULL::BIGINT AS last, 0::BIGINT AS missed, 0::BIGINT AS filled, 0::BIGINT AS copies",
        f"greatest(last, {DIV}), {MISSED}, filled + CASE WHEN (n + 1) % 2 = 0 AND {MISSED} - filled >= 2 THEN 2 ELSE 0 END, CASE WHEN (n + 1) % 2 = 0 AND {MISSED} - filled >= 2 THEN 2 ELSE 0 END",
        "id AS event_id, copies",
    ) + ")",
    "digital_pulse": PULSES,
    "graph": GRAPH,
    "closed_loop": CLOSED,
    "graph_events": GRAPH_EVENTS,
    "graph_packets": GRAPH_PACKETS,
    "graph_ripple": GRAPH_RIPPLE,
    "fir_chunked": fir((0.5, 0.3, 0.2)).replace("PARTITION BY user_id ", ""),
    "level_cross_chunked": f"WITH {E}, p AS (SELECT *, lag(value) OVER (ORDER BY hw_ts, event_id) AS p FROM e) SELECT event_id FROM p WHERE {LEVEL('p', 'value', True)}",
    "rebuffer_chunked": f"""WITH {E}, q AS (SELECT *, row_number() OVER (ORDER BY hw_ts, event_id) - 1 AS i FROM e), k AS (SELECT *, i // 3 AS o FROM q WHERE i % 3 = 0)
      SELECT (o // 4)::BIGINT AS buffer, 4::BIGINT AS n, min(hw_ts) AS hw_ts, {", ".join(f"max(value) FILTER (WHERE o % 4 = {j}) AS v{j}" for j in range(4))} FROM k GROUP BY o // 4 HAVING count(*) = 4""",
    "time_check_chunked": f"""WITH {E}, a AS (SELECT event_id, {DIV} AS t, event_id + (event_id % 7) * 400 AS arrival FROM e),
      l AS (SELECT *, max(t) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a)
      SELECT 0 AS stream_id, count(*) AS n, count(*) FILTER (WHERE t = last) AS n_duplicated, count(*) FILTER (WHERE t < last) AS n_out_of_order, count(*) FILTER (WHERE t - last > 3) AS n_gaps,
        coalesce(sum(CAST(floor((t - last) / 2.5::DOUBLE + 0.5) AS BIGINT) - 1) FILTER (WHERE t - last > 3), 0)::BIGINT AS n_missed FROM l""",
    "serialized": f"WITH {E} SELECT event_id, hw_ts, event AS stream_id FROM e",
}
