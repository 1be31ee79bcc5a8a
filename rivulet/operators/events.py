"""Algebra of event streams, as native expressions: event time throughout, no arrival order.

Columns: hw_ts (microseconds), event, and where streams are joined slot; `by` names the columns that keep streams apart.
Null hw_ts never match anything in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def convert(events: DataFrame, name: str = "stimulation", replace: bool = True) -> DataFrame:
    """Renames every event, or appends to its name."""
    return events.withColumn("event", F.lit(name) if replace else F.concat("event", F.lit(name)))


def to_state(events: DataFrame, target: str) -> DataFrame:
    """The target once for each event, and whether the event was the target; a null event is not."""
    return events.withColumn("enabled", F.coalesce(F.col("event") == target, F.lit(False))).withColumn("event", F.lit(target))


def changes(states: DataFrame, by: Sequence[str], order: Sequence[str], state: str = "enabled") -> DataFrame:
    """Rows where the state differs from the one before in its stream; a stream's first row is one."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    return states.withColumn("_before", before).where(~F.col(state).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def log(events: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Counts of all, target and other events; null events are others."""
    hit = F.coalesce(F.col("event") == target, F.lit(False))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(hit).alias("n_target"), F.count_if(~hit).alias("n_other"))


def interleave(*streams: DataFrame, name: str = "stream_id") -> DataFrame:
    """Union with the number of the stream."""
    tagged = [s.withColumn(name, F.lit(k)) for k, s in enumerate(streams)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out


def sync_rounds(events: DataFrame, target: Column, slots: int, by: Sequence[str] = ()) -> DataFrame:
    """Round k joins the k-th event of every slot: round, at (latest hw_ts) and n_target, for full rounds whose events are all
    the target. Rounds are numbered from 1 in order of (hw_ts, serial) within by and slot."""
    k = F.row_number().over(Window.partitionBy(*by, "slot").orderBy("hw_ts", "serial"))
    rounds = events.withColumn("round", k).groupBy(*by, "round").agg(F.count(F.lit(1)).alias("n"), F.count_if(target).alias("n_target"), F.max("hw_ts").alias("at"))
    return rounds.where((F.col("n") == slots) & (F.col("n_target") == slots)).select(*by, "round", "at", "n_target")


def coincidence_filter(
    targets: DataFrame, blockers: DataFrame, by: Sequence[str], sync_us: int = 3_500, block_us: int = 10_000, wait_us: int = 1_500, needed: int = 1
) -> DataFrame:
    """Targets on at least `needed` slots within sync_us (strictly less before), unless a blocker comes at most block_us
    before, at the same time, or less than wait_us after. Adds n_slots.

    One shuffle by `by` serves all windows, and each of them is a running aggregate, so a stream costs a sort however dense it
    is: the last blocker at or before and the first one after are running extremes (the latter from the end), and the number
    of slots is a running sum over steps up, where a slot's event begins to count, and down, where it ends to: after
    sync_us, or at the slot's next event.
    """
    both = targets.withColumn("_t", F.lit(True)).unionByName(blockers.withColumn("_t", F.lit(False)), allowMissingColumns=True).where("hw_ts is not null").repartition(*by)
    following = F.lead("hw_ts").over(Window.partitionBy(*by, "_t", "slot").orderBy("hw_ts"))
    both = both.withColumn("_end", F.least(following, F.col("hw_ts") + sync_us))
    step = lambda at, n, own: F.struct(F.col(at).alias("at"), F.lit(n).alias("n"), F.lit(own).alias("own"))
    steps = F.when(F.col("_t"), F.array(step("hw_ts", 1, True), step("_end", -1, False))).otherwise(F.array(step("hw_ts", 0, False)))
    both = both.withColumn("_s", F.explode(steps)).withColumn("_at", F.col("_s.at"))
    time = Window.partitionBy(*by).orderBy("_at")
    blocked = F.when(~F.col("_t"), F.col("_at"))
    slots = F.sum("_s.n").over(time.rangeBetween(Window.unboundedPreceding, 0))
    last = F.max(blocked).over(time.rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*by).orderBy((-F.col("_at")).alias("_back")).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("n_slots", slots).withColumn("_last", last).withColumn("_next", F.min(blocked).over(back)).where("_s.own")
    free = F.coalesce(F.col("hw_ts") - F.col("_last") > block_us, F.lit(True)) & F.coalesce(F.col("_next") - F.col("hw_ts") >= wait_us, F.lit(True))
    return seen.where(free & (F.col("n_slots") >= needed)).drop("_t", "_last", "_next", "_end", "_s", "_at")


def unblocked(rows: DataFrame, blockers: DataFrame, by: Sequence[str], block_us: int, wait_us: int, name: str = "free") -> DataFrame:
    """All rows, with whether no blocker comes at most block_us before, at the same time, or less than wait_us after. A row
    without a time is not free. blockers: by and hw_ts.

    The windows of `coincidence_filter` over the rows themselves, which are neither made twice nor joined to their own times.
    """
    marks = blockers.where("hw_ts is not null").select(*by, "hw_ts").withColumn("_t", F.lit(False))
    both = rows.withColumn("_t", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartition(*by)
    blocked = F.when(~F.col("_t"), F.col("hw_ts"))
    last = F.max(blocked).over(Window.partitionBy(*by).orderBy("hw_ts").rangeBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*by).orderBy((-F.col("hw_ts")).alias("_back")).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_last", last).withColumn("_next", F.min(blocked).over(back)).where("_t")
    free = F.coalesce(F.col("hw_ts") - F.col("_last") > block_us, F.lit(True)) & F.coalesce(F.col("_next") - F.col("hw_ts") >= wait_us, F.lit(True))
    return seen.withColumn(name, F.col("hw_ts").isNotNull() & free).drop("_t", "_last", "_next")


def as_of_state(events: DataFrame, states: DataFrame, by: Sequence[str], state: str = "enabled") -> DataFrame:
    """Adds to each event the last state at or before its time (null before the first). Of states at one time the largest holds.

    states: by, hw_ts and the state. A union and a running last value: one shuffle, whatever the numbers of rows.
    """
    latest = states.groupBy(*by, "hw_ts").agg(F.max(state).alias(state))
    both = events.withColumn("_e", F.lit(1)).unionByName(latest.withColumn("_e", F.lit(0)), allowMissingColumns=True)
    held = F.last(F.when(F.col("_e") == 0, F.col(state)), ignorenulls=True).over(Window.partitionBy(*by).orderBy("hw_ts", "_e").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_s", held).where("_e = 1").withColumn(state, F.col("_s")).drop("_e", "_s")


def one_shot_gate(rows: DataFrame, bit: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows from the first one whose bit is set on, that one included."""
    opened = F.max(F.coalesce(bit, F.lit(False))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_open", opened).where("_open").drop("_open")


def level_gate(rows: DataFrame, bit: Column) -> DataFrame:
    """Rows whose bit is set."""
    return rows.where(bit)


def first_packets(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in order; 0 means all."""
    return rows.orderBy(*order).limit(n) if n else rows
