"""Mixing sources to target weights by proportionate-fair scheduling, with native expressions.

Each source's rows are put in an order by a hash and cut into blocks. A source of n slots in a period of q has weight n / q;
its k-th block (from 0) is released at floor(k q / n) and due at ceil((k + 1) q / n). Earliest deadline first gives every slot
to the released block that is due first, so after any number t of slots each source with blocks left has been given
t n / q blocks, give or take less than one. Windows of blocks end with the period, so one period's schedule serves for all.

When a source has no blocks left its slots stay empty: slots then have gaps, and the order among the other sources is kept.
No row is dropped or repeated.

Without a period n and q are the weights and their sum themselves, so the bound holds for the weights however long the table is.
With one, weights are rounded to slots of that period, at least one each: then the bound holds for the rounded weights only,
and the deviation from the weights grows with t.

Scale: ranks come from two levels (rows of a source and hash prefix, then counts of the prefixes), so a source with a third
of all rows is spread over all tasks. The period's schedule is one row of q picks, each of which looks at every source: q is the
period, or else the sum of the weights. Without given weights a source weighs the square root of its number of rows, and all are
scaled down where they would need more than WORK looks. More than MOST_SOURCES sources, or more than LONGEST slots, make
the query fail: so the schedule that is broadcast has a row for each of at most MOST_SOURCES sources and LONGEST numbers in all.

Defined cases: columns of any name come back in `doc`; a null source is a source of its own; null doc_ids come first in their source; equal doc_ids are ordered by
the hash of the row, and equal rows are interchangeable; a source without a weight gets one slot of the
period, or without a period a thousandth of what the others have together; an empty table gives none.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The most slots that given weights may need without a period; finer ones are refused, not rounded.
LONGEST = 1_000_000
#: The most sources, and the most looks at a source (slots times sources) for default weights.
MOST_SOURCES, WORK = 4_000, 20_000_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in exactly these proportions; 1 / 3 as a float is a third."""
    exact = {k: near if float(near := Fraction(v).limit_denominator(1_000_000)) == float(v) else Fraction(v) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    unit = math.lcm(*[v.denominator for v in exact.values()])
    whole = {k: int(v * unit) for k, v in exact.items()}
    common = math.gcd(*whole.values()) or 1
    whole = {k: v // common for k, v in whole.items()}
    if sum(whole.values()) > LONGEST:
        raise ValueError(f"these weights repeat after {sum(whole.values())} slots only; give coarser ones or a period")
    return whole


def slots_by_source(counts: DataFrame, period: int | None, weights: dict[str, float] | None) -> DataFrame:
    """key, n (slots in a period) and q (their sum): the weights, or with a period their largest remainders, at least one slot each.

    counts: key, rows. Without weights a source weighs the whole square root of its number of rows.
    """
    if period is None:
        if weights is None:
            root, all_ = F.sqrt(F.col("rows").cast("double")), Window.partitionBy(F.lit(1))
            scale = F.least(F.lit(1.0), F.lit(float(WORK)) / F.count(F.lit(1)).over(all_) / F.sum(root).over(all_))
            n = counts.select("key", F.greatest(F.lit(1), F.floor(root * scale)).cast("long").alias("n"))
        else:
            whole = whole_weights(weights)
            given = counts.select("key", F.nullif(_lookup({f"s{k}": v for k, v in whole.items()}), F.lit(0)).cast("long").alias("w"))
            # Only where a source has no weight are the others' counted in thousandths.
            every = Window.partitionBy(F.lit(1))
            lacking, sum_ = F.max(F.col("w").isNull()).over(every), F.coalesce(F.sum("w").over(every), F.lit(1))
            n = given.select("key", F.when(lacking, F.coalesce(F.col("w") * 1000, sum_)).otherwise(F.col("w")).alias("n"))
        return n.select("key", "n", F.sum("n").over(Window.partitionBy(F.lit(1))).alias("q"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("rows").cast("double"))).cast("long")
    else:
        scaled = {f"s{k}": round(1_000_000 * v) for k, v in weights.items()}
        weight = F.coalesce(_lookup(scaled), F.lit(0)).cast("long")
    everything = Window.partitionBy(F.lit(1))
    shared = counts.select("key", weight.alias("w")).withColumn("total", F.greatest(F.sum("w").over(everything), F.lit(1)))
    shared = shared.select("key", F.expr(f"w * {period} div total").alias("share"), F.expr(f"w * {period} % total").alias("rest"))
    left = F.lit(period) - F.sum("share").over(everything)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "key"))
    n = shared.withColumn("n", F.greatest(F.lit(1), F.col("share") + F.when(rank <= left, 1).otherwise(0)).cast("long"))
    return n.select("key", "n", F.sum("n").over(everything).alias("q"))


def _lookup(scaled: dict[str, int]):
    out = F.when(F.lit(False), F.lit(0))
    for k, v in scaled.items():
        out = out.when(F.col("key") == k, F.lit(v))
    return out


def schedule(slots: DataFrame) -> DataFrame:
    """key, n, q and the slots of a source's blocks within the period, in order, by earliest deadline first."""
    one = slots.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("s"), F.max("q").alias("q"))
    fits = (F.size("s") <= MOST_SOURCES) & (F.coalesce(F.col("q"), F.lit(0)) <= LONGEST)
    one = one.withColumn("s", F.when(fits, F.col("s")).otherwise(F.raise_error(F.lit(f"more than {MOST_SOURCES} sources or {LONGEST} slots; mix groups of sources instead")).cast("array<struct<key:string,n:bigint>>")))
    due = lambda s, k, given: F.struct(F.ceil((F.get(given, k) + 1) * F.col("q") / s["n"]).alias("due"), k.alias("k"), F.floor(F.get(given, k) * F.col("q") / s["n"]).alias("release"))

    def step(acc, t):
        ready = F.filter(F.transform("s", lambda s, k: due(s, k, acc["given"])), lambda x: x["release"] <= t)
        pick = F.array_min(ready)["k"]
        return F.struct(F.transform(acc["given"], lambda g, k: g + F.when(k == pick, 1).otherwise(0)).alias("given"), F.concat(acc["picks"], F.array(pick)).alias("picks"))

    none = F.array().cast("array<int>")
    # In runs of 256 slots, so that a long list of picks is not copied for each of them.
    part = lambda acc, a: F.aggregate(F.sequence(a, F.least(a + 255, (F.col("q") - 1).cast("int"))), F.struct(acc["given"].alias("given"), none.alias("picks")), step)
    whole = lambda acc, a: F.transform(F.array(part(acc, a)), lambda x: F.struct(x["given"].alias("given"), F.concat(acc["picks"], F.array(x["picks"])).alias("picks")))[0]
    start = F.struct(F.transform("s", lambda s: F.lit(0)).alias("given"), F.array().cast("array<array<int>>").alias("picks"))
    picks = F.flatten(F.aggregate(F.sequence(F.lit(0), (F.col("q") - 1).cast("int"), F.lit(256)), start, whole)["picks"])
    rows = one.where("q > 0").withColumn("picks", picks).select("q", "picks", F.posexplode("s").alias("k", "x"))
    mine = F.filter(F.transform("picks", lambda p, t: F.when(p == F.col("k"), t)), lambda t: t.isNotNull())
    return rows.select(F.col("x")["key"].alias("key"), F.col("x")["n"].alias("n"), "q", mine.alias("slots"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 32, period: int | None = None, prefix: int = 3) -> DataFrame:
    """doc (all columns of the row, as a struct), block, slot and offset within the block, for every row.

    weights: by source, relative; period: slots to which weights are rounded, None for exact weights; prefix: hex digits of the hash that split a source's rows for ranking.
    """
    row = F.struct("*").alias("doc")
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(row, key.alias("key"), h.alias("h"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("tie"))
    rows = rows.withColumn("part", F.substring("h", 1, prefix))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy("h", "id", "tie")) - 1)
    counts = docs.select(key.alias("key"), F.substring(h, 1, prefix).alias("part")).groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.join(counts.select("key", "part", before.alias("before")), ["key", "part"])
    plan = schedule(slots_by_source(counts.groupBy("key").agg(F.sum("rows").alias("rows")), period, weights))
    # schedule() fails beyond MOST_SOURCES rows and LONGEST slots, which bounds what is broadcast.
    placed = placed.join(F.broadcast(plan), "key").withColumn("rank", F.col("before") + F.col("rank")).withColumn("block", F.expr(f"rank div {block_rows}"))
    slot = F.expr("(block div n) * q") + F.get("slots", (F.col("block") % F.col("n")).cast("int"))
    return placed.select("doc", "block", slot.cast("long").alias("slot"), (F.col("rank") % block_rows).cast("long").alias("offset"))
