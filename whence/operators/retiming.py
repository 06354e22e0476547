"""When events would happen if others were moved in time.

A link says that its effect lies between `low` and `high` microseconds after its
cause: a difference constraint.  The possible time of an effect is the meet of
what all its causes leave open, moved or not; so its earliest time is a longest
walk over `low` and its latest a shortest walk over `high`.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

BY = ["set_id", "node"]


def touched(links: DataFrame, moved: DataFrame) -> DataFrame:
    """set_id, node of all that a set's moved(set_id, node) events lead to, these
    left out: an event that is moved by itself stays where it is put."""
    e = links.select("source", "target")
    last = written(moved.select(*BY).distinct(), "touched")
    parts = [last.withColumn("round", F.lit(0))]
    for r in count(1):
        step = last.withColumnRenamed("node", "source").join(e.hint("merge"), "source").select("set_id", F.col("target").alias("node"), F.lit(r).alias("round"))
        # What is known is among the rows of the same grouping, by an earlier round.
        every = reduce(DataFrame.unionByName, [*parts, step]).groupBy(*BY).agg(F.min("round").alias("round"))
        last = written(every.where(F.col("round") == r).select(*BY), "touched")
        if last.isEmpty():
            break
        parts.append(last.withColumn("round", F.lit(r)))
        if len(parts) > 16:  # what is known becomes one table again
            parts = [written(reduce(DataFrame.union, parts), "touched")]
    return reduce(DataFrame.union, parts).where("round > 0").select(*BY)


def retimed(links: DataFrame, times: DataFrame, shifts: DataFrame) -> DataFrame:
    """set_id, node, before_lo, before_hi, after_lo, after_hi, status of the events
    that each set of shifts moves or touches.

    links(source, target, low, high), one per pair, null where a side is open;
    times(node, lo, hi); shifts(set_id, node, shift), one per set and node, in
    microseconds like all the others.  Links from or to events without a time are
    left out.  status: SHIFTED as asked; HOLDS, the old interval is possible;
    NARROWED, part of it; LATER or EARLIER, none of it; CONFLICT, the causes leave
    nothing; UNBOUNDED, a loop of links would push a side on for ever, which is
    then null.

    Events are settled once all their causes are, level by level.  What is left
    lies in loops or behind them: n such events settle in n rounds, and what
    moves in the n rounds after these never would.
    """
    known = times.select("node", "lo", "hi").where("lo is not null and hi is not null")
    moved = written(shifts.join(known, "node").select(*BY, "lo", "hi", "shift"), "shifts")
    ends = links.join(known.select(F.col("node").alias("source")), "source", "left_semi").join(known.select(F.col("node").alias("target")), "target", "left_semi")
    ends = written(ends.select("source", "target", "low", "high"), "links")
    affected = written(touched(ends, moved), "affected")

    # Each link into an affected event: from a settled one as a bound, from another one as a wait.
    into = affected.join(ends, F.col("node") == F.col("target")).select("set_id", "source", "target", "low", "high")
    waits = affected.select("set_id", F.col("node").alias("source"), F.lit(True).alias("waits"))
    into = into.join(waits, ["set_id", "source"], "left")
    live = written(into.where("waits").drop("waits"), "waits")
    still = into.where("waits is null").join(known.withColumnRenamed("node", "source"), "source")
    still = still.join(moved.select("set_id", F.col("node").alias("source"), "shift"), ["set_id", "source"], "left")
    at = F.coalesce("shift", F.lit(0))
    bounds = still.select("set_id", F.col("target").alias("node"), (F.col("lo") + at + F.col("low")).alias("lo"), (F.col("hi") + at + F.col("high")).alias("hi"), F.lit(0).alias("waiting"))
    bounds = bounds.union(live.select("set_id", "target", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1)))
    pending = written(bounds.groupBy(*BY).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.sum("waiting").alias("waiting")), "pending")

    settled: list[DataFrame] = []
    while True:
        ready = written(pending.where("waiting = 0").select(*BY, "lo", "hi"), "settled")
        if ready.isEmpty():
            break
        settled.append(ready)
        pending = written(_met(pending.where("waiting > 0"), _sent(ready, live)), "pending")
        if len(settled) > 16:
            settled = [written(reduce(DataFrame.union, settled), "settled")]
    settled.append(_looped(pending.select(*BY, "lo", "hi"), live))
    return _told(known, moved, reduce(DataFrame.union, settled))


def _sent(rows: DataFrame, live: DataFrame) -> DataFrame:
    """What events that have bounds tell those that follow from them."""
    out = rows.withColumnRenamed("node", "source").join(live, ["set_id", "source"]).groupBy("set_id", F.col("target").alias("node"))
    return out.agg(F.max(F.col("lo") + F.col("low")).alias("lo2"), F.min(F.col("hi") + F.col("high")).alias("hi2"), F.count("*").alias("told"))


def _met(rows: DataFrame, sent: DataFrame) -> DataFrame:
    met = rows.join(sent, BY, "left")
    # greatest and least leave nulls out.
    return met.select(*BY, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"), (F.col("waiting") - F.coalesce("told", F.lit(0))).alias("waiting"))


def _looped(core: DataFrame, live: DataFrame) -> DataFrame:
    """Relaxation of the events in and behind loops."""
    core = written(core, "core")
    n = max((r["n"] for r in core.groupBy("set_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).collect() if r["n"]), default=0)
    if n == 0:
        return core
    inside = live.join(core.select("set_id", F.col("node").alias("source")), ["set_id", "source"], "left_semi")
    inside = written(inside.join(core.select("set_id", F.col("node").alias("target")), ["set_id", "target"], "left_semi"), "loops")
    now = core.withColumns({"moves_lo": F.lit(False), "moves_hi": F.lit(False), "changed": F.lit(True)})
    for k in count(1):
        sent = _sent(now.where("changed").select(*BY, "lo", "hi"), inside).drop("told")
        met = now.join(sent, BY, "left").withColumns({"lo3": F.greatest("lo", "lo2"), "hi3": F.least("hi", "hi2")})
        up, down = ~F.col("lo3").eqNullSafe(F.col("lo")), ~F.col("hi3").eqNullSafe(F.col("hi"))
        late = F.lit(k > n)
        now = written(met.select(*BY, F.col("lo3").alias("lo"), F.col("hi3").alias("hi"), (F.col("moves_lo") | (up & late)).alias("moves_lo"), (F.col("moves_hi") | (down & late)).alias("moves_hi"), (up | down).alias("changed")), "loop")
        if k > 2 * n or now.where("changed").isEmpty():
            break
    return now.select(*BY, F.when(~F.col("moves_lo"), F.col("lo")).alias("lo"), F.when(~F.col("moves_hi"), F.col("hi")).alias("hi"))


def _told(known: DataFrame, moved: DataFrame, settled: DataFrame) -> DataFrame:
    rows = settled.toDF(*BY, "after_lo", "after_hi").join(known.toDF("node", "before_lo", "before_hi"), "node")
    lo, hi, low, high = (F.col(c) for c in ("before_lo", "before_hi", "after_lo", "after_hi"))
    status = (
        F.when(low.isNull() | high.isNull(), "UNBOUNDED")
        .when(low > high, "CONFLICT")
        .when(low > hi, "LATER")
        .when(high < lo, "EARLIER")
        .when((low <= lo) & (high >= hi), "HOLDS")
        .otherwise("NARROWED")
    )
    rows = rows.select(*BY, "before_lo", "before_hi", "after_lo", "after_hi", status.alias("status"))
    return rows.union(moved.select(*BY, "lo", "hi", F.col("lo") + F.col("shift"), F.col("hi") + F.col("shift"), F.lit("SHIFTED")))
