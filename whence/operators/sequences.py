"""Timelines: order, provenance, violations, gaps, states, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import micros, rank, verdict
from ..shared import written
from .machines import Machine, run
from .stitched import bucket_of, stitched

#: Positions of a timeline that are numbered together.
PLACED = 1 << 14


def sequence(events: DataFrame, key: str = "timeline_id", at: str = "at") -> DataFrame:
    """position from 0 in (t_earliest, t_latest, event_id) order of an interval, and
    its provenance: the first is OBSERVED, a later one if what came before is
    certain to have, else ASSUMED.  No task holds a key: it is cut by the hour."""
    rows = events.withColumns({"_first": F.col(f"{at}.t_earliest"), "_last": F.col(f"{at}.t_latest")})
    rows = stitched(rows, key, ["_first", "_last", "event_id"], bucket_of(F.col("_first")), position="position", before={"_was": at}).drop("_first", "_last")
    observed = F.col("_was").isNull() | (verdict("_was", at) == "CERTAIN")
    return rows.withColumn("position", F.col("position").cast("bigint")).withColumn("provenance", F.when(observed, "OBSERVED").otherwise("ASSUMED")).drop("_was")


def violations(sequenced: DataFrame, steps: tuple[str, ...], repeatable: tuple[str, ...] = (), key: str = "timeline_id") -> DataFrame:
    """Adjacent events whose declared step goes down; repeatable types may."""
    w = Window.partitionBy(key).orderBy("position")
    rows = sequenced.withColumn("step", rank(F.col("event_type"), steps)).withColumn("next_type", F.lead("event_type").over(w)).withColumn("next_step", F.lead("step").over(w))
    down = rows.where((F.col("next_step") < F.col("step")) & ~F.col("next_type").isin(*repeatable) & ~F.col("event_type").isin(*repeatable) if repeatable else F.col("next_step") < F.col("step"))
    return down.select(key, "event_id", "event_type", "next_type", "position")


def gaps(sequenced: DataFrame, required: tuple[str, ...], key: str = "timeline_id") -> DataFrame:
    """Required steps that a timeline lacks, with the position of its first
    event of a later step; null if there is none."""
    steps = F.array(*[F.lit(s) for s in required])
    seen = sequenced.groupBy(key).agg(*[F.min(F.when(F.col("event_type") == s, F.col("position"))).alias(f"p{i}") for i, s in enumerate(required)])
    firsts = F.array(*[F.col(f"p{i}") for i in range(len(required))])
    rows = seen.select(key, F.posexplode(F.arrays_zip(steps.alias("s"), firsts.alias("p"))).alias("i", "x"), firsts.alias("firsts"))
    missing = rows.where("x.p is null")
    later = F.array_min(F.expr("slice(firsts, i + 2, size(firsts))"))
    return missing.select(key, F.col("x.s").alias("expected_type"), F.when(F.col("i") + 1 < len(required), later).alias("before_position"))


def conformance(sequenced: DataFrame, required: tuple[str, ...], key: str = "timeline_id") -> DataFrame:
    """matched, required, score of every timeline."""
    matched = F.count_distinct(F.when(F.col("event_type").isin(*required), F.col("event_type")))
    return sequenced.groupBy(key).agg(matched.alias("matched")).select(key, "matched", F.lit(len(required)).cast("bigint").alias("required"), (F.col("matched") / len(required)).alias("score"))


def replay(sequenced: DataFrame, transitions: dict[tuple[str, str], str], key: str = "timeline_id") -> DataFrame:
    """States that a declared machine goes through: a row per taken event, and one
    per halt.  What a machine does with events is machines.Machine's; timelines
    are composed in blocks, so none is folded by one task."""
    machine = Machine(transitions)
    rows = sequenced.where(F.col("event_type").isin(*machine.maps)).select(key, "event_id", "event_type", "position", F.col("at.t_earliest").alias("entered"))
    placed = written(stitched(rows, key, ["position"], F.floor(F.col("position") / PLACED), position="_place"), "triggers")
    return run(placed, machine, key, "_place").drop("_place")


def state_intervals(replayed: DataFrame, key: str = "timeline_id") -> DataFrame:
    """[entered, left) of each state taken; left is null while it holds."""
    w = Window.partitionBy(key).orderBy("position")
    taken = replayed.where("not illegal")
    return taken.select(key, F.col("to_state").alias("state"), "entered", F.lead("entered").over(w).alias("left"))


def holding_at(intervals: DataFrame, instant: Column, key: str = "timeline_id") -> DataFrame:
    """The state of each timeline that holds at an instant."""
    return intervals.where((F.col("entered") <= instant) & (F.col("left").isNull() | (instant < F.col("left")))).select(key, "state")


def durations(sequenced: DataFrame, first: str, last: str, key: str = "timeline_id") -> DataFrame:
    """Microseconds from a timeline's first event of one type to its first of another."""
    at = lambda t: F.min(F.when(F.col("event_type") == t, F.col("at.t_earliest")))
    both = sequenced.groupBy(key).agg(at(first).alias("a"), at(last).alias("b")).where("a is not null and b is not null")
    return both.select(key, (micros(F.col("b")) - micros(F.col("a"))).alias("micros"))
