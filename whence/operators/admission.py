"""Which proposed changes of a world may be simulated, and why others may not."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of change, and reasons of refusal.
KINDS = ("SHIFT_TIMING", "REMOVE_EVENT", "INSERT_EVENT", "CHANGE_ATTRIBUTE", "CHANGE_ENTITY_STATE")
REASONS = (
    "UNKNOWN_TARGET",
    "ATTRIBUTE_NOT_DECLARED_CHANGEABLE",
    "VALUE_OUTSIDE_DECLARED_BOUND",
    "TRANSITION_NOT_DECLARED",
    "STEP_NOT_ADMITTED_BY_PROCESS",
    "WOULD_VIOLATE_LAW_TIME",
    "CHANGES_NOTHING",
    "DECLARATION_ABSENT",
)
#: Columns of a proposal; those that its kind doesn't need are null.
PROPOSAL = "kind string, target long, entity long, shift long, attribute string, new_value string, new_type string, from_state string, to_state string"


class Changeable(NamedTuple):
    """An attribute of an event type that might have been otherwise: within a range, or one of some values."""

    event_type: str
    attribute: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()


def proposal(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """rows as proposals of one kind."""
    fields = [f.split() for f in PROPOSAL.split(", ")]
    return rows.select(*[(F.lit(kind) if n == "kind" else columns.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields])


def admit(proposals: DataFrame, events: DataFrame, links: DataFrame, entities: DataFrame, changeable: Sequence[Changeable], steps: Sequence[str], transitions: Sequence[tuple[str, str]]) -> DataFrame:
    """proposals with reason, null for those admitted.

    events(event_id, event_type, lo, hi, value): times in microseconds, null if
    unknown, and the attribute `value`; links(source, target): stated causes;
    entities(entity).  A shift is held against the latest beginning of its causes
    and the earliest end of its effects, which grouped sums give; so no pair is
    made.  Declarations that are missing refuse.
    """
    at = events.select("event_id", "lo", "hi")
    causes = links.join(at.select(F.col("event_id").alias("source"), "lo"), "source").groupBy("target").agg(F.max("lo").alias("after"))
    effects = links.join(at.select(F.col("event_id").alias("target"), "hi"), "target").groupBy(F.col("source").alias("target")).agg(F.min("hi").alias("before"))
    known = events.select(F.col("event_id").alias("target"), F.col("event_type").alias("target_type"), "lo", "hi", F.col("value").alias("current"))
    known = known.join(causes, "target", "left").join(effects, "target", "left")
    rows = _looked_up(proposals, known, "target")
    rows = _looked_up(rows, entities.select("entity", F.lit(True).alias("there")).distinct(), "entity")

    kind, missing = F.col("kind"), F.col("target_type").isNull()
    late = F.coalesce(F.col("after") >= F.col("hi") + F.col("shift"), F.lit(False)) | F.coalesce(F.col("lo") + F.col("shift") >= F.col("before"), F.lit(False))
    own = [(F.col("target_type") == c.event_type) & (F.col("attribute") == c.attribute) for c in changeable]
    number, new = F.expr("try_cast(new_value AS double)"), F.col("new_value")
    outside = F.lit(False)
    for c, mine in zip(changeable, own, strict=True):
        bad = F.lit(False)
        if c.values:
            bad = bad | ~new.isin(*c.values)
        if c.low is not None and c.high is not None:
            bad = bad | F.coalesce(~number.between(c.low, c.high), F.lit(True))
        outside = outside | (mine & bad)
    declared_type = F.col("target_type").isin(*{c.event_type for c in changeable}) if changeable else F.lit(False)
    declared = F.coalesce(F.greatest(*own, F.lit(False)), F.lit(False)) if own else F.lit(False)
    same = (F.col("attribute") == "value") & (F.col("current").cast("string").eqNullSafe(new) | (F.col("current").cast("double") == number))
    legal = F.lit(False)
    for a, b in set(transitions):
        legal = legal | (F.col("from_state").eqNullSafe(a) & F.col("to_state").eqNullSafe(b))

    attribute = F.when(missing, "UNKNOWN_TARGET").when(~declared_type, "DECLARATION_ABSENT").when(~declared, "ATTRIBUTE_NOT_DECLARED_CHANGEABLE").when(F.coalesce(same, F.lit(False)), "CHANGES_NOTHING").when(outside, "VALUE_OUTSIDE_DECLARED_BOUND")
    insertion = F.lit("DECLARATION_ABSENT") if not steps else F.when(F.col("target").isNotNull() & missing, "UNKNOWN_TARGET").when(~F.coalesce(F.col("new_type").isin(*steps), F.lit(False)), "STEP_NOT_ADMITTED_BY_PROCESS")
    state = F.when(F.col("there").isNull(), "UNKNOWN_TARGET").when(F.lit(not transitions), "DECLARATION_ABSENT").when(~legal, "TRANSITION_NOT_DECLARED")
    reason = (
        F.when(kind == "SHIFT_TIMING", F.when(missing, "UNKNOWN_TARGET").when(late, "WOULD_VIOLATE_LAW_TIME"))
        .when(kind == "REMOVE_EVENT", F.when(missing, "UNKNOWN_TARGET"))
        .when(kind == "INSERT_EVENT", insertion)
        .when(kind == "CHANGE_ATTRIBUTE", attribute)
        .when(kind == "CHANGE_ENTITY_STATE", state)
    )
    return rows.select(*proposals.columns, reason.alias("reason"))


def _looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the facts(key, ...) on their key, null where there are none.  Rows
    without a key are dealt by where they lie: a join would send all of them to one task."""
    dealt = rows.withColumn("_at", F.coalesce(F.col(key).cast("long"), (-1 - F.spark_partition_id()).cast("long")))
    own = facts.withColumnRenamed(key, "_key")
    return dealt.join(own, (F.col("_at") == F.col("_key")) & F.col(key).isNotNull(), "left").drop("_at", "_key")
