"""Declared rules over events whose times are intervals.

Two intervals are apart by anything from their nearest to their farthest ends; a
rule fits if that range overlaps its window and the effect isn't certain to come
first.  Both sides are laid into every bucket of time that they touch, the cause
widened by the window, and a pair comes out of the first bucket that both are
in.  Events of unknown time fit any window, and are joined apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition
from ..functions.temporal import micros, separation, unverifiable, verdict
from .stitched import stitched


class IntervalRule(NamedTuple):
    rule_id: str
    cause_type: str
    effect_type: str
    least_us: int
    most_us: int
    strength: float
    least_in: bool = True
    most_in: bool = True
    condition: tuple = ("all",)  # fields as cause.x and effect.x


class Constraint(NamedTuple):
    """An entity that has been in a state isn't the subject of an event type."""

    state: str
    forbidden_type: str


class Modifier(NamedTuple):
    """Entities of an event type: another rule's strength is multiplied, up to one."""

    event_type: str
    rule_id: str
    multiplier: float


def fits(rule: IntervalRule, low: Column, high: Column) -> Column:
    """Does the range of separations overlap the window?  Unbounded ranges do."""
    early = high >= rule.least_us if rule.least_in else high > rule.least_us
    late = low <= rule.most_us if rule.most_in else low < rule.most_us
    return F.coalesce(early & late, F.lit(True))


def firings(events: DataFrame, rules: Sequence[IntervalRule], entity: str) -> DataFrame:
    """rule_id, entity, source, target, low, high (microseconds, null: unbounded),
    verdict, unverifiable, strength of every pair of an entity's events that fits a rule.

    events: event_id, event_type, known (interval), the entity (null: none, such
    events pair with nothing) and what conditions name.  A long interval lies in
    many buckets, so a rule's buckets are as wide as its window or a day, whichever is more.
    """
    rows = events.where(F.col(entity).isNotNull())
    unknown = F.col("known.precision").eqNullSafe("UNKNOWN") | F.col("known.t_earliest").isNull() | F.col("known.t_latest").isNull()
    own = F.struct(*rows.columns)
    parts = []
    for rule in rules:
        width = max(rule.most_us - rule.least_us, 86_400_000_000)
        a = rows.where(F.col("event_type") == rule.cause_type).select(F.col(entity).alias("entity"), own.alias("cause"), unknown.alias("open"), micros(F.col("known.t_earliest")).alias("lo"), micros(F.col("known.t_latest")).alias("hi"))
        b = rows.where(F.col("event_type") == rule.effect_type).select(F.col(entity).alias("entity"), own.alias("effect"), unknown.alias("open"), micros(F.col("known.t_earliest")).alias("lo"), micros(F.col("known.t_latest")).alias("hi"))
        first, last = F.floor((F.col("lo") + rule.least_us) / width), F.floor((F.col("hi") + rule.most_us) / width)
        laid_a = a.where("not open").select("entity", "cause", first.alias("first_a"), F.explode(F.sequence(first, last)).alias("bucket"))
        first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
        laid_b = b.where("not open").select("entity", "effect", first.alias("first_b"), F.explode(F.sequence(first, last)).alias("bucket"))
        met = laid_a.join(laid_b, ["entity", "bucket"]).where(F.col("bucket") == F.greatest("first_a", "first_b")).select("entity", "cause", "effect")
        met = met.union(a.where("open").join(b.select("entity", "effect"), "entity").select("entity", "cause", "effect"))
        met = met.union(a.where("not open").join(b.where("open").select("entity", "effect"), "entity").select("entity", "cause", "effect"))
        low, high = separation("cause.known", "effect.known", clipped=False)
        met = met.where("cause.event_id <> effect.event_id").withColumns({"low": low, "high": high, "verdict": verdict("cause.known", "effect.known")})
        met = met.where((F.col("verdict") != "VIOLATION") & fits(rule, F.col("low"), F.col("high")) & compile_condition(rule.condition))
        parts.append(
            met.select(
                F.lit(rule.rule_id).alias("rule_id"),
                "entity",
                F.col("cause.event_id").alias("source"),
                F.col("effect.event_id").alias("target"),
                "low",
                "high",
                "verdict",
                unverifiable("cause.known", "effect.known").alias("unverifiable"),
                F.lit(rule.strength).alias("strength"),
            )
        )
    return reduce(DataFrame.union, parts)


def refused(events: DataFrame, rules: Sequence[IntervalRule], entity: str) -> DataFrame:
    """rule_id, refused: how many pairs of an entity's events of a rule's types are
    in an order that can't be, counted without a pair being made.

    A pair can't be if the cause begins no earlier than the effect has ended; so
    both kinds of instants are put in order, and each cause counts the effects
    that stand before it: its place among all less its place among causes.
    """
    rows = events.where(F.col(entity).isNotNull() & (F.col("known.precision") != "UNKNOWN"))
    parts = []
    for rule in rules:
        causes = rows.where(F.col("event_type") == rule.cause_type).select(F.col(entity).alias("entity"), micros(F.col("known.t_earliest")).alias("us"), F.lit(1).alias("side"), "event_id", (F.col("known.t_earliest") == F.col("known.t_latest")).alias("exact"))
        effects = rows.where(F.col("event_type") == rule.effect_type).select(F.col(entity).alias("entity"), micros(F.col("known.t_latest")).alias("us"), F.lit(0).alias("side"), "event_id", F.lit(False).alias("exact"))
        hour = F.floor(F.col("us") / 3_600_000_000)
        order = ["us", "side", "event_id"]
        among_all = stitched(causes.union(effects), "entity", order, hour, position="before").where("side = 1")
        among_own = stitched(causes, "entity", order, hour, position="before")
        n = among_all.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("n")).crossJoin(F.broadcast(among_own.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("own"), F.count_if("exact").alias("exact"))))
        # Of one type, an exact event would stand before itself.
        itself = F.col("exact") if rule.cause_type == rule.effect_type else F.lit(0)
        parts.append(n.select(F.lit(rule.rule_id).alias("rule_id"), (F.col("n") - F.col("own") - itself).cast("long").alias("refused")))
    return reduce(DataFrame.union, parts)


def judged(fired: DataFrame, events: DataFrame, rules: Sequence[IntervalRule], states: DataFrame, constraints: Sequence[Constraint], modifiers: Sequence[Modifier], entity: str) -> DataFrame:
    """fired with prohibited (an entity that has been in a constraint's state is the
    subject of its forbidden type) and strength after modifiers.  states(entity, state)."""
    effect = {r.rule_id: r.effect_type for r in rules}
    barred = [(c.state, r) for c in constraints for r, t in effect.items() if t == c.forbidden_type]
    marked = fired.sparkSession.createDataFrame(barred, "state string, rule_id string")  # as many as are declared
    hit = states.select("entity", "state").distinct().join(F.broadcast(marked), "state").select("entity", "rule_id").distinct().withColumn("barred", F.lit(True))
    times = fired.sparkSession.createDataFrame([(m.event_type, m.rule_id, m.multiplier) for m in modifiers], "event_type string, rule_id string, times double")
    seen = events.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), "event_type").distinct()
    factor = seen.join(F.broadcast(times), "event_type").groupBy("entity", "rule_id").agg(F.product("times").alias("times"))
    out = fired.join(hit, ["entity", "rule_id"], "left").join(factor, ["entity", "rule_id"], "left")
    strength = F.least(F.lit(1.0), F.col("strength") * F.coalesce("times", F.lit(1.0)))
    return out.select(*[c for c in fired.columns if c != "strength"], strength.alias("strength"), F.coalesce("barred", F.lit(False)).alias("prohibited"), F.col("times").isNotNull().alias("modified"))


def statistics(judged_firings: DataFrame, turned_down: DataFrame) -> DataFrame:
    """rule_id, firings, certain, unverifiable, prohibited, modified, refused of every rule that refused() names."""
    sums = judged_firings.groupBy("rule_id").agg(
        F.count("*").alias("firings"),
        F.count_if(F.col("verdict") == "CERTAIN").alias("certain"),
        F.count_if("unverifiable").alias("unverifiable"),
        F.count_if("prohibited").alias("prohibited"),
        F.count_if("modified").alias("modified"),
    )
    return turned_down.join(sums, "rule_id", "left").na.fill(0, ["firings", "certain", "unverifiable", "prohibited", "modified"])
