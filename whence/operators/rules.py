"""Declared rules over events that share an entity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition


class CausalRule(NamedTuple):
    rule_id: str
    cause_type: str
    effect_type: str
    within_us: int
    strength: float
    condition: tuple = ("all",)  # fields as cause.x and effect.x


def fits(rule: CausalRule) -> Column:
    """Does a (cause, effect) pair of one entity, with us, fit a rule?"""
    gap = F.col("effect.us") - F.col("cause.us")
    types = (F.col("cause.event_type") == rule.cause_type) & (F.col("effect.event_type") == rule.effect_type)
    return types & (gap > 0) & (gap <= rule.within_us) & compile_condition(rule.condition)


def firings(events: DataFrame, rules: Sequence[CausalRule], entity: str, order: str = "event_id", with_events: bool = False) -> DataFrame:
    """rule_id, source, target, gap_us, strength (and cause, effect) of every pair
    that a rule's types, span and condition fit.  Events are cut to the rules'
    types before the join, and meet by entity and by buckets of the rule's span."""
    kept = ["cause", "effect"] if with_events else []
    parts = []
    for rule in rules:
        us = F.unix_micros(F.col("at.t_earliest").cast("timestamp"))
        rows = events.where(F.col("event_type").isin(rule.cause_type, rule.effect_type) & us.isNotNull()).withColumn("us", us).withColumn("bucket", F.floor(us / rule.within_us))
        a = rows.where(F.col("event_type") == rule.cause_type).select(F.col(entity).alias("entity"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.struct(*rows.columns).alias("cause"))
        b = rows.where(F.col("event_type") == rule.effect_type).select(F.col(entity).alias("entity"), "bucket", F.struct(*rows.columns).alias("effect"))
        gap = F.col("effect.us") - F.col("cause.us")
        hit = a.join(b, ["entity", "bucket"]).where((gap > 0) & (gap <= rule.within_us) & compile_condition(rule.condition))
        parts.append(hit.select(F.lit(rule.rule_id).alias("rule_id"), F.col(f"cause.{order}").alias("source"), F.col(f"effect.{order}").alias("target"), gap.alias("gap_us"), F.lit(rule.strength).alias("strength"), *kept))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def joint(fired: DataFrame, contributors: Sequence[str]) -> DataFrame:
    """target and its first source (the earliest, then the smallest id) of every
    contributing rule; targets that lack one have no row."""
    w = Window.partitionBy("target", "rule_id").orderBy(F.col("gap_us").desc(), "source")
    first = fired.where(F.col("rule_id").isin(*contributors)).withColumn("r", F.row_number().over(w)).where("r = 1")
    whole = first.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "source"))), lambda x: x["source"].cast("string")), ",").alias("sources"))
    return whole.where(F.col("n") == len(contributors)).select("target", "sources")


def coverage(fired: DataFrame, events: DataFrame) -> DataFrame:
    """Of each event type: events, those that some firing explains, their share."""
    explained = fired.select(F.col("target").alias("event_id")).distinct().withColumn("explained", F.lit(1))
    rows = events.select("event_id", "event_type").join(explained, "event_id", "left")
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("explained").alias("explained")).withColumn("share", F.col("explained") / F.col("events"))
