"""Column functions for readings and instants of a changed world."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(interval: str, us: Column) -> Column:
    """Both bounds moved, so the width stays; an unknown time stays unknown."""
    at = F.col(interval)
    move = F.when(F.coalesce(at["precision"] == "UNKNOWN", F.lit(True)), F.lit(0)).otherwise(us).cast("long")
    moved = [F.timestamp_add("MICROSECOND", move, at[f]).alias(f) for f in ("t_earliest", "t_latest")]
    return F.struct(*moved, at["precision"].alias("precision"), F.lit("SIMULATED").alias("provenance"), move.alias("moved_us"))


def scaled(reading: Column, multiplier: Column) -> Column:
    """Amplified or inhibited; null for a multiplier below zero, which means nothing."""
    return F.when(multiplier >= 0, reading * multiplier)


def unscaled(reading: Column, multiplier: Column) -> Column:
    """What a reading was before it was scaled; total suppression can't be undone: null."""
    return F.when(multiplier > 0, F.try_divide(reading, multiplier))


def surviving_share(removed: Column) -> Column:
    """What is left when these shares (an array) go; null if they add up to more than one or one is no share."""
    total = F.aggregate(removed, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(removed, lambda x: (x < 0) | (x > 1)) | (total > 1 + 1e-6)
    return F.when(~bad, F.greatest(1 - total, F.lit(0.0)))


def transmitted(reading: Column, removed: Column, eliminated: Column) -> Column:
    """Nothing if nothing reaches the effect any more, else its surviving share: shares
    that happen to add up to one don't eliminate it."""
    return F.when(eliminated, 0.0).otherwise(reading * surviving_share(removed))


def combined(reading: Column, operator: str) -> Column:
    """Aggregate: one reading of each consequence combined; null without readings."""
    return {"SUM": F.sum, "MINIMUM": F.min, "MAXIMUM": F.max}[operator](reading)
