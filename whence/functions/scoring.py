"""Column functions that turn counts and lifts into scores from 0 to 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anchors of the ceilings and weights of the gated mean.
TEMPORAL_CEILING = ((0.0, 0.25), (0.30, 0.55), (0.60, 0.80), (1.0, 1.0))
CONTRADICTION_CEILING = ((0.0, 0.10), (0.50, 0.60), (1.0, 1.0))
WEIGHTS = {"rule": 0.28, "historical": 0.17, "statistical": 0.17, "diversity": 0.16, "evidence": 0.12, "connectivity": 0.10}


def shown(c: Column) -> Column:
    """Six places, halves to even."""
    return F.bround(c.cast("decimal(38,18)"), 6).cast("double")


def lift(both: Column, with_cause: Column, with_effect: Column, instances: Column) -> Column:
    return F.try_divide(F.try_divide(both, with_cause), F.try_divide(with_effect, instances))


def shrinkage(n: Column, prior: float) -> Column:
    return n / (n + prior)


def squashed(lift: Column, reference: float) -> Column:
    if reference <= 1:
        return F.lit(0.0)
    return F.when(F.coalesce(lift, F.lit(0.0)) <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.log(lift) / math.log(reference)))


def blend(shrunk: Column, squash: Column, first: float) -> Column:
    """Weighted geometric mean; zero if either is."""
    return F.when((shrunk <= 0) | (squash <= 0), 0.0).otherwise(F.pow(shrunk, F.lit(first)) * F.pow(squash, F.lit(1 - first)))


def ceiling(value: Column, anchors: tuple[tuple[float, float], ...]) -> Column:
    """The line through the anchors at value."""
    out = F.when(value <= anchors[0][0], anchors[0][1])
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(anchors[-1][1])


def height(value: float, anchors: tuple[tuple[float, float], ...]) -> float:
    """ceiling() of a plain number."""
    if value <= anchors[0][0]:
        return anchors[0][1]
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        if value <= x1:
            return y0 + (value - x0) * ((y1 - y0) / (x1 - x0))
    return anchors[-1][1]


def noisy_or(strengths: Column) -> Column:
    """Aggregate: 1 - product of (1 - strength)."""
    return 1 - F.product(1 - strengths)


def gated_mean(components: dict[str, Column], temporal: Column, contradiction: Column) -> Column:
    """The weighted mean, at most what time and contradictions allow.  A missing
    component scores zero and keeps its weight."""
    total = sum(WEIGHTS.values())
    mean = sum((F.coalesce(components[k], F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0)) / total
    return F.least(mean, ceiling(temporal, TEMPORAL_CEILING), ceiling(contradiction, CONTRADICTION_CEILING))


#: Weights of the plain mean, whose missing components abstain.
MEAN_WEIGHTS = {"rule": 0.25, "temporal": 0.20, "historical": 0.15, "statistical": 0.15, "evidence": 0.15, "connectivity": 0.10}


def weighted_mean(components: dict[str, Column]) -> Column:
    """The mean of the components that are there, by their weights; null without any."""
    zero = F.lit(0.0)
    total = sum((F.when(c.isNotNull(), MEAN_WEIGHTS[k]).otherwise(0.0) for k, c in components.items()), zero)
    return F.try_divide(sum((F.coalesce(c, zero) * MEAN_WEIGHTS[k] for k, c in components.items()), zero), total)


def minimum(components: dict[str, Column]) -> Column:
    """The weakest of the components that are there."""
    return F.least(*components.values())


def band(score: Column, floors: tuple[tuple[str, float], ...]) -> Column:
    """The first band, from high to low, whose floor the score reaches."""
    out = F.lit(None).cast("string")
    for name, floor in sorted(floors, key=lambda f: f[1]):
        out = F.when(score >= floor, name).otherwise(out)
    return out
