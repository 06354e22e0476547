"""Column functions on uncertain times: intervals [t_earliest, t_latest]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precisions from fine to coarse, provenance classes from strong to weak.
PRECISIONS = ("EXACT", "SECOND", "MINUTE", "HOUR", "DAY", "UNKNOWN")
PROVENANCE = ("OBSERVED", "INFERRED", "STATISTICAL", "ASSUMED", "SIMULATED")
DAY_US = 86_400_000_000


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def rank(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a symbol in a declared order; null if it isn't in it."""
    return F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))]), c)


def coarser(a: Column, b: Column) -> Column:
    return F.when(rank(a, PRECISIONS) >= rank(b, PRECISIONS), a).otherwise(b)


def weakest(a: Column, b: Column) -> Column:
    return F.when(rank(a, PROVENANCE) >= rank(b, PROVENANCE), a).otherwise(b)


def unverifiable(cause: str, effect: str) -> Column:
    return (F.col(f"{cause}.precision") == "UNKNOWN") | (F.col(f"{effect}.precision") == "UNKNOWN")


def verdict(cause: str, effect: str) -> Column:
    """May the cause precede the effect?  CERTAIN, UNDETERMINED or VIOLATION.

    cause and effect name structs with t_earliest, t_latest, precision and
    provenance.  A violation is found whatever the provenance; certainty needs
    times that nothing inferred.
    """
    c, e = (lambda f: F.col(f"{cause}.{f}")), (lambda f: F.col(f"{effect}.{f}"))
    certain = (c("t_latest") < e("t_earliest")) & (c("provenance") != "INFERRED") & (e("provenance") != "INFERRED")
    return (
        F.when(unverifiable(cause, effect), "UNDETERMINED")
        .when(c("t_earliest") >= e("t_latest"), "VIOLATION")
        .when(certain, "CERTAIN")
        .otherwise("UNDETERMINED")
    )


def separation(cause: str, effect: str, clipped: bool) -> tuple[Column, Column]:
    """Least and greatest microseconds from cause to effect; null (unbounded)
    where a time is unknown.  Clipped ones don't go below zero."""
    low = micros(F.col(f"{effect}.t_earliest")) - micros(F.col(f"{cause}.t_latest"))
    high = micros(F.col(f"{effect}.t_latest")) - micros(F.col(f"{cause}.t_earliest"))
    if clipped:
        low, high = F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0))
    known = ~unverifiable(cause, effect)
    return F.when(known, low), F.when(known, high)


def in_window(low: Column, high: Column, least_us: int | Column, most_us: int | Column, unknown_fits: bool) -> Column:
    """Does [low, high] overlap the window?  What unbounded ones do is declared."""
    fits = (high >= least_us) & (low <= most_us)
    return F.coalesce(fits, F.lit(unknown_fits))


def instants(name: str) -> Column:
    """An interval whose ends are instants, so that micros() of them costs nothing."""
    ends = {e: F.col(f"{name}.{e}").cast("timestamp").alias(e) for e in ("t_earliest", "t_latest")}
    return F.struct(*ends.values(), F.col(f"{name}.precision").alias("precision"), F.col(f"{name}.provenance").alias("provenance"))


def interval(start: Column, precision: str, provenance: str = "OBSERVED") -> Column:
    """The interval of an instant recorded at a precision; null: unknown."""
    units = {"SECOND": "second", "MINUTE": "minute", "HOUR": "hour", "DAY": "day"}
    if precision == "EXACT":
        first = last = start
    else:
        first = F.date_trunc(units[precision], start.cast("timestamp")).cast("timestamp_ntz")
        last = first + F.expr(f"INTERVAL 1 {units[precision].upper()}") - F.expr("INTERVAL 0.000001 SECOND")
    return F.struct(
        first.alias("t_earliest"),
        last.alias("t_latest"),
        F.when(start.isNull(), "UNKNOWN").otherwise(precision).alias("precision"),
        F.when(start.isNull(), "ASSUMED").otherwise(provenance).alias("provenance"),
    )
