"""A declared mapping of raw text columns to typed records, compiled to one select."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import address
from .temporal import coarser, interval, micros
from .transforms import chain


class Field(NamedTuple):
    """A column's transforms, and the values that an enumeration maps; others are unmapped."""

    name: str
    column: str
    transforms: tuple[str, ...] = ("TRIM",)
    values: dict | None = None


class Mapping(NamedTuple):
    entity: str
    key: tuple[str, ...]  # natural key: columns in order
    fields: tuple[Field, ...]
    instants: tuple[tuple[str, str, str, str], ...] = ()  # name, column, format, precision


def instant(c: Column, fmt: str) -> Column:
    """A source's instant in its declared format; null if it isn't one."""
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("timestamp_ntz")


def apply(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """address, the mapped fields and intervals, and reasons: what kept a value from
    being mapped (UNMAPPED_field, UNPARSED_field, MISSING_KEY), empty if nothing did."""
    out, reasons = [], []
    for f in mapping.fields:
        value = chain(f.transforms, F.col(f"`{f.column}`"))[-1]
        given = F.trim(F.coalesce(F.col(f"`{f.column}`"), F.lit(""))) != ""
        if f.values is not None:
            value = F.element_at(F.create_map(*[F.lit(x) for kv in f.values.items() for x in kv]), value) if f.values else F.lit(None)
            reasons.append(F.when(given & value.isNull(), f"UNMAPPED_{f.name}"))
        else:
            reasons.append(F.when(given & value.isNull(), f"UNPARSED_{f.name}"))
        out.append(value.alias(f.name))
    for name, column, fmt, precision in mapping.instants:
        at = instant(F.col(f"`{column}`"), fmt)
        reasons.append(F.when(at.isNull(), f"UNPARSED_{name}"))
        out.append(interval(at, precision).alias(name))
    keys = [F.trim(F.coalesce(F.col(f"`{k}`"), F.lit(""))) for k in mapping.key]
    missing = F.lit(False)
    for k in keys:
        missing = missing | (k == "")
    reasons.append(F.when(missing, "MISSING_KEY"))
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons")
    return rows.select("*", address(mapping.entity, *keys).alias("address"), *out, found)


def bounded_between(low: str, high: str) -> Column:
    """An event somewhere between two known ones: inferred, at the coarser precision;
    unknown if they come in the wrong order or either is unknown."""
    a, b = (lambda f: F.col(f"{low}.{f}")), (lambda f: F.col(f"{high}.{f}"))
    open_ = a("t_earliest").isNull() | b("t_latest").isNull() | (a("t_earliest") > b("t_latest"))
    known = F.struct(a("t_earliest").alias("t_earliest"), b("t_latest").alias("t_latest"), coarser(a("precision"), b("precision")).alias("precision"), F.lit("INFERRED").alias("provenance"))
    return F.when(open_, unknown()).otherwise(known)


def offset_from(base: str, days: Column) -> Column:
    """An event so many days after a known one: inferred; unknown without either."""
    at = lambda f: F.timestamp_add("DAY", days.cast("int"), F.col(f"{base}.{f}")).alias(f)
    open_ = days.isNull() | F.col(f"{base}.t_earliest").isNull()
    return F.when(open_, unknown()).otherwise(F.struct(at("t_earliest"), at("t_latest"), F.col(f"{base}.precision").alias("precision"), F.lit("INFERRED").alias("provenance")))


def unknown() -> Column:
    never = F.lit(None).cast("timestamp_ntz")
    return F.struct(never.alias("t_earliest"), never.alias("t_latest"), F.lit("UNKNOWN").alias("precision"), F.lit("ASSUMED").alias("provenance"))


def simulated_precedes(cause: str, effect: str) -> Column:
    """temporal.verdict() for simulated times, which don't ask whether a time was inferred."""
    c, e = (lambda f: F.col(f"{cause}.{f}")), (lambda f: F.col(f"{effect}.{f}"))
    open_ = (c("precision") == "UNKNOWN") | (e("precision") == "UNKNOWN")
    return F.when(open_, "UNDETERMINED").when(c("t_earliest") >= e("t_latest"), "VIOLATION").when(c("t_latest") < e("t_earliest"), "CERTAIN").otherwise("UNDETERMINED")


def strictly_before(cause: str, effect: str) -> Column:
    """Do all instants of one interval come before all of the other?"""
    return F.coalesce(micros(F.col(f"{cause}.t_latest")) < micros(F.col(f"{effect}.t_earliest")), F.lit(False))


def names_token(expression: Column, token: str) -> Column:
    """Does a condition name a token as a whole word?"""
    return F.coalesce(expression.rlike(rf"(?<![A-Za-z0-9_]){token}(?![A-Za-z0-9_])"), F.lit(False))


def attribute(changed: Column, metadata: Column, name: str) -> Column:
    """What an event changed, else what is noted beside it."""
    return F.coalesce(F.try_element_at(changed, F.lit(name)), F.try_element_at(metadata, F.lit(name)))
