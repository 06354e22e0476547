"""Declared conditions and measurements, compiled to columns.

A condition is a nested tuple: ("all", c, ...), ("any", c, ...), ("not", c),
("exists", field) or (field, op, value) with op one of = != < <= > >= in.
Both evaluators are two-valued: a missing operand is false, also under "not".
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compile_condition(condition: tuple, field=F.col) -> Column:
    head = condition[0]
    if head == "all":
        return reduce(operator.and_, [compile_condition(c, field) for c in condition[1:]], F.lit(True))
    if head == "any":
        return reduce(operator.or_, [compile_condition(c, field) for c in condition[1:]], F.lit(False))
    if head == "not":
        return ~compile_condition(condition[1], field)
    if head == "exists":
        return field(condition[1]).isNotNull()
    name, op, value = condition
    if op == "in":
        return F.coalesce(field(name).isin(list(value)), F.lit(False))
    left = field(name).try_cast("double") if isinstance(value, (int, float)) else field(name)
    return F.coalesce(_COMPARE[op](left, F.lit(value)), F.lit(False))


def compile_measurement(tree, field=F.col) -> Column:
    """A number, a field's name, or (op, a, b, ...): sum, difference, product,
    ratio, minimum, maximum.  Null if any part is, and where a ratio's divisor
    is zero."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if isinstance(tree, str):
        return field(tree).try_cast("double")
    op, *parts = tree
    cols = [compile_measurement(p, field) for p in parts]
    if op in ("minimum", "maximum"):
        whole = reduce(operator.and_, [c.isNotNull() for c in cols])
        return F.when(whole, (F.least if op == "minimum" else F.greatest)(*cols) if len(cols) > 1 else cols[0])
    return reduce({"sum": operator.add, "difference": operator.sub, "product": operator.mul, "ratio": F.try_divide}[op], cols)
