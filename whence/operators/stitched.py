"""Windows over a key that may hold a third of all rows.

Rows are ranked within (key, bucket of time), so a key's rows lie in many tasks.
What crosses the borders of buckets - how many rows came before, the last row of
an earlier bucket, the first of a later one, a maximum so far - comes from a
second window over one row for each bucket that has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import micros

HOUR_US = 3_600_000_000


def bucket_of(at: Column, width_us: int = HOUR_US) -> Column:
    """The bucket of an instant; rows without one come first, in a bucket of their own."""
    return F.coalesce(F.floor(micros(at) / width_us), F.lit(-(1 << 62))).cast("bigint")


def stitched(
    rows: DataFrame,
    key: str,
    order: list[str],
    bucket: Column,
    position: str | None = None,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    most_before: dict[str, str] | None = None,
) -> DataFrame:
    """rows with columns that a window over key, ordered by order (ascending), would give.

    position: a name for the place from 0.  before, after: {new name: column} of
    the row before and after, null if there is none.  most_before: {new name:
    column}, the greatest value of all rows before.  bucket may not fall as rows
    go on in order; a null key is a key.  Rows that are alike in all of order
    have no order of their own, as in any window.  Names that begin with two underscores are taken.
    """
    before, after, most_before = before or {}, after or {}, most_before or {}
    rows = rows.withColumn("__bucket", bucket)
    own = Window.partitionBy(key, "__bucket").orderBy(*order)
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("__bucket")
    row = lambda names: F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    sums = [F.count("*").alias("__n"), F.max(row(before.values())).alias("__last"), F.min(row(after.values())).alias("__first")]
    sums += [F.max(c).alias(f"__most{i}") for i, c in enumerate(most_before.values())]
    carried = rows.groupBy(key, "__bucket").agg(*sums)
    past = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        F.col(key).alias("__key"),
        F.col("__bucket").alias("__at"),
        F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n"),
        F.lag("__last").over(across).alias("__last"),
        F.lead("__first").over(across).alias("__first"),
        *[F.max(f"__most{i}").over(past).alias(f"__most{i}") for i in range(len(most_before))],
    )
    out = rows.withColumn("__row", F.row_number().over(own)).withColumn("__rest", F.lead(F.lit(True), 1, False).over(own))
    for new, c in before.items():
        out = out.withColumn(f"__before_{new}", F.lag(c).over(own))
    for new, c in after.items():
        out = out.withColumn(f"__after_{new}", F.lead(c).over(own))
    for new, c in most_before.items():
        out = out.withColumn(f"__most_{new}", F.max(c).over(above))
    out = out.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__at")))
    names = {position: F.col("__n") + F.col("__row") - 1} if position else {}
    names |= {new: F.when(F.col("__row") == 1, F.col(f"__last.c{i}")).otherwise(F.col(f"__before_{new}")) for i, new in enumerate(before)}
    names |= {new: F.when(~F.col("__rest"), F.col(f"__first.c{i}")).otherwise(F.col(f"__after_{new}")) for i, new in enumerate(after)}
    names |= {new: F.greatest(F.col(f"__most_{new}"), F.col(f"__most{i}")) for i, new in enumerate(most_before)}
    return out.select(*[c for c in rows.columns if c != "__bucket"], *[c.alias(n) for n, c in names.items()])
