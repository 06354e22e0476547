"""What a raw table holds: profiles, quantiles, outliers, keys, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import classify
from .stitched import bucket_of, stitched


def first_rows(rows: DataFrame, key: list[str], order: list, n: int, parts: int = 256) -> DataFrame:
    """Each key's first n rows, with their place as r.  Ranked within hashed parts
    of a key first, so that a key with most of the rows isn't one task's."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    near = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order))).where(F.col("r") <= n)
    return near.drop("part").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("r") <= n)


def column_profile(rows: DataFrame, top: int = 3) -> DataFrame:
    """Of every column: rows, blanks, distinct values, least and greatest text,
    the kinds of values and the most frequent ones, in one unpivoted pass."""
    text = rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    long = text.unpivot([], text.columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    used = F.trim(F.coalesce("value", F.lit(""))) != ""
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(used, 0).otherwise(F.col("n"))).alias("blanks"),
        F.count(F.when(used, F.lit(1))).alias("distinct_values"),
        F.min(F.when(used, F.col("value"))).alias("least"),
        F.max(F.when(used, F.col("value"))).alias("greatest"),
        F.array_join(F.array_sort(F.collect_set(classify(F.col("value")))), ",").alias("kinds"),
    )
    often = first_rows(counts, ["column"], [F.col("n").desc(), "value"], top)
    often = often.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), "|").alias("often"))
    return summary.join(often, "column")


def histogram(rows: DataFrame, column: str, bins: int = 1024) -> DataFrame:
    """bin, n, centre over equal bins between the exact bounds."""
    bounds = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    spot = F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))
    placed = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))
    placed = placed.select(F.when(width > 0, spot).otherwise(0).cast("bigint").alias("bin"), (F.col("low") + (F.when(width > 0, spot).otherwise(0) + 0.5) * width).alias("centre"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.min("centre").alias("centre"))


def quantiles(hist: DataFrame, shares: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """share, value: the centre of the first bin at which so many rows lie below."""
    w = Window.orderBy("bin")  # at most one row per bin
    total = hist.agg(F.sum("n").alias("total"))
    run = hist.withColumn("below", F.sum("n").over(w)).crossJoin(F.broadcast(total))
    return run.select(F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "bin", "below", "total", "centre").where(F.col("below") >= F.col("share") * F.col("total")).groupBy("share").agg(F.min_by("centre", "bin").alias("value"))


def tukey_outliers(hist: DataFrame, quantile: DataFrame) -> DataFrame:
    """low_fence, high_fence, outliers: rows in bins beyond 1.5 interquartile ranges."""
    q = quantile.agg(F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("share") == 0.75, F.col("value"))).alias("q3"))
    q = q.select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low_fence"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high_fence"))
    out = hist.crossJoin(F.broadcast(q)).groupBy("low_fence", "high_fence")
    return out.agg(F.sum(F.when((F.col("centre") < F.col("low_fence")) | (F.col("centre") > F.col("high_fence")), F.col("n")).otherwise(0)).alias("outliers"))


def identity_conflicts(rows: DataFrame, key: list[str], order: list[str], content: list[str]) -> DataFrame:
    """Of every key with more than one row: rows, different contents, and rows
    that differ from the first."""
    print_ = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content])
    marked = rows.withColumn("print", print_)
    first = marked.groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct("print").alias("contents"), F.min_by("print", F.struct(*order, "print")).alias("first")).where("rows > 1")
    differ = marked.join(first, key).where("print <> first").groupBy(*key).agg(F.count("*").alias("conflicting"))
    return first.join(differ, key, "left").select(*key, "rows", "contents", F.coalesce("conflicting", F.lit(0)).alias("conflicting"))


def resolve(rows: DataFrame, key: str, order: list[str], attributes: list[str], last: bool = False) -> DataFrame:
    """One row per key: of each attribute the first (or last) value that isn't null."""
    by = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(*[pick(a, F.when(F.col(a).isNotNull(), by)).alias(a) for a in attributes], F.count("*").alias("witnesses"))


def history(rows: DataFrame, key: str, order: list[str], attribute: str) -> DataFrame:
    """Every change of an attribute, and whether a later one superseded it.  order
    begins with an instant, by whose hours a key's rows are cut."""
    at = bucket_of(F.col(order[0]))
    changed = stitched(rows.select(key, *order, attribute), key, order, at, position="_place", before={"_was": attribute})
    changed = changed.where((F.col("_place") == 0) | ~F.col(attribute).eqNullSafe(F.col("_was"))).withColumn("_true", F.lit(True))
    told = stitched(changed.drop("_place", "_was"), key, order, at, position="_version", after={"_next": "_true"})
    return told.select(key, (F.col("_version") + 1).cast("bigint").alias("version"), F.col(attribute).alias("value"), F.coalesce("_next", F.lit(False)).alias("superseded"))


def residuals(rows: DataFrame, left: str, right: str, days: str) -> DataFrame:
    """Is right = left + days?  residual_days and how many rows have it; null: unevaluable."""
    off = F.date_diff(F.to_date(right), F.to_date(left)) - F.col(days)
    return rows.groupBy(off.cast("bigint").alias("residual_days")).agg(F.count("*").alias("n"))
