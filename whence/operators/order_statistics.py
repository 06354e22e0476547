"""Exact order statistics without a sort, by histograms that narrow.

A pass counts each group's values in the bins of a range, and keeps of each bin how
many there are, the least and the greatest.  The bin that holds a wanted rank is
the next pass's range, from its least value to its greatest; so a range loses at
least one value in two passes, mostly all but a thousandth in each, and ends when
the two are one.  Bins are equal by logarithm and by value in turn, as values may
lie in many orders of magnitude.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

BINS = 1024


def _by_logarithm(v: Column) -> Column:
    """Rises with v over all doubles, whose logarithms lie within 746 of zero."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 800))


def _by_value(v: Column) -> Column:
    return v / 2  # so that no range is wider than doubles go


def at_ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """group, rank, value of wanted(group, rank), ranks from 1; a rank that a group
    doesn't have has no row.

    rows(group, value double); null values and NaN don't count.  Groups are meant
    to be few, such as columns or types: what is wanted is sent to all rows.
    """
    values = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("group", "value")
    ends = values.groupBy("group").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    found = written(wanted.join(ends, "group").where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n"))).select("group", "rank", "lo", "hi", F.lit(0).cast("long").alias("skip")).distinct(), "ranks")
    for scale in cycle((_by_logarithm, _by_value)):
        if found.where("lo < hi").isEmpty():
            break
        ranges = F.broadcast(found.where("lo < hi").select("group", "lo", "hi").distinct())
        value, lo, hi = (scale(F.col(c)) for c in ("value", "lo", "hi"))
        place = F.least(F.lit(BINS - 1), F.floor(F.try_divide(value - lo, hi - lo) * BINS).cast("int"))
        place = F.coalesce(place, F.lit(0))  # all of the range is one by logarithm
        inside = values.join(ranges, "group").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        counted = inside.groupBy("group", "lo", "hi", F.when(F.col("value") == F.col("hi"), BINS).otherwise(place).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        w = Window.partitionBy("group", "lo", "hi").orderBy("bin")
        counted = counted.withColumn("upto", F.sum("n").over(w))
        next_ = found.join(counted, ["group", "lo", "hi"], "left")
        hit = F.col("bin").isNull() | ((F.col("rank") - F.col("skip") <= F.col("upto")) & (F.col("rank") - F.col("skip") > F.col("upto") - F.col("n")))
        done = F.col("bin").isNull()
        found = written(
            next_.where(hit).select("group", "rank", F.when(done, F.col("lo")).otherwise(F.col("least")).alias("lo"), F.when(done, F.col("hi")).otherwise(F.col("most")).alias("hi"), (F.col("skip") + F.when(done, 0).otherwise(F.col("upto") - F.col("n"))).alias("skip")),
            "ranks",
        )
    return found.select("group", "rank", F.col("lo").alias("value"))


def summary(rows: DataFrame, bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """group, n, missing (share of nulls), least, median, greatest, mean, zeros, bins (counts of
    equal parts from low to high, joined by commas; the last part holds high) of every group
    of rows(group, value); values outside are in no bin."""
    v = F.col("value")
    part = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins))
    within = v.between(low, high)
    sums = [F.count("*").alias("n"), (F.count_if(v.isNull()) / F.count("*")).alias("missing"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.count_if(v == 0).alias("zeros"), F.count(v).alias("_n")]
    sums += [F.count_if(within & (part == i)).alias(f"_bin{i}") for i in range(bins)]
    told = written(rows.groupBy("group").agg(*sums), "sums")
    middles = told.select("group", F.explode(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)).alias("rank")).distinct()
    median = at_ranks(rows, middles).groupBy("group").agg(F.avg("value").alias("median"))
    joined = F.concat_ws(",", *[F.col(f"_bin{i}").cast("string") for i in range(bins)]).alias("bins")
    return told.join(median, "group", "left").select("group", "n", "missing", "least", "median", "greatest", "mean", "zeros", joined)
