"""The tables bound to the model: events with uncertain times, timelines, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import interval
from .delimited import letters


#: Types of event whose time is known to an hour or a minute only; of others it is exact.
KNOWN_TO = {"signup": "HOUR", "error": "MINUTE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, timeline_id (user and day), user_id, event_type, at (interval),
    value, k (the number in props) and its decade.  The log's times are exact;
    known is the interval that a declared precision of the type leaves."""
    e = table(spark, sf_dir, "events")
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    return e.select(
        "event_id",
        F.concat_ws("@", F.col("user_id").cast("string"), day).alias("timeline_id"),
        "user_id",
        "event_type",
        interval(F.col("ts"), "EXACT").alias("at"),
        reduce(lambda c, p: F.when(F.col("event_type") == p[0], interval(F.col("ts"), p[1])).otherwise(c), KNOWN_TO.items(), interval(F.col("ts"), "EXACT")).alias("known"),
        "ts",
        "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.floor(F.get_json_object("props", "$.k").try_cast("bigint") / 10).alias("decade"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id (the order), event_type, at: placed and shipped on a day,
    returned and fulfilled at an unknown time."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    never = F.lit(None).cast("timestamp_ntz")
    placed = o.select(F.col("o_orderkey").alias("entity_id"), F.lit("ORDER_PLACED").alias("event_type"), interval(F.col("o_orderdate"), "DAY").alias("at"))
    shipped = line.select("l_orderkey", F.lit("LINE_SHIPPED"), interval(F.col("l_shipdate"), "DAY"))
    returned = line.where("l_returnflag = 'R'").select("l_orderkey", F.lit("LINE_RETURNED"), interval(never, "DAY"))
    fulfilled = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("ORDER_FULFILLED"), interval(never, "DAY"))
    return placed.union(shipped).union(returned).union(fulfilled)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", columns: list[str] | None = None, quoted_lines: bool = True) -> DataFrame:
    """A delimited file as text, every column a string; the header must be the
    declared one.  Spark reads few encodings, so a file in another one of one
    byte a letter (cp1252, say) is read as Latin-1 and its letters translated.
    quoted_lines: fields may hold line ends; then a file can't be split and is
    one task.  Without them it is read in parts."""
    direct = encoding.lower() in ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-32")
    raw = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding if direct else "iso-8859-1").option("multiLine", quoted_lines).option("escape", '"').csv(path)
    if not direct:
        old, new = letters(encoding)
        table = str.maketrans(old, new)
        raw = raw.select([F.translate(F.col(f"`{c}`"), old, new).alias(c.translate(table)) for c in raw.columns])
    if columns is not None and raw.columns != columns:
        raise ValueError(f"header differs from the declared one: {raw.columns}")
    return raw


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's rows under its own partition; another run's stay as they are."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
