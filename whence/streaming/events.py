"""The log as a stream: counts by window, and a machine's state kept per key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "timeline_id string, event_id long, event_type string, from_state string, to_state string, illegal boolean, version long"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files under a path, with the schema they have now.

    A pattern for the last letter lets the path be one file as well as a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def window_counts(stream: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """start, event_type, n: events per window, for output mode update: a window
    comes again when it changes.  Windows that the watermark has passed leave
    the state, and events later than the lateness don't count."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def replay_stream(stream: DataFrame, transitions: dict[tuple[str, str], str], lateness: str = "1 day", groups: int = 256) -> DataFrame:
    """Transitions of each user's day, with the version of the day that they belong
    to.  A day's events are kept until the watermark has passed it; whenever some
    arrive, in whatever order, all of the day are taken by time again and come out
    as its next version, which stands for the ones before.  The first event that
    triggers anything sets the state, an illegal one halts the day.

    A state holds one of so many groups of users on one day, as calling Python is
    dearer than a user's few events; only users who have new events come out."""
    first: dict[str, str] = {}
    for (_, trigger), to in sorted(transitions.items()):
        first.setdefault(trigger, to)
    names = [c.split()[0] for c in STEP.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lines, us, ids, types, known, versions = state.get if state.exists else ([], [], [], [], [], [])
        held, new = set(zip(lines, us, ids, types, strict=True)), set()
        for p in parts:
            new.update(p["timeline_id"].tolist())
            held.update(zip(p["timeline_id"].tolist(), p["us"].tolist(), p["event_id"].tolist(), p["event_type"].tolist(), strict=True))
        held = sorted(held)
        version = dict(zip(known, versions, strict=True))
        for line in new:
            version[line] = version.get(line, 0) + 1
        state.update((*([h[i] for h in held] for i in range(4)), list(version), list(version.values())))
        day_end = (max(h[1] for h in held) // 86_400_000_000 + 1) * 86_400_000
        state.setTimeoutTimestamp(max(day_end, state.getCurrentWatermarkMs() + 1))
        last, now, rows = None, None, []
        for line, _, event_id, event_type in held:
            if line not in new:
                continue
            if line != last:
                last, now = line, None
            if event_type in first and now != "!":
                to = first[event_type] if now is None else transitions.get((now, event_type), "!")
                rows.append((line, event_id, event_type, now, None if to == "!" else to, to == "!", version[line]))
                now = to
        yield pd.DataFrame(rows, columns=names)

    date = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat_ws("@", F.col("user_id").cast("string"), date)
    at = F.col("ts").cast("timestamp")
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups))
    keyed = stream.select(date.alias("day"), group.alias("group"), line.alias("timeline_id"), "event_id", "event_type", F.unix_micros(at).alias("us"), at.alias("at")).withWatermark("at", lateness)
    state = "timelines array<string>, us array<bigint>, ids array<bigint>, types array<string>, known array<string>, versions array<bigint>"
    return keyed.groupBy("day", "group").applyInPandasWithState(run, STEP, state, "append", GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, key: list[str], lateness: str = "1 day") -> DataFrame:
    """The first to arrive of the rows with one key, however often and in whatever
    order they come within the lateness of each other; a key leaves the state when
    the watermark has passed it.  Rows later than the watermark don't count."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(key).drop("at")


def joined(causes: DataFrame, effects: DataFrame, key: str, within: str, lateness: str = "1 day") -> DataFrame:
    """source, target, key, gap_us of every cause and effect of one key that follows it
    by more than nothing and at most `within`.  Two streams with watermarks of their
    own: each side's rows leave the state when the other side's watermark rules
    out that a partner still comes."""
    a = causes.select(F.col(key).alias("a_key"), F.col("event_id").alias("source"), F.col("ts").cast("timestamp").alias("a_at")).withWatermark("a_at", lateness)
    b = effects.select(F.col(key).alias("b_key"), F.col("event_id").alias("target"), F.col("ts").cast("timestamp").alias("b_at")).withWatermark("b_at", lateness)
    met = a.join(b, F.expr(f"a_key = b_key AND b_at > a_at AND b_at <= a_at + INTERVAL {within}"))
    return met.select("source", "target", F.col("a_key").alias(key), (F.unix_micros("b_at") - F.unix_micros("a_at")).alias("gap_us"))


def run_to_table(stream: DataFrame, base: str, mode: str, where: str | None = None) -> DataFrame:
    """Runs all that is there now into a table under base, and reads it: every
    batch's rows, with its number as batch.  A batch that is run again after a
    failure overwrites its own folder only.  where: the folder of an earlier run,
    whose progress and rows are taken up again."""
    spark = stream.sparkSession
    where = where or f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{where}/rows/batch-{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch bigint").option("recursiveFileLookup", "true").parquet(f"{where}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def latest(rows: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """Of each key the rows of its last version."""
    last = rows.groupBy(*key).agg(F.max(version).alias("_last"))
    return rows.join(last, key).where(F.col(version) == F.col("_last")).select(*key, *values)
