"""Evidence that claims bring with them, kept through fusion.

Claims of one pair and kind are merged whatever their order and in whatever
groups: distinct evidence is counted exactly, its first ids are kept and the
rest counted as left out, and distinct payloads add up to one hash, which is the
same for the same set; two payloads of one pair diverge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiling import first_rows

KEY = ["source", "target", "kind"]


def _half(hashed: Column, at: int) -> Column:
    return F.coalesce(F.sum(F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")


def merged(claims: DataFrame, most: int) -> DataFrame:
    """source, target, kind, claims, n_evidence, evidence (the first `most` ids, joined by
    commas), left_out, payload (a hash of the set), diverges.

    claims(source, target, kind, evidence, payload): null evidence and null
    payloads don't count.  No more than `most` ids of a pair are gathered in a row.
    """
    counts = claims.groupBy(*KEY).agg(F.count("*").alias("claims"))
    ids = claims.where("evidence is not null").select(*KEY, "evidence").distinct()
    n = ids.groupBy(*KEY).agg(F.count("*").alias("n_evidence"))
    first = first_rows(ids, KEY, ["evidence"], most).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("evidence")), ",").alias("evidence"))
    hashed = F.sha2(F.col("payload"), 256)
    said = claims.where("payload is not null").select(*KEY, "payload").distinct().groupBy(*KEY)
    said = said.agg(F.count("*").alias("payloads"), F.concat_ws(":", _half(hashed, 1), _half(hashed, 16)).alias("payload"))
    rows = counts.join(n, KEY, "left").join(first, KEY, "left").join(said, KEY, "left")
    held = F.coalesce("n_evidence", F.lit(0))
    return rows.select(
        *KEY,
        "claims",
        held.alias("n_evidence"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.greatest(held - most, F.lit(0)).cast("long").alias("left_out"),
        F.coalesce("payload", F.lit("0:0")).alias("payload"),
        (F.coalesce("payloads", F.lit(0)) > 1).alias("diverges"),
    )


def ledger(proposed: DataFrame, capped: DataFrame) -> DataFrame:
    """generator, proposed, kept, dropped: what a cap took of each generator's proposals."""
    every = proposed.groupBy("generator").agg(F.count("*").alias("proposed"))
    kept = capped.groupBy("generator").agg(F.count("*").alias("kept"))
    rows = every.join(kept, "generator", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return rows.select("generator", "proposed", "kept", (F.col("proposed") - F.col("kept")).alias("dropped"))
