"""How far a simulated world is from what the data have shown.

A link's changed gap is held against the gaps that its kind of link has shown:
WITHIN them, AT_EDGE, an EXTRAPOLATION, or NOT_ASSESSABLE where too few were
seen.  An event is as valid as the weakest link that led to it and as the
weakest cause, so verdicts are carried along chains and the worse one wins where
chains join; beliefs, the least confidence on the way, likewise.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: From strong to weak; nothing that follows from the last is any better.
VERDICTS = ("WITHIN", "AT_EDGE", "EXTRAPOLATION", "NOT_ASSESSABLE")


def verdict(asked: Column, low: Column, high: Column, seen: Column, least: int, tolerance: float) -> Column:
    """The number of the verdict on one request beside what was seen; a null is NOT_ASSESSABLE."""
    beyond = F.greatest(low - asked, asked - high)
    judged = F.when(beyond <= 0, 0).when(beyond <= tolerance * (high - low), 1).otherwise(2)
    return F.when((seen >= least) & asked.isNotNull() & low.isNotNull() & high.isNotNull(), judged).otherwise(3)


def carried(links: DataFrame, starts: DataFrame) -> DataFrame:
    """set_id, node, verdict (a name), belief of every start(set_id, node) and of
    all that links(set_id, source, target, verdict, belief) lead to from them.

    A start has the verdicts of the links into it and of their sources, too, but
    a belief of one where no link leads to it.  Only what got worse in a
    round is followed in the next one; as verdicts and beliefs can only get worse,
    and have no more values than links, loops end.
    """
    by = ["set_id", "node"]
    e = written(links.select("set_id", "source", "target", "verdict", "belief"), "valid-links")
    known = written(starts.select(*by).distinct().withColumns({"verdict": F.lit(0), "belief": F.lit(1.0), "new": F.lit(True)}), "valid")
    # Links into starts from where nothing changes: their own verdicts count.
    outer = e.join(known.select("set_id", F.col("node").alias("source")), ["set_id", "source"], "left_anti")
    outer = outer.join(known.select("set_id", F.col("node").alias("target")), ["set_id", "target"], "left_semi")
    step = outer.groupBy("set_id", F.col("target").alias("node")).agg(F.max("verdict").alias("verdict2"), F.min("belief").alias("belief2"))
    for round_ in count():
        both = known.drop("new").join(step, by, "full")
        worse = F.col("verdict").isNull() | (F.coalesce("verdict2", F.lit(0)) > F.col("verdict")) | (F.coalesce("belief2", F.lit(1.0)) < F.col("belief"))
        first = F.lit(round_ == 0) & F.col("verdict").isNotNull()
        known = written(both.select(*by, F.greatest("verdict", "verdict2").alias("verdict"), F.least("belief", "belief2").alias("belief"), (worse | first).alias("new")), "valid")
        last = known.where("new").select("set_id", F.col("node").alias("source"), F.col("verdict").alias("of"), F.col("belief").alias("held"))
        if last.isEmpty():
            break
        out = last.join(e, ["set_id", "source"]).groupBy("set_id", F.col("target").alias("node"))
        step = written(out.agg(F.max(F.greatest("verdict", "of")).alias("verdict2"), F.min(F.least("belief", "held")).alias("belief2")), "worse")
    names = F.array(*[F.lit(v) for v in VERDICTS])
    return known.select(*by, F.element_at(names, F.col("verdict") + 1).alias("verdict"), "belief")
