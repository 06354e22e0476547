"""Who may have caused whom: pair joins, candidate generators, gate and cap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import in_window, separation, verdict
from ..shared import written
from .rules import CausalRule


def ordered_pairs(sequenced: DataFrame, key: str = "timeline_id") -> DataFrame:
    """(cause, effect) structs of every earlier and later event of a timeline.

    An equi-join on the timeline with an order condition; AQE splits a timeline
    that has most events.  It is as large as the timelines' squares: callers
    bound the timeline (a user's day, an order), not the join.
    """
    cols = [c for c in sequenced.columns if c != key]
    a = sequenced.select(key, F.struct(*cols).alias("cause"))
    b = sequenced.select(key, F.struct(*cols).alias("effect"))
    return a.join(b, key).where("cause.position < effect.position").select(key, "cause", "effect")


def near_pairs(events: DataFrame, entity: str, most_us: int, ties: bool = False) -> DataFrame:
    """(cause, effect) structs of an entity's events within a span, by a bucketed
    band join: an event meets its own and the next bucket of that width only.
    ties: events of one instant too, in order of their ids."""
    rows = events.where(F.col(entity).isNotNull())
    if "us" not in rows.columns:
        rows = rows.withColumn("us", F.unix_micros(F.col("at.t_earliest").cast("timestamp")))
    bucket = F.floor(F.col("us") / most_us)
    own = F.struct(*rows.columns)
    a = rows.select(F.col(entity).alias("entity"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"), own.alias("cause"))
    b = rows.select(F.col(entity).alias("entity"), bucket.alias("bucket"), own.alias("effect"))
    gap = F.col("effect.us") - F.col("cause.us")
    after = (gap > 0) | ((gap == 0) & (F.col("cause.event_id") < F.col("effect.event_id"))) if ties else gap > 0
    # By merging: a pair is dearer than a row, so even a small log's pairs are dealt to all tasks.
    return a.join(b.hint("merge"), ["entity", "bucket"]).where(after & (gap <= most_us)).select("cause", "effect")


class Generator(NamedTuple):
    """Proposes the pairs that fit, all of one kind and strength."""

    name: str
    kind: str
    strength: float
    fits: Column


def judged(pairs: DataFrame, generators: Sequence[Generator], hops: int = 0, also: dict[str, Column] | None = None) -> DataFrame:
    """Of each (cause, effect) that some generator proposes: source, target, types,
    verdict, hops, width (microseconds that the two times leave open) and whether
    each generator (g0, g1, ...) does.  One pass, with nothing shuffled.  also:
    further columns."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    open_ = sum(us(f"{e}.known.t_latest") - us(f"{e}.known.t_earliest") for e in ("cause", "effect"))
    told = F.struct(
        F.col("cause.event_id").alias("source"),
        F.col("effect.event_id").alias("target"),
        F.col("cause.event_type").alias("source_type"),
        F.col("effect.event_type").alias("target_type"),
        verdict("cause.known", "effect.known").alias("verdict"),
        F.lit(hops).alias("hops"),
        open_.alias("width"),
        *[F.coalesce(g.fits, F.lit(False)).alias(f"g{i}") for i, g in enumerate(generators)],
        *[c.alias(n) for n, c in (also or {}).items()],
    )
    # Inlined, so that the filter isn't moved into the join, where every pair of a bucket would be judged a second time.
    rows = pairs.select(F.inline(F.array(told)))
    return rows.where(" or ".join(f"g{i}" for i in range(len(generators))))


def claimed(rows: DataFrame, generators: Sequence[Generator]) -> DataFrame:
    """A row for each proposal of judged() pairs."""
    hit = [
        F.when(F.col(f"g{i}"), F.struct(F.lit(g.name).alias("generator"), F.lit(g.kind).alias("kind"), F.lit(g.strength).alias("strength")))
        for i, g in enumerate(generators)
    ]
    own = rows.select("source", "target", "source_type", "target_type", "verdict", "hops", F.explode(F.array(*hit)).alias("hit"))
    return own.where("hit is not null").select("*", "hit.*").drop("hit")


def fused(rows: DataFrame, generators: Sequence[Generator]) -> DataFrame:
    """judged() pairs, each of which comes once, as one candidate per pair and kind:
    its generators, their strengths by noisy or, and that of its rules alone (0
    if none proposes it)."""
    kinds = []
    for kind in sorted({g.kind for g in generators}):
        own = [(F.col(f"g{i}"), g) for i, g in enumerate(generators) if g.kind == kind]
        names = {g.name: reduce(lambda a, b: a | b, [c for c, x in own if x.name == g.name]) for _, g in own}
        chance = lambda of: 1 - reduce(lambda a, b: a * b, [F.when(c, 1 - g.strength).otherwise(1.0) for c, g in of], F.lit(1.0))
        claim = F.struct(
            F.lit(kind).alias("kind"),
            F.concat_ws(",", *[F.when(names[n], F.lit(n)) for n in sorted(names)]).alias("generators"),
            sum((c.cast("bigint") for c in names.values()), F.lit(0).cast("bigint")).alias("n_generators"),
            chance(own).alias("strength"),
            chance([(c, g) for c, g in own if g.name == "rule_based"]).alias("rule"),
        )
        kinds.append(F.when(reduce(lambda a, b: a | b, [c for c, _ in own]), claim))
    base = [c for c in rows.columns if not (c[0] == "g" and c[1:].isdigit())]
    each = rows.select(*base, F.explode(F.array(*kinds)).alias("claim")).where("claim is not null")
    return each.select(*base, "claim.*")


def proposals(pairs: DataFrame, generator: str, strength: float, kind: str, hops: int = 0) -> DataFrame:
    """source, target, types, generator, kind, strength, verdict and the links
    between their entities (0: the same entity) of each pair.  The verdict goes
    by the interval in which each event is known to lie."""
    return pairs.select(
        F.col("cause.event_id").alias("source"),
        F.col("effect.event_id").alias("target"),
        F.col("cause.event_type").alias("source_type"),
        F.col("effect.event_type").alias("target_type"),
        F.lit(generator).alias("generator"),
        F.lit(kind).alias("kind"),
        F.lit(strength).alias("strength"),
        verdict("cause.known", "effect.known").alias("verdict"),
        F.lit(hops).alias("hops"),
    )


def temporal_proximity(pairs: DataFrame, windows: dict[tuple[str, str], tuple[int, int]], strength: float = 0.3) -> DataFrame:
    """Pairs whose separation overlaps the window declared for their types."""
    return proposals(pairs.where(within_windows(windows)), "temporal_proximity", strength, "DIRECT")


def within_windows(windows: dict[tuple[str, str], tuple[int, int]]) -> Column:
    # The types choose the window's ends: with a test per window the code of a pair outgrows what the JVM compiles.
    low, high = separation("cause.at", "effect.at", clipped=True)
    end = lambda i: reduce(lambda w, x: w.when((F.col("cause.event_type") == x[0][0]) & (F.col("effect.event_type") == x[0][1]), x[1][i]), windows.items(), F.when(F.lit(False), F.lit(None).cast("long")))
    return in_window(low, high, end(0), end(1), unknown_fits=False)


def shared_entity(events: DataFrame, entity: str, most_us: int, strength: float = 0.55) -> DataFrame:
    """Pairs of events about one entity within a span."""
    return proposals(near_pairs(events, entity, most_us), "shared_entity", strength, "STRUCTURAL")


def structural_path(events: DataFrame, tie: str, own: str, most_us: int, hops: int, strength: float = 0.45) -> DataFrame:
    """Pairs of events of different entities (own) that a path of so many links
    ties to one another (tie: what the path goes through), within a span."""
    near = near_pairs(events, tie, most_us).where(F.col(f"cause.{own}") != F.col(f"effect.{own}"))
    return proposals(near, "structural_path", strength, "STRUCTURAL", hops)


def shared_identifier(pairs: DataFrame, field: str, strength: float = 0.35) -> DataFrame:
    """Pairs of a timeline that carry the same value of a declared field."""
    return proposals(pairs.where(F.col(f"cause.{field}") == F.col(f"effect.{field}")), "shared_identifier", strength, "DIRECT")


def type_pair_counts(events: DataFrame, ordered: bool, key: str = "timeline_id") -> DataFrame:
    """cause_type, effect_type, both, with_cause, with_effect, instances: in how
    many timelines.  ordered: in how many some cause comes before some effect,
    that is, the first of the one type before the last of the other, so only the
    types of a timeline are joined, not its events; else presence."""
    at = F.struct("at.t_earliest", "at.t_latest", "event_id")
    place = [F.min(at).alias("first"), F.max(at).alias("last")] if ordered else [F.lit(1).alias("present")]
    own = F.struct("event_type", *(["first", "last"] if ordered else []))
    # A row per timeline with its types, which the vocabulary bounds: all counts come from this one table.
    held = events.groupBy(key, "event_type").agg(*place).groupBy(key).agg(F.collect_list(own).alias("types"))
    held = written(held, "types")
    n = held.select(F.explode("types.event_type").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))
    total = held.agg(F.count("*").alias("instances"))
    both = held.where(F.col(key).isNotNull()).select(F.explode("types").alias("a"), "types").select("a", F.explode("types").alias("b"))
    both = both.where("a.first < b.last" if ordered else "a.event_type <> b.event_type")
    both = both.groupBy(F.col("a.event_type").alias("cause_type"), F.col("b.event_type").alias("effect_type")).agg(F.count("*").alias("both"))
    return (
        both.join(F.broadcast(n.select(F.col("event_type").alias("cause_type"), F.col("n").alias("with_cause"))), "cause_type")
        .join(F.broadcast(n.select(F.col("event_type").alias("effect_type"), F.col("n").alias("with_effect"))), "effect_type")
        .crossJoin(F.broadcast(total))
        .select("cause_type", "effect_type", "both", "with_cause", "with_effect", "instances")
    )


#: Types whose orders within a timeline are bits of one long, a bit for each two.
FEW_TYPES = 7


def orders_of_days(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(daily, weekly): type_pair_counts() of a user's days, ordered, and of a user's
    weeks, by presence, of events(user_id, day, us, event_type, event_id).

    Up to seven types a day is one row: first and last time of each type, by plain
    aggregates that need no sorting, from these the types that it has and which
    comes before which.  Days alike are counted as one.  Where ids would have to
    decide between equal times, the day goes the longer way."""
    spark = events.sparkSession
    types = sorted(r.event_type for r in events.select("event_type").where("event_type is not null").distinct().limit(FEW_TYPES + 1).collect())
    if not 0 < len(types) <= FEW_TYPES:
        named = lambda span: events.withColumns({"timeline_id": F.struct("user_id", span), "at": F.struct(F.col("us").alias("t_earliest"), F.col("us").alias("t_latest"))})
        return type_pair_counts(named("day"), True), type_pair_counts(named(F.trunc("day", "week")), False)
    each = list(enumerate(types))
    mine = lambda t: F.when(F.col("event_type") == t, F.col("us"))
    days = events.groupBy("user_id", "day").agg(*[f(mine(t)).alias(f"{n}{i}") for i, t in each for f, n in ((F.min, "first"), (F.max, "last"), (F.count, "n"))])
    either = lambda bits: reduce(lambda x, y: x.bitwiseOR(y), bits)
    bit = lambda holds, i: F.when(holds, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    mask = either([bit(F.col(f"n{i}") > 0, i) for i, _ in each])
    before = either([bit(F.col(f"first{i}") < F.col(f"last{j}"), i * len(types) + j) for i, _ in each for j, _ in each])
    tied = reduce(lambda x, y: x | y, [(F.col(f"first{i}") == F.col(f"last{j}")) & ((F.col(f"n{i}") > 1) if i == j else F.lit(True)) for i, _ in each for j, _ in each])
    days = written(days.select("user_id", "day", mask.alias("mask"), before.alias("before"), F.coalesce(tied, F.lit(False)).alias("tied")), "days")
    names = spark.createDataFrame([(a, b, 1 << i, 1 << j, 1 << (i * len(types) + j)) for i, a in each for j, b in each], "cause_type string, effect_type string, a long, b long, pair long")
    has = lambda mask, bit: F.col(mask).bitwiseAND(F.col(bit)) != 0

    def told(alike: DataFrame, both: Column) -> DataFrame:
        held = lambda holds: F.sum(F.when(holds, F.col("n")).otherwise(0))
        rows = alike.crossJoin(F.broadcast(names)).groupBy("cause_type", "effect_type")
        rows = rows.agg(held(both).alias("both"), held(has("mask", "a")).alias("with_cause"), held(has("mask", "b")).alias("with_effect"), F.sum("n").alias("instances"))
        return rows.where("both > 0")

    # Types of a tied day by their first and last event, and which comes before which, as of the others.
    ties = days.where("tied").select(F.col("user_id").alias("u"), F.col("day").alias("d"), "mask")
    at = F.struct("us", "event_id")
    alike = days.where("not tied").select("mask", "before")
    exact = events.where("event_type is not null").join(ties, F.col("user_id").eqNullSafe(F.col("u")) & F.col("day").eqNullSafe(F.col("d")))
    exact = exact.groupBy("u", "d").agg(F.first("mask").alias("mask"), *[f(F.when(F.col("event_type") == t, at)).alias(f"{n}{i}") for i, t in each for f, n in ((F.min, "first"), (F.max, "last"))])
    alike = alike.union(exact.select("mask", before)).groupBy("mask", "before").agg(F.count("*").alias("n"))
    weeks = days.groupBy("user_id", F.trunc("day", "week").alias("week")).agg(F.bit_or("mask").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    return told(alike, has("before", "pair")), told(weeks, has("mask", "a") & has("mask", "b") & (F.col("a") != F.col("b")))


def by_types(pairs: DataFrame, chosen: DataFrame, generator: str, strength: float, both_ways: bool = False) -> DataFrame:
    """Pairs whose types are among the chosen (cause_type, effect_type).  both_ways:
    what tells no order proposes the reverse too where times leave it open."""
    types = (F.col("cause.event_type") == F.col("cause_type")) & (F.col("effect.event_type") == F.col("effect_type"))
    hit = pairs.select("cause", "effect").join(F.broadcast(chosen.select("cause_type", "effect_type")), types, "left_semi")
    if both_ways:
        open_ = hit.where(verdict("cause.known", "effect.known") == "UNDETERMINED")
        hit = hit.union(open_.select("effect", "cause"))
    return proposals(hit, generator, strength, "STATISTICAL")


def rule_kind(rule: CausalRule) -> str:
    return "DIRECT" if rule.condition == ("all",) else "CONDITIONAL"


def rule_based(fired: DataFrame, rules: Sequence[CausalRule]) -> DataFrame:
    """A proposal of each firing (with its cause and effect), as strong as its rule."""
    kind = reduce(lambda w, r: w.when(F.col("rule_id") == r.rule_id, rule_kind(r)), rules, F.when(F.lit(False), None))
    return fired.select(
        F.col("cause.event_id").alias("source"),
        F.col("effect.event_id").alias("target"),
        F.col("cause.event_type").alias("source_type"),
        F.col("effect.event_type").alias("target_type"),
        F.lit("rule_based").alias("generator"),
        kind.alias("kind"),
        "strength",
        verdict("cause.known", "effect.known").alias("verdict"),
        F.lit(0).alias("hops"),
    )


def connected_within(links: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """a, b, hops: what each source (a) is joined to by up to so many undirected
    links, by the fewest.  Only paths from the sources are followed: between all
    entities of a hub there would be as many as its square."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    step = both.join(sources.select("a").distinct(), "a", "left_semi")
    found = step.withColumn("hops", F.lit(1))
    for h in range(2, hops + 1):
        step = step.join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", F.col("c").alias("b")).distinct()
        found = found.union(step.withColumn("hops", F.lit(h)))
    return found.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def gate(candidates: DataFrame, prohibited: DataFrame | None = None) -> DataFrame:
    """reason: why a candidate is refused, null if it isn't.  Refused ones stay as rows."""
    if prohibited is None:
        barred = candidates.withColumn("barred", F.lit(False))
    else:
        marks = F.broadcast(prohibited.select("source_type", "target_type", F.lit(True).alias("barred")).distinct())
        barred = candidates.join(marks, ["source_type", "target_type"], "left")
    reason = F.when(F.col("source") == F.col("target"), "SELF_EDGE").when(F.col("verdict") == "VIOLATION", "TEMPORAL_VIOLATION").when(F.coalesce("barred", F.lit(False)), "CONSTRAINT_SUPPRESSED")
    return barred.withColumn("reason", reason).drop("barred")


def round_robin(proposed: DataFrame, cap: int) -> DataFrame:
    """At most cap proposals per effect, taken from its generators in turn."""
    own = Window.partitionBy("target", "generator").orderBy("source", "kind")
    every = Window.partitionBy("target").orderBy("turn", "generator")
    return proposed.withColumn("turn", F.row_number().over(own)).withColumn("taken", F.row_number().over(every)).where(F.col("taken") <= cap).drop("turn", "taken")


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c of a->b->c with a->c: b may mediate, a may be the common cause."""
    e = edges.select("source", "target").distinct()
    ab, bc, ac = (e.toDF(*names) for names in (("a", "b"), ("b", "c"), ("a", "c")))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")
