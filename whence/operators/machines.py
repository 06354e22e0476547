"""State machines over timelines, as compositions of transitions.

What an event does to a machine is a map from states to states, and maps compose
whatever way they are bracketed.  So a timeline is cut into blocks of events, a
block is worth one composed map, blocks of blocks another, up to one for the
whole; then the state that each block starts from is handed down again.  Every
step is a grouped aggregate of a bounded number of rows, so a timeline of any
length is folded by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Events, or blocks, that one row gathers.
BLOCK = 32


class Machine:
    """States are numbered: 0 before any, then the declared ones, then the halt.

    transitions: (from state, event type) -> to state.  The first event that
    triggers any transition sets the state, whichever the first transition of its
    type in order of names leads to; from then on one that triggers a transition,
    but none from here, halts the machine, and one that triggers none is ignored.
    """

    def __init__(self, transitions: dict[tuple[str, str], str]):
        self.states = sorted({s for s, _ in transitions} | set(transitions.values()))
        number = {s: i + 1 for i, s in enumerate(self.states)}
        self.halt = len(self.states) + 1
        self.maps: dict[str, list[int]] = {}
        for (_, trigger), to in sorted(transitions.items()):
            self.maps.setdefault(trigger, [number[to], *[self.halt] * (len(self.states) + 1)])
        for (state, trigger), to in transitions.items():
            self.maps[trigger][number[state]] = number[to]

    def map_of(self, event_type: Column) -> Column:
        """The map of a type, null for types that trigger nothing."""
        pairs = [x for t, m in self.maps.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in m]))]
        return F.try_element_at(F.create_map(*pairs), event_type) if pairs else F.lit(None).cast("array<int>")

    def name_of(self, state: Column) -> Column:
        """Null before any state and after the halt."""
        return F.try_element_at(F.array(*[F.lit(s) for s in self.states]), F.when(state.between(1, len(self.states)), state)) if self.states else F.lit(None).cast("string")

    def same(self) -> Column:
        return F.array(*[F.lit(i) for i in range(self.halt + 1)])


def _in_order(block: str) -> Column:
    return F.transform(F.array_sort(block), lambda x: x["map"])


def _composed(maps: Column, same: Column) -> Column:
    """One map that does what all do, one after the other."""
    return F.aggregate(maps, same, lambda done, m: F.transform(done, lambda s: F.element_at(m, s + 1)))


def _states(maps: Column, start: Column) -> Column:
    """The state before each map, and the one after the last."""
    return F.aggregate(maps, F.array(start), lambda seen, m: F.concat(seen, F.array(F.element_at(m, F.element_at(seen, -1) + 1))))


def run(events: DataFrame, machine: Machine, key: str, place: str, types: str = "event_type") -> DataFrame:
    """events with from_state, to_state (names) and illegal: those that a machine
    takes, the one that halts it last.

    place: 0, 1, 2 and so on among a key's events that trigger anything; other
    events must be left out before.
    """
    same = machine.same()
    rows = events.withColumns({"_map": machine.map_of(F.col(types)), "_block": F.floor(F.col(place) / BLOCK)})
    levels = [written(rows.groupBy(key, "_block").agg(F.collect_list(F.struct(F.col(place).alias("at"), F.col("_map").alias("map"))).alias("block")).select(key, "_block", _in_order("block").alias("maps")), "blocks")]
    while not levels[-1].where("_block > 0").isEmpty():
        up = levels[-1].select(key, "_block", F.floor(F.col("_block") / BLOCK).alias("_up"), _composed(F.col("maps"), same).alias("map"))
        up = up.groupBy(key, "_up").agg(F.collect_list(F.struct(F.col("_block").alias("at"), "map")).alias("block"))
        levels.append(written(up.select(key, F.col("_up").alias("_block"), _in_order("block").alias("maps")), "blocks"))
    starts = levels[-1].select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.lit(0).alias("_start"))
    for level in reversed(levels):
        held = level.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at"))).select(key, "_block", _states(F.col("maps"), F.col("_start")).alias("states"))
        if level is levels[0]:
            break
        below = held.select(F.col(key).alias("_key"), "_block", F.posexplode("states").alias("_i", "_start")).where(F.col("_i") < BLOCK)
        starts = written(below.select("_key", (F.col("_block") * BLOCK + F.col("_i")).alias("_at"), "_start"), "starts")
    # The state before each event, by its place in its block; the next one in the row is the state after.
    held = held.select(F.col(key).alias("_key"), F.col("_block").alias("_own"), "states")
    rows = rows.join(held, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_own")))
    at = (F.col(place) % BLOCK + 1).cast("int")
    rows = rows.withColumns({"_from": F.element_at("states", at), "_to": F.element_at("states", at + 1)})
    halted = F.col("_to") == machine.halt
    taken = rows.where(F.col("_from") != machine.halt)
    return taken.select(*events.columns, machine.name_of(F.col("_from")).alias("from_state"), machine.name_of(F.col("_to")).alias("to_state"), halted.alias("illegal"))
