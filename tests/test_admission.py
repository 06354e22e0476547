from whence.operators import admission as A

EVENTS = [(1, "view", 0, 0, 5.0), (2, "click", 100, 160, 7.0), (3, "purchase", 300, 300, 20.0), (4, "error", None, None, None)]
LINKS = [(1, 2), (2, 3), (1, 3)]
CHANGEABLE = (A.Changeable("purchase", "value", 0, 100), A.Changeable("view", "place", values=("top", "side")))
STEPS = ("view", "click", "purchase")
TURNS = (("idle", "busy"), ("busy", "idle"))


def case(kind, **own):
    return tuple(kind if n == "kind" else own.get(n) for n in [f.split()[0] for f in A.PROPOSAL.split(", ")])


CASES = [
    (case("SHIFT_TIMING", target=2, shift=50), None),
    (case("SHIFT_TIMING", target=2, shift=199), None),  # begins at 299, before what follows
    (case("SHIFT_TIMING", target=2, shift=200), "WOULD_VIOLATE_LAW_TIME"),
    (case("SHIFT_TIMING", target=2, shift=-160), "WOULD_VIOLATE_LAW_TIME"),  # ends when its cause begins
    (case("SHIFT_TIMING", target=2, shift=-159), None),
    (case("SHIFT_TIMING", target=4, shift=5), None),
    (case("SHIFT_TIMING", target=9, shift=5), "UNKNOWN_TARGET"),
    (case("REMOVE_EVENT", target=3), None),
    (case("REMOVE_EVENT"), "UNKNOWN_TARGET"),
    (case("INSERT_EVENT", target=1, new_type="click"), None),
    (case("INSERT_EVENT", new_type="click"), None),
    (case("INSERT_EVENT", target=8, new_type="click"), "UNKNOWN_TARGET"),
    (case("INSERT_EVENT", target=1, new_type="error"), "STEP_NOT_ADMITTED_BY_PROCESS"),
    (case("INSERT_EVENT", target=1), "STEP_NOT_ADMITTED_BY_PROCESS"),
    (case("CHANGE_ATTRIBUTE", target=3, attribute="value", new_value="30"), None),
    (case("CHANGE_ATTRIBUTE", target=3, attribute="value", new_value="20"), "CHANGES_NOTHING"),
    (case("CHANGE_ATTRIBUTE", target=3, attribute="value", new_value="101"), "VALUE_OUTSIDE_DECLARED_BOUND"),
    (case("CHANGE_ATTRIBUTE", target=3, attribute="value", new_value="much"), "VALUE_OUTSIDE_DECLARED_BOUND"),
    (case("CHANGE_ATTRIBUTE", target=3, attribute="place", new_value="top"), "ATTRIBUTE_NOT_DECLARED_CHANGEABLE"),
    (case("CHANGE_ATTRIBUTE", target=1, attribute="place", new_value="top"), None),
    (case("CHANGE_ATTRIBUTE", target=1, attribute="place", new_value="down"), "VALUE_OUTSIDE_DECLARED_BOUND"),
    (case("CHANGE_ATTRIBUTE", target=2, attribute="value", new_value="1"), "DECLARATION_ABSENT"),
    (case("CHANGE_ATTRIBUTE", target=7, attribute="value", new_value="1"), "UNKNOWN_TARGET"),
    (case("CHANGE_ENTITY_STATE", entity=1, from_state="idle", to_state="busy"), None),
    (case("CHANGE_ENTITY_STATE", entity=1, from_state="idle", to_state="idle"), "TRANSITION_NOT_DECLARED"),
    (case("CHANGE_ENTITY_STATE", entity=2, from_state="idle", to_state="busy"), "UNKNOWN_TARGET"),
]


def run(spark, cases, steps=STEPS, turns=TURNS, changeable=CHANGEABLE):
    e = spark.createDataFrame(EVENTS, "event_id long, event_type string, lo long, hi long, value double")
    got = A.admit(spark.createDataFrame(cases, A.PROPOSAL), e, spark.createDataFrame(LINKS, "source long, target long"), spark.createDataFrame([(1,), (1,)], "entity long"), changeable, steps, turns).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_every_kind_and_reason(spark):
    assert run(spark, [c for c, _ in CASES]) == sorted(((*c, r) for c, r in CASES), key=repr)
    bare = run(spark, [CASES[9][0], CASES[14][0], CASES[23][0]], (), (), ())
    assert {r[-1] for r in bare} == {"DECLARATION_ABSENT"}
    assert {r for _, r in CASES if r} | {"DECLARATION_ABSENT"} == set(A.REASONS)
    assert run(spark, []) == []


def test_proposals_without_a_target_are_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") < 0, F.col("id")).alias("target"), "id")
    facts = spark.createDataFrame([(-1, "x"), (-2, "y"), (5, "z")], "target long, told string").hint("merge")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = A._looked_up(rows, facts, "target")
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count("told").alias("told")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(tasks) > 1 and sum(t.n for t in tasks) == 4000
    assert not any(t.told for t in tasks)  # no row without a key meets an event of a like number
